"""Price rules: current list price, list price as of the usage date, or one flat rate."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.clock import Clock
from runledger.operators.skew import look_up
from runledger.schemas import PRICE
from runledger.sources.tables import Tables

MODES = ("current", "asof", "flat")


def flat_price() -> Column:
    return F.lit(V.DEFAULT_UNIT_PRICE).cast(PRICE)


def current_prices(t: Tables) -> DataFrame:
    """The open-ended price of every SKU and cloud."""
    return t.list_prices.filter(F.col("price_end_time").isNull()).select("sku_name", "cloud", "unit_price")


def with_current_price(t: Tables, facts: DataFrame) -> DataFrame:
    """Adds ``unit_price``, NULL where the list has none."""
    return look_up(facts, current_prices(t), ["sku_name", "cloud"], t.prices_fit())


def _daily_prices(t: Tables, clock: Clock, days: int) -> DataFrame:
    """The price list unrolled to one row per price and day on which it holds."""
    first, last = clock.today - timedelta(days=days), clock.today
    day = F.col("usage_date").cast("timestamp_ntz")
    return t.list_prices.withColumn("usage_date", F.explode(F.sequence(F.lit(first), F.lit(last)))).filter(
        (F.col("price_start_time") <= day) & (F.col("price_end_time").isNull() | (F.col("price_end_time") > day))
    )


def _price_by_day(t: Tables, clock: Clock, days: int) -> DataFrame:
    """Per SKU and day the price of each cloud and the one to use elsewhere (newest, then first cloud, none last).

    A group holds one entry per cloud.
    """
    # The newest price of a cloud; the lower one if two began together.
    newest = F.max(F.struct("price_start_time", (-F.col("unit_price")).alias("minus"), "unit_price")).alias("p")
    per_cloud = _daily_prices(t, clock, days).groupBy("sku_name", "usage_date", "cloud").agg(newest)
    entries = F.collect_list(F.struct(F.col("cloud").isNull().alias("anywhere"), "cloud", F.col("p.price_start_time").alias("since"), F.col("p.unit_price").alias("unit_price")))
    latest = F.array_max(F.transform("e", lambda x: x["since"]))
    return (
        per_cloud.groupBy("sku_name", "usage_date")
        .agg(entries.alias("e"))
        .select(
            "sku_name",
            "usage_date",
            F.map_from_entries(F.transform(F.filter("e", lambda x: ~x["anywhere"]), lambda x: F.struct(x["cloud"], x["unit_price"]))).alias("_own"),
            F.array_min(F.filter("e", lambda x: x["since"] == latest))["unit_price"].alias("_any"),
        )
    )


def with_price_as_of(t: Tables, clock: Clock, usage: DataFrame, days: int) -> DataFrame:
    """Adds ``unit_price`` valid on ``usage_date``: same cloud first, then any cloud, then the flat rate.

    ``days`` must cover the dates in ``usage``; the lookup table has one row per SKU and day.
    """
    priced = look_up(usage, _price_by_day(t, clock, days), ["sku_name", "usage_date"], t.prices_fit(copies=days + 1))
    return priced.withColumn("unit_price", F.coalesce(F.col("_own")[F.col("cloud")], "_any", flat_price())).drop("_own", "_any")


def price_usage(t: Tables, clock: Clock, mode: str = "current", days: int = 90) -> DataFrame:
    """Every usage row of the window with ``unit_price`` and exact decimal ``cost``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode}")
    usage = t.usage.filter(clock.on_dates(F.col("usage_date"), days))
    if mode == "asof":
        priced = with_price_as_of(t, clock, usage, days)
    elif mode == "current":
        priced = with_current_price(t, usage).withColumn("unit_price", F.coalesce("unit_price", F.lit(0).cast(PRICE)))
    else:
        priced = usage.withColumn("unit_price", flat_price())
    return priced.withColumn("cost", F.col("usage_quantity") * F.col("unit_price"))
