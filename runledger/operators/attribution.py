"""Attribution of serverless usage to tagged runs.

A usage row belongs to a tag record when they share the run id, or when the record's notebook is the row's
notebook and was running as the usage began. The disjunction is split into three parts that are each an
equi-join: by run id; by notebook and time bucket, without the pairs found by run id; and the rows left
over by both, through anti-joins. Rows need no identifier and equal usage rows keep their multiplicity.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.clock import Clock, ntz
from runledger.functions import epoch_second
from runledger.functions.nodes import covering_nodes, levels_for, nodes_above
from runledger.operators.pricing import with_price_as_of
from runledger.operators.skew import key_hash, parts_of, shuffle_partitions, sketch, spread_join
from runledger.operators.sweep import running_total
from runledger.sources.tables import Tables

WINDOW_DAYS = 90
BUCKET_HOURS = 6

USAGE_COLUMNS = [
    "usage_date",
    "workspace_id",
    "job_id",
    "job_run_id",
    "notebook_path",
    "sku_name",
    "dbus",
    "estimated_cost_usd",
    "usage_start_time",
    "usage_end_time",
]
TAG_COLUMNS = [
    "correlation_id",
    "adf_pipeline_name",
    "adf_run_id",
    "project_code",
    "cost_center",
    "department",
    "business_unit",
    "environment",
    "application_name",
    "owner_email",
    "run_status",
    "created_by",
]
BY_RUN = ["job_run_id"]
BY_NOTEBOOK = ["notebook_path", "_node"]


def bucket_of(time: Column) -> Column:
    return F.floor(epoch_second(time) / (3600 * BUCKET_HOURS))


def _billed(t: Tables, clock: Clock, days: int) -> DataFrame:
    return t.usage.filter(
        F.col("is_serverless")
        & F.col("billing_origin_product").isin(*V.ATTRIBUTED_PRODUCTS)
        & clock.on_dates(F.col("usage_date"), days)
    )


def billed_usage(t: Tables, clock: Clock, days: int) -> DataFrame:
    """Serverless usage of the attributed products, priced as of its date."""
    return (
        with_price_as_of(t, clock, _billed(t, clock, days), days)
        .withColumn("dbus", F.col("usage_quantity"))
        .withColumn("estimated_cost_usd", F.col("usage_quantity") * F.col("unit_price"))
        .select(*USAGE_COLUMNS)
    )


def tag_records(t: Tables, clock: Clock, columns: list[str]) -> DataFrame:
    """Tag records with ``columns`` and when they were running, an open one up to now."""
    return t.tags.select(
        *BY_RUN, "notebook_path", *columns, F.col("run_start_time").alias("_tag_start"), F.coalesce("run_end_time", clock.now()).alias("_tag_end")
    )


@dataclass(frozen=True)
class _Profile:
    """What the joins need to know: the span of the usage, the levels of the time tree and the hot keys of both sides."""

    first: datetime
    last: datetime
    levels: int
    hot_usage: tuple[dict[int, int], dict[int, int]]
    hot_tags: tuple[dict[int, int], dict[int, int]]


def _keyed(side: str, rows: DataFrame, starts: str, ends: str) -> DataFrame:
    where = rows.withColumn("_node", bucket_of(F.col(starts)))
    return where.select(
        F.lit(side).alias("side"), key_hash(BY_RUN).alias("_run"), key_hash(BY_NOTEBOOK).alias("_notebook"), F.col(starts).alias("_first"), F.col(ends).alias("_last")
    )


def _profile(clock: Clock, usage: DataFrame, tags: DataFrame) -> _Profile:
    """One pass over the key columns of both sides; the answer is two rows of bounded size.

    Notebooks are counted at the bucket in which a record begins, before it is spread over the tree.
    """
    partitions = shuffle_partitions(usage)
    keyed = _keyed("usage", usage, "usage_start_time", "usage_start_time").unionByName(_keyed("tags", tags, "_tag_start", "_tag_end"))
    rows = keyed.groupBy("side").agg(
        F.min("_first").alias("first"),
        F.max("_last").alias("last"),
        F.count("*").alias("n"),
        F.count("_notebook").alias("m"),
        F.max(bucket_of(F.col("_last")) - bucket_of(F.col("_first"))).alias("longest"),
        sketch("_run", "runs", partitions),
        sketch("_notebook", "notebooks", partitions),
    )
    found = {row.side: row for row in rows.collect()}

    def hot(side: str) -> tuple[dict[int, int], dict[int, int]]:
        row = found.get(side)
        return (parts_of(row.runs, row.n, partitions), parts_of(row.notebooks, row.m, partitions)) if row else ({}, {})

    used, tagged = found.get("usage"), found.get("tags")
    return _Profile(
        (used.first if used else None) or clock.as_of,
        (used.last if used else None) or clock.as_of,
        levels_for((tagged.longest or 0) if tagged else 0),
        hot("usage"),
        hot("tags"),
    )


def _ran(tags: DataFrame, profile: _Profile) -> DataFrame:
    """Records with a notebook that were running while there was usage."""
    start, end = F.col("_tag_start"), F.col("_tag_end")
    return tags.filter(F.col("notebook_path").isNotNull() & (start <= ntz(profile.last)) & (end >= ntz(profile.first)) & (end >= start))


def _clipped_buckets(profile: _Profile) -> tuple[Column, Column]:
    return bucket_of(F.greatest("_tag_start", ntz(profile.first))), bucket_of(F.least("_tag_end", ntz(profile.last)))


def _running() -> Column:
    return F.col("usage_start_time").between(F.col("_tag_start"), F.col("_tag_end"))


def _matched(usage: DataFrame, tags: DataFrame, profile: _Profile) -> DataFrame:
    columns = [*USAGE_COLUMNS, *TAG_COLUMNS]
    by_run = spread_join(
        usage,
        tags.select(*BY_RUN, *TAG_COLUMNS),
        BY_RUN,
        "inner",
        hot_left=profile.hot_usage[0],
        hot_right=profile.hot_tags[0],
    )
    # A pair that shares the run id is already there; a NULL id on either side shares nothing.
    other_run = ~F.coalesce(F.col("job_run_id") == F.col("_tag_run"), F.lit(False))
    # An interval is a few nodes of a tree over time, and an instant meets it at one of the nodes above its bucket.
    used = usage.filter("notebook_path IS NOT NULL").withColumn("_b", bucket_of(F.col("usage_start_time")))
    ran = _ran(tags, profile).withColumns(dict(zip(("_b", "_c"), _clipped_buckets(profile), strict=True)))
    by_notebook = spread_join(
        used.withColumn("_node", F.explode(nodes_above(F.col("_b"), profile.levels))).drop("_b"),
        ran.withColumn("_node", F.explode(covering_nodes(F.col("_b"), F.col("_c"), profile.levels))).drop("_b", "_c").withColumnRenamed("job_run_id", "_tag_run"),
        BY_NOTEBOOK,
        "inner",
        _running() & other_run,
        hot_left=profile.hot_usage[1],
        hot_right=profile.hot_tags[1],
        multiplies=True,
    )
    return by_run.select(*columns).unionByName(by_notebook.select(*columns))


def covered_times(pieces: DataFrame) -> DataFrame:
    """The times at which any record was running, per notebook and bucket: pieces that meet become one.

    A stretch begins at a piece that starts after the latest end of all earlier ones. That prefix maximum is taken in two
    steps, within a minute and over the minutes of a bucket, so a bucket's pieces need not meet in one task.
    """
    starts = pieces.groupBy(*BY_NOTEBOOK, "_tag_start").agg(F.max("_tag_end").alias("_tag_end")).withColumn("_minute", F.floor(epoch_second(F.col("_tag_start")) / 60))
    minute = [*BY_NOTEBOOK, "_minute"]
    earlier = lambda order, *by: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    minutes = starts.groupBy(*minute).agg(F.max("_tag_end").alias("_upto"))
    before = minutes.select(
        *minute, F.max("_upto").over(earlier("_minute", *BY_NOTEBOOK)).alias("_before"), F.max("_upto").over(Window.partitionBy(*BY_NOTEBOOK)).alias("_last")
    )
    within = starts.withColumn("_within", F.max("_tag_end").over(earlier("_tag_start", *minute)))
    ended = within.join(before, minute).withColumn("_ended", F.greatest("_before", "_within"))
    # What ended before a stretch begins is the end of the stretch before it.
    first = ended.filter("_ended IS NULL OR _ended < _tag_start")
    following = F.lead("_ended").over(Window.partitionBy(*BY_NOTEBOOK).orderBy("_tag_start"))
    return first.select(*BY_NOTEBOOK, "_tag_start", F.coalesce(following, "_last").alias("_tag_end"))


def _unmatched(usage: DataFrame, tags: DataFrame, profile: _Profile) -> DataFrame:
    """The rows of ``usage`` (job_run_id, notebook_path, usage_start_time and others) that no record matches."""
    known_runs = tags.select(*BY_RUN).filter("job_run_id IS NOT NULL").distinct()
    without_run = spread_join(usage, known_runs, BY_RUN, "left_anti", hot_left=profile.hot_usage[0])
    pieces = _ran(tags, profile).select("notebook_path", "_tag_start", "_tag_end", F.explode(F.sequence(*_clipped_buckets(profile))).alias("_node"))
    return spread_join(
        without_run.withColumn("_node", bucket_of(F.col("usage_start_time"))),
        covered_times(pieces),
        BY_NOTEBOOK,
        "left_anti",
        _running(),
        hot_left=profile.hot_usage[1],
    ).select(*usage.columns)


def _prepared(t: Tables, clock: Clock, days: int, columns: list[str]) -> tuple[DataFrame, DataFrame, _Profile]:
    """Usage, tag records and their profile."""
    usage, tags = billed_usage(t, clock, days), tag_records(t, clock, columns)
    # The profile needs no price.
    return usage, tags, _profile(clock, _billed(t, clock, days), tags)


def attribute_usage(t: Tables, clock: Clock, days: int = WINDOW_DAYS) -> DataFrame:
    """Usage rows with the columns of every matching tag record, or with NULLs and UNMATCHED."""
    usage, tags, profile = _prepared(t, clock, days, TAG_COLUMNS)
    matched = _matched(usage, tags, profile).withColumn("correlation_status", F.lit(V.MATCHED))
    rest = _unmatched(usage, tags, profile).withColumn("correlation_status", F.lit(V.UNMATCHED))
    return note_days(matched.unionByName(rest, allowMissingColumns=True), days)


def note_days(attributed: DataFrame, days: int) -> DataFrame:
    """Notes the window with the date column, so a report can tell whether shared rows reach back far enough."""
    return attributed.withColumn("usage_date", F.col("usage_date").alias("usage_date", metadata={"days": days}))


def attributed_days(attributed: DataFrame) -> int | None:
    """How many days of usage attributed rows hold, where that is known."""
    return attributed.schema["usage_date"].metadata.get("days")


def unmatched_rows(t: Tables, clock: Clock, days: int = WINDOW_DAYS) -> DataFrame:
    """Only the usage rows without a tag record; the matching pairs are never built."""
    return _unmatched(*_prepared(t, clock, days, []))


def _weighted(n: Column, cost: Column, times: Column) -> list[Column]:
    """Rows and cost of groups that each occur ``times`` times, added up exactly."""
    product = cost.cast("decimal(27,10)") * times.cast("decimal(10,0)")
    return [F.sum(n * times).alias("n"), F.sum(product).alias("c")]


def _live_weights(usage: DataFrame, tags: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and cost of the pairs of a usage row and a record that share ``keys`` and was running, one row.

    Counts of starts and ends up to an instant give the number of running records, so no pair is built.
    """
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    used = usage.filter(known & F.col("usage_start_time").isNotNull()).groupBy(*keys, F.col("usage_start_time").alias("t"))
    marks = used.agg(F.count("*").alias("n"), F.sum("estimated_cost_usd").alias("c"))
    for mark in ("start", "end"):
        counted = tags.filter(known).groupBy(*keys, F.col(f"_tag_{mark}").alias("t")).agg(F.count("*").alias(f"n_{mark}"))
        marks = marks.unionByName(counted, allowMissingColumns=True)
    none = F.lit(0).cast("bigint")
    instants = (
        marks.groupBy(*keys, "t")
        .agg(
            *(F.coalesce(F.sum(name), none).alias(name) for name in ("n", "n_start", "n_end")),
            F.coalesce(F.sum("c").cast("decimal(27,10)"), F.lit(0).cast("decimal(27,10)")).alias("c"),
        )
        .withColumn("_net", F.col("n_start") - F.col("n_end"))
    )
    # A record is running at its end as well.
    running = F.col("_after") + F.col("n_end")
    return running_total(instants, "_net", "_after", keys).filter("n > 0").agg(*_weighted(F.col("n"), F.col("c"), running))


def attribution_totals(t: Tables, clock: Clock, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows ``n`` and cost ``c`` of attributed usage per ``correlation_status``, without building the rows.

    Pairs by run id are counted from both sides grouped by run, pairs by notebook from a sweep over time;
    pairs that both rules find are counted once more and taken off.
    """
    usage, tags, profile = _prepared(t, clock, days, [])
    ran = tags.filter(
        (F.col("_tag_start") <= ntz(profile.last)) & (F.col("_tag_end") >= ntz(profile.first)) & (F.col("_tag_end") >= F.col("_tag_start"))
    ).withColumn("_tag_start", F.greatest("_tag_start", ntz(profile.first)))
    runs = usage.groupBy(*BY_RUN).agg(F.count("*").alias("n"), F.sum("estimated_cost_usd").alias("c"))
    records = tags.groupBy(*BY_RUN).agg(F.count("*").alias("m"))
    by_run = runs.join(records, BY_RUN).agg(*_weighted(F.col("n"), F.col("c"), F.col("m")))
    by_notebook = _live_weights(usage, ran, ["notebook_path"])
    by_both = _live_weights(usage, ran, ["job_run_id", "notebook_path"]).select((-F.col("n")).alias("n"), (-F.col("c")).alias("c"))
    matched = by_run.unionByName(by_notebook).unionByName(by_both).agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    rest = _unmatched(usage, tags, profile).agg(
        F.count("*").alias("n"), F.sum("estimated_cost_usd").alias("c")
    )
    both = matched.withColumn("correlation_status", F.lit(V.MATCHED)).unionByName(
        rest.withColumn("correlation_status", F.lit(V.UNMATCHED))
    )
    return both.filter("n > 0").select("correlation_status", "n", "c")
