"""Totals of attributed usage per date, tag dimensions, run and notebook, without the pairs of usage rows and tag records.

Usage is added up per date, run, notebook and instant, tag records are counted per dimension, and only these meet:

* by run id: a run's totals, weighted by its number of records of each dimension;
* by notebook: the records of a dimension become disjoint segments of time that know how many records are running, so a
  usage instant meets one segment per dimension however many records overlap there;
* what both rules find is taken off again, and what neither finds comes from anti-joins.

Reports take their totals from ``FactorisedTotals.grouped``, which holds no row per run, notebook and dimension either; ``parts``
keeps runs and notebooks as keys, exact sets that any roll-up can merge. A dimension is a digest of its six tags until the result
is named.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.clock import Clock
from runledger.functions.nodes import covering_nodes, nodes_above
from runledger.operators.attribution import (
    BY_NOTEBOOK,
    BY_RUN,
    WINDOW_DAYS,
    _clipped_buckets,
    _profile,
    _Profile,
    _ran,
    _unmatched,
    billed_usage,
    bucket_of,
    tag_records,
)
from runledger.operators.costs import SUMMARY_KEYS
from runledger.operators.skew import look_up, spread_join
from runledger.sources.shared import kept, kept_together
from runledger.sources.tables import Tables, at_most

DIMENSIONS = SUMMARY_KEYS[1:]
_KEYS = ["usage_date", "_dim", "job_run_id", "notebook_path"]
_CELL = ["usage_date", "notebook_path", "usage_start_time"]
# Up to so many groups are told apart by the bits of a number, so that a set of them is one row.
_FEW_GROUPS = 4_096
_BITS = 62


def _digest(columns: list[Column]) -> Column:
    """128 bits that tell combinations of values apart, NULL included."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns))))


def _dimension() -> Column:
    return _digest([F.col(name) for name in DIMENSIONS])


def _no_dimension() -> Column:
    return _digest([F.lit(None).cast("string").alias(name) for name in DIMENSIONS])


def _added() -> list[Column]:
    """Sums that usage rows enter with, whatever they are multiplied by later."""
    return [F.sum("q").cast("decimal(27,6)").alias("q"), F.sum("n").alias("n"), F.sum("c").cast("decimal(27,10)").alias("c"), F.max("most").alias("most"), F.sum("rows").alias("rows")]


def _reduced_usage(t: Tables, clock: Clock, days: int) -> DataFrame:
    # Instants matter to the rows of a notebook only.
    rows = billed_usage(t, clock, days).select(
        "usage_date", "job_run_id", "notebook_path", F.when(F.col("notebook_path").isNotNull(), F.col("usage_start_time")).alias("usage_start_time"),
        F.col("dbus").alias("q"), F.when(F.col("dbus").isNotNull(), 1).otherwise(0).alias("n"),
        F.col("estimated_cost_usd").alias("c"), F.col("estimated_cost_usd").alias("most"), F.lit(1).alias("rows"),
    )
    return rows.groupBy("usage_date", "job_run_id", "notebook_path", "usage_start_time").agg(*_added())


def _weighted(rows: DataFrame, weight: Column, counts_most: bool = True) -> DataFrame:
    """Rows times the number of records they meet."""
    exact = weight.cast("decimal(10,0)")
    return rows.select(
        *_KEYS,
        (F.col("q") * exact).cast("decimal(38,6)").alias("q"),
        (F.col("n") * weight).alias("n"),
        (F.col("c") * exact).cast("decimal(38,10)").alias("c"),
        (F.col("most") if counts_most else F.lit(None).cast(rows.schema["most"].dataType)).alias("most"),
        (F.col("rows") * weight).alias("rows"),
    )


def _segments(tags: DataFrame, profile: _Profile) -> DataFrame:
    """(notebook_path, _node, _dim, _from, _to, _live): stretches of a node with the number of a dimension's records running.

    Only the buckets in which a record begins or ends have bounds; what it covers in full are nodes of the time tree.
    ``_from`` is NULL where records run on from before the node, ``_to`` where they run on beyond it.
    """
    key = [*BY_NOTEBOOK, "_dim"]
    start, end, b, c = F.col("_tag_start"), F.col("_tag_end"), F.col("_b"), F.col("_c")
    begins, ends = bucket_of(start) == b, bucket_of(end) == c
    alone = begins & ends & (b == c)
    net = lambda n: F.lit(n).alias("net")
    mark = lambda node, t, n: F.struct(node.cast("bigint").alias("node"), t.alias("t"), net(n))
    before = F.lit(None).cast("timestamp_ntz")
    # A record is running at its end as well.
    after = end + F.expr("INTERVAL 1 MICROSECOND")
    first, last = b + begins.cast("int"), c - ends.cast("int")
    within = F.when(first <= last, covering_nodes(first, last, profile.levels)).otherwise(F.array().cast("array<bigint>"))
    marks = F.concat(
        F.array_compact(F.array(F.when(begins, mark(b, start, 1)), F.when(ends & ~alone, mark(c, before, 1)), F.when(ends, mark(c, after, -1)))),
        F.transform(within, lambda node: mark(node, before, 1)),
    )
    placed = _ran(tags, profile).withColumns(dict(zip(("_b", "_c"), _clipped_buckets(profile), strict=True)))
    instants = (
        placed.select("notebook_path", "_dim", F.explode(marks).alias("m"))
        .select("notebook_path", F.col("m.node").alias("_node"), "_dim", F.col("m.t").alias("_from"), F.col("m.net").alias("net"))
        .groupBy(*key, "_from")
        .agg(F.sum("net").alias("net"))
    )
    in_order = Window.partitionBy(*key).orderBy(F.asc_nulls_first("_from"))
    live = F.sum("net").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return instants.withColumn("_live", live).withColumn("_to", F.lead("_from").over(in_order)).filter("_live > 0").drop("net")


def _inside() -> Column:
    at = F.col("usage_start_time")
    return (F.col("_from").isNull() | (at >= F.col("_from"))) & (F.col("_to").isNull() | (at < F.col("_to")))


def _at_nodes(rows: DataFrame, profile: _Profile) -> DataFrame:
    return rows.withColumn("_node", F.explode(nodes_above(bucket_of(F.col("usage_start_time")), profile.levels)))


class _Parts:
    """``parts``: usage_date, _dim, job_run_id, notebook_path and sums (q, n, c, most, yes, no) that are still to be added up by
    whatever a report groups by; ``dims``: the tags of each _dim.
    """

    parts: DataFrame
    dims: DataFrame

    def narrow(self) -> DataFrame:
        """One row per date, dimension, run and notebook."""
        sums = [F.sum(c).alias(c) for c in ("q", "n", "c", "yes", "no")]
        return self.parts.groupBy(*_KEYS).agg(*sums, F.max("most").alias("most"))

    def named(self, rows: DataFrame) -> DataFrame:
        """Rows with a ``_dim`` and its tags in its place."""
        return rows.join(self.dims, "_dim").drop("_dim")


@dataclass(frozen=True)
class Totals(_Parts):
    parts: DataFrame
    dims: DataFrame


def totals_of(attributed: DataFrame, matched: Column) -> Totals:
    """Totals of attributed rows that are given."""
    rows = attributed.withColumn("_dim", _dimension())
    narrow = rows.groupBy(*_KEYS).agg(
        F.sum("dbus").alias("q"), F.count("dbus").alias("n"), F.sum("estimated_cost_usd").alias("c"), F.max("estimated_cost_usd").alias("most"),
        F.count_if(matched).alias("yes"), F.count_if(~matched).alias("no"),
    )
    return Totals(narrow, rows.select("_dim", *DIMENSIONS).dropDuplicates(["_dim"]))


class FactorisedTotals(_Parts):
    """Totals of usage and tag records that are added up per group without a row per run, notebook and dimension.

    A *cell* is a date, notebook and instant with usage; ``live`` counts the running records of each dimension per cell. All runs
    of a cell meet the same dimensions, so sums are taken per cell. Distinct runs of a group are

    * those found by run id, and those without any record: one join on the run id;
    * those found by notebook: runs with the same cells in a period are counted, not listed, and each such set of cells meets
      the groups that are live in any of them;
    * less those found both ways, which only runs with a record and a notebook can be.
    """

    def __init__(self, t: Tables, profile: _Profile, usage: DataFrame, tags: DataFrame, dims: DataFrame) -> None:
        self.usage, self.tags, self.dims, self.profile, self._rows = usage, tags, dims, profile, t.broadcast_rows

    @cached_property
    def _dims_fit(self) -> bool:
        return at_most(self.dims, self._rows)

    @cached_property
    def cells(self) -> DataFrame:
        rows = self.usage.filter("notebook_path IS NOT NULL AND usage_start_time IS NOT NULL").groupBy(*_CELL).agg(*_added())
        # As text, since JSON would leave out microseconds.
        return kept(rows.withColumn("_cell", _digest([F.col(name).cast("string") for name in _CELL])), "cells")

    @cached_property
    def _cells_fit(self) -> bool:
        return at_most(self.cells, self._rows)

    @cached_property
    def _noted(self) -> DataFrame:
        """Tag records of the notebooks that have usage."""
        notebooks = self.cells.select("notebook_path").distinct()
        return self.tags.join(F.broadcast(notebooks), "notebook_path", "left_semi") if at_most(notebooks, self._rows) else self.tags

    @cached_property
    def live(self) -> DataFrame:
        """(_cell, _dim, _live): how many records of a dimension are running in a cell."""
        placed = _at_nodes(self.cells.select("_cell", "notebook_path", "usage_start_time"), self.profile)
        met = spread_join(placed, _segments(self._noted, self.profile), BY_NOTEBOOK, "inner", _inside(), hot_left={}, hot_right=self.profile.hot_tags[1])
        # The rows of a dimension lie together, so that they are added up before they are dealt by date.
        return kept(met.select("_cell", "_dim", "_live").repartition("_dim").groupBy("_cell", "_dim").agg(F.sum("_live").alias("_live")), "live")

    @cached_property
    def parts(self) -> DataFrame:
        usage, profile = self.usage, self.profile
        runs = usage.filter("job_run_id IS NOT NULL").groupBy("usage_date", *BY_RUN, "notebook_path").agg(*_added())
        records = self.tags.filter("job_run_id IS NOT NULL").groupBy(*BY_RUN, "_dim").agg(F.count("*").alias("_m"))
        by_run = _weighted(spread_join(runs, records, BY_RUN, "inner", hot_left=profile.hot_usage[0], hot_right=profile.hot_tags[0]), F.col("_m"))
        placed = _at_nodes(usage.filter("notebook_path IS NOT NULL"), profile)
        met = spread_join(placed, _segments(self.tags, profile), BY_NOTEBOOK, "inner", _inside(), hot_left=profile.hot_usage[1], hot_right=profile.hot_tags[1])
        by_notebook = _weighted(met, F.col("_live"))
        matched = by_run.unionByName(by_notebook).unionByName(_weighted(self._found_twice(), -F.col("_m"), counts_most=False))
        open_ = _weighted(_unmatched(usage, self.tags, profile).withColumn("_dim", _no_dimension()), F.lit(1).cast("bigint"))
        none = F.lit(0).cast("bigint")
        rows = matched.withColumn("yes", F.col("rows")).withColumn("no", none).unionByName(open_.withColumn("yes", none).withColumn("no", F.col("rows")))
        return rows.drop("rows")

    def _found_twice(self) -> DataFrame:
        """Usage with the records that share its run and notebook and were running: both rules find them, but they count once."""
        both = [*BY_RUN, "notebook_path"]
        twice = _ran(self._noted, self.profile).filter("job_run_id IS NOT NULL").groupBy(*both, "_dim", "_tag_start", "_tag_end").agg(F.count("*").alias("_m"))
        running = F.col("usage_start_time").between(F.col("_tag_start"), F.col("_tag_end"))
        return spread_join(self.usage.filter("job_run_id IS NOT NULL AND notebook_path IS NOT NULL"), twice, both, "inner", running, hot_left={})

    def grouped(self, keys: list[str], period: Callable[[Column], Column] | None = None, runs: bool = True, notebooks: bool = False) -> DataFrame:
        """Per period of the usage date (``_period``; all of it if not given) and tags ``keys``: sums q, n, c, yes and no, the
        largest cost ``most`` and, where asked for, distinct ``runs`` and ``notebooks``.
        """
        group = _Group(self, keys, period or (lambda day: F.lit(0)))
        parts = [group.by_run(runs), group.by_notebook(runs), group.found_twice()]
        if runs:
            parts += [group.runs_of_several_cells(), group.runs_found_twice()]
        if notebooks:
            parts.append(group.notebooks())
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        counts = [name for name, asked in (("runs", runs), ("notebooks", notebooks)) if asked]
        sums = [*(F.sum(name).alias(name) for name in ("q", "n", "c", "yes", "no")), *(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts)]
        added = rows.groupBy("_period", "_g").agg(*sums, F.max("most").alias("most"))
        return look_up(added, group.names, ["_g"], group.names_fit, reduced=True).drop("_g", *([] if period else ["_period"]))


class _Group:
    """Parts of the totals per period and group of dimensions; each is (_period, _g) with some of the sums."""

    def __init__(self, totals: FactorisedTotals, keys: list[str], of: Callable[[Column], Column]) -> None:
        self.totals = totals
        self.period = of(F.col("usage_date")).alias("_period")
        self.none = _digest([F.lit(None).cast("string").alias(name) for name in keys])
        self.whole = whole = keys == DIMENSIONS
        self.dims = totals.dims.select("_dim", (F.col("_dim") if whole else _digest([F.col(name) for name in keys])).alias("_g"), *keys)
        self.names = self.dims.select("_g", *keys).dropDuplicates(["_g"])
        self.names_fit = totals._dims_fit
        live = self._to_groups(totals.live)
        self.live = live if whole else kept(live.groupBy("_cell", "_g").agg(F.sum("_live").alias("_live")), "live-groups")
        records = self._to_groups(totals.tags.filter("job_run_id IS NOT NULL").select(*BY_RUN, "_dim"))
        # Without a hot run all steps on runs share one exchange.
        self.plain = not (totals.profile.hot_usage[0] or totals.profile.hot_tags[0])
        self.records = (records.repartition(*BY_RUN) if self.plain else records).groupBy(*BY_RUN, "_g").agg(F.count("*").alias("_m"))

    def _to_groups(self, rows: DataFrame) -> DataFrame:
        if self.whole:
            return rows.withColumnRenamed("_dim", "_g")
        return look_up(rows, self.dims.select("_dim", "_g"), ["_dim"], self.totals._dims_fit).drop("_dim")

    @cached_property
    def used(self) -> DataFrame:
        """Usage with its cell, whether any record runs there (``_covered``), and whether one of the group without tags does (``_none``)."""
        flags = self.live.groupBy("_cell").agg(F.max(F.col("_g") == self.none).alias("_none"))
        cells = self.totals.cells.select("_cell", *_CELL).join(flags, "_cell", "left").withColumn("_covered", F.col("_none").isNotNull())
        rows = look_up(self.totals.usage, cells, _CELL, self.totals._cells_fit)
        unknown = F.lit(False)
        return rows.withColumns({"_covered": F.coalesce("_covered", unknown), "_none": F.coalesce("_none", unknown)}).withColumn("_period", self.period)

    def _with_records(self, used: DataFrame, how: str) -> DataFrame:
        runs = used.filter("job_run_id IS NOT NULL")
        if self.plain:
            return runs.join(self.records, BY_RUN, how)
        return spread_join(runs, self.records, BY_RUN, how, hot_left=self.totals.profile.hot_usage[0], hot_right=self.totals.profile.hot_tags[0])

    def by_run(self, count: bool) -> DataFrame:
        """What run ids find, and what neither rule finds. A run without a record counts where the other rule does not find its group."""
        used = self.used.select("_period", *BY_RUN, "_covered", "_none", "q", "n", "c", "most", "rows")
        found, none = F.col("_g").isNotNull(), F.lit(0).cast("bigint")
        weight = F.when(found, F.col("_m")).when(~F.col("_covered"), F.lit(1).cast("bigint"))
        exact = weight.cast("decimal(10,0)")
        sums = [
            F.sum((F.col("q") * exact).cast("decimal(38,6)")).alias("q"), F.sum(F.col("n") * weight).alias("n"),
            F.sum((F.col("c") * exact).cast("decimal(38,10)")).alias("c"), F.max(F.when(weight.isNotNull(), F.col("most"))).alias("most"),
            F.sum(F.col("rows") * weight).alias("rows"),
        ]
        of_run = BY_RUN if count else []
        per_run = self._with_records(used, "left").groupBy(*of_run, "_period", "_g").agg(*sums, F.max("_none").alias("_none"))
        runs = per_run.filter(F.col("rows") > 0).withColumn("runs", F.when(found | ~F.col("_none"), F.lit(1).cast("bigint")).otherwise(none)).drop(*BY_RUN, "_none")
        others = used.filter("job_run_id IS NULL").withColumns({"_g": F.lit(None).cast("binary"), "_m": none})
        without = others.groupBy("_period", "_g").agg(*sums).filter(F.col("rows") > 0).withColumn("runs", none)
        both = runs.unionByName(without).withColumns({"yes": F.when(found, F.col("rows")).otherwise(none), "no": F.when(found, none).otherwise(F.col("rows"))})
        return both.withColumn("_g", F.coalesce("_g", self.none)).drop("rows")

    @cached_property
    def _cell_sets(self) -> DataFrame:
        """(_period, job_run_id, _cells, _runs): how many runs have the same cells in a period, and one of them."""
        cells = self.used.filter("_cell IS NOT NULL AND job_run_id IS NOT NULL").select("_period", *BY_RUN, "_cell")
        marks = [F.bit_xor(F.xxhash64("_cell", F.lit(i))).alias(f"_x{i}") for i in range(2)]
        sets = cells.groupBy("_period", *BY_RUN).agg(F.count("*").alias("_cells"), *marks)
        one = sets.groupBy("_period", "_cells", "_x0", "_x1").agg(F.count("*").alias("_runs"), F.min(*BY_RUN).alias(*BY_RUN)).drop("_x0", "_x1")
        return kept(one.join(cells, ["_period", *BY_RUN]), "cell-sets")

    def by_notebook(self, count: bool) -> DataFrame:
        """What notebooks find, with the runs that have no other cell in the period."""
        cells = self.totals.cells.select("_cell", self.period, "q", "n", "c", "most", "rows")
        if count:
            cells = cells.join(self._cell_sets.filter("_cells = 1").select("_cell", F.col("_runs").alias("runs")), "_cell", "left")
        else:
            cells = cells.withColumn("runs", F.lit(None).cast("bigint"))
        met = look_up(self.live, cells, ["_cell"], self.totals._cells_fit, reduced=True)
        return _times(met, F.col("_live"), "_period", "_g", "runs")

    def found_twice(self) -> DataFrame:
        twice = self.totals._found_twice().withColumn("_period", self.period)
        return _times(self._to_groups(twice), -F.col("_m"), "_period", "_g").drop("most")

    def runs_of_several_cells(self) -> DataFrame:
        """Runs that notebooks find in a period with more than one cell, per group that is live in any of them."""
        sets = self._cell_sets.filter("_cells > 1")
        few = at_most(self.names, _FEW_GROUPS)
        if not few:
            once = sets.join(self.live.select("_cell", "_g"), "_cell").groupBy("_period", *BY_RUN, "_g").agg(F.max("_runs").alias("runs"))
            return once.groupBy("_period", "_g").agg(F.sum("runs").alias("runs"))
        number = F.row_number().over(Window.orderBy("_g")) - 1
        numbered = self.names.select("_g", number.alias("_i")).select("_g", F.floor(F.col("_i") / _BITS).alias("_block"), (F.col("_i") % _BITS).alias("_bit"))
        bit = F.expr("shiftleft(1L, _bit)")
        masks = look_up(self.live, numbered, ["_g"], True).groupBy("_cell", "_block").agg(F.bit_or(bit).alias("_mask"))
        joined = sets.join(masks, "_cell").groupBy("_period", *BY_RUN, "_block").agg(F.bit_or("_mask").alias("_mask"), F.max("_runs").alias("runs"))
        counted = joined.groupBy("_period", "_block", "_mask").agg(F.sum("runs").alias("runs"))
        return counted.join(F.broadcast(numbered), "_block").filter(F.col("_mask").bitwiseAND(bit) != 0).groupBy("_period", "_g").agg(F.sum("runs").alias("runs"))

    def runs_found_twice(self) -> DataFrame:
        """Runs of a period and group that run id and notebook find, to be taken off."""
        cells = self.used.filter("_cell IS NOT NULL").select("_period", *BY_RUN, "_cell")
        once = self._with_records(cells, "inner").drop("_m").join(self.live.select("_cell", "_g"), ["_cell", "_g"]).select("_period", *BY_RUN, "_g").distinct()
        return once.groupBy("_period", "_g").agg((-F.count("*")).alias("runs"))

    def notebooks(self) -> DataFrame:
        """Distinct notebooks."""
        columns = ["_period", "_g", "notebook_path"]
        met = look_up(self.live, self.totals.cells.select("_cell", self.period, "notebook_path"), ["_cell"], self.totals._cells_fit, reduced=True)
        used = self.used.filter("notebook_path IS NOT NULL").select("_period", *BY_RUN, "notebook_path", "_covered")
        known = self._with_records(used, "left").filter("_g IS NOT NULL OR NOT _covered").withColumn("_g", F.coalesce("_g", self.none))
        others = used.filter("job_run_id IS NULL AND NOT _covered").withColumn("_g", self.none)
        rows = met.select(*columns).unionByName(known.select(*columns)).unionByName(others.select(*columns)).distinct()
        return rows.groupBy("_period", "_g").agg(F.count("*").alias("notebooks"))


def _times(rows: DataFrame, weight: Column, *others: str) -> DataFrame:
    """Matched rows, counted as often as the records they meet."""
    exact = weight.cast("decimal(10,0)")
    return rows.select(
        *others,
        (F.col("q") * exact).cast("decimal(38,6)").alias("q"),
        (F.col("n") * weight).alias("n"),
        (F.col("c") * exact).cast("decimal(38,10)").alias("c"),
        "most",
        (F.col("rows") * weight).alias("yes"),
        F.lit(0).cast("bigint").alias("no"),
    )


def attributed_totals(t: Tables, clock: Clock, days: int = WINDOW_DAYS) -> FactorisedTotals:
    """Totals of the usage of ``days`` days. Usage and tags are read once, reduced, and stored for the parts that need them."""
    tagged = tag_records(t, clock, DIMENSIONS).withColumn("_dim", _dimension())
    usage, tags = kept_together({"usage-totals": _reduced_usage(t, clock, days), "tag-records": tagged})
    nothing = t.spark.range(1).select(*(F.lit(None).cast("string").alias(name) for name in DIMENSIONS)).withColumn("_dim", _dimension())
    dims = kept(tags.select("_dim", *DIMENSIONS).unionByName(nothing).dropDuplicates(["_dim"]), "dimensions")
    return FactorisedTotals(t, _profile(clock, usage, tags), usage, tags.drop(*DIMENSIONS), dims)
