"""Many ordered series in one table, safe for series of any length.

A window partitioned by the series key runs each series in one task. That is the right plan while
series are short, and wrong once a single key holds a large share of all rows. ``split_series``
measures the key sizes first (one pass over the key columns with partial aggregation). If no series
is over the limit, plain windows are all there is. Otherwise the rows of long series go their own
way: they are cut into chunks at values chosen from an even spread of their own rows, and windows
run per (series, chunk). What a chunk must know of its siblings (edge rows, totals, row counts) is
aggregated into a table with at most one row per chunk and joined back.

How large the side tables get: at most ``MAX_CUTS`` series are cut, into no more than about twice
``MAX_CUTS`` chunks in total, whatever the data size. That bound is why they may be broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from arcwise.session import scratch_root

CHUNK = "series_chunk"

MAX_ROWS = 4_000_000  # longest series left in one piece
MAX_CUTS = 100_000  # series that may be cut; chunks of all of them stay within about twice this
MAX_PIECES = 4096  # chunks of one series
PROBES = 32  # rows looked at per chunk


def _match(rows: DataFrame, side: DataFrame, on: tuple[str, ...], how: str) -> DataFrame:
    """Join a side table of bounded size; NULL keys match NULL keys, as they do in a window."""
    renamed = side.withColumnsRenamed({name: f"side_{name}" for name in on})
    condition = F.lit(True)
    for name in on:
        condition = condition & rows[name].eqNullSafe(renamed[f"side_{name}"])
    return rows.join(F.broadcast(renamed), condition, how).drop(*[f"side_{name}" for name in on])


@dataclass(frozen=True)
class Series:
    """Rows of many series: ``whole`` ones, and those ``cut`` into chunks numbered by ``CHUNK``."""

    whole: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    cut: DataFrame | None = None

    def _map(self, change: Callable[[DataFrame], DataFrame]) -> Series:
        return replace(
            self, whole=change(self.whole), cut=None if self.cut is None else change(self.cut)
        )

    def select(self, *columns: str | Column) -> Series:
        return replace(
            self,
            whole=self.whole.select(*columns),
            cut=None if self.cut is None else self.cut.select(*columns, CHUNK),
        )

    def with_columns(self, columns: Mapping[str, Column]) -> Series:
        return self._map(lambda rows: rows.withColumns(dict(columns)))

    def filter(self, condition: Column) -> Series:
        return self._map(lambda rows: rows.filter(condition))

    def drop(self, *columns: str) -> Series:
        return self._map(lambda rows: rows.drop(*columns))

    def settle(self) -> Series:
        """Write out the rows of cut series, so that the side tables to come do not redo the work."""
        return self if self.cut is None else replace(self, cut=self.cut.checkpoint())

    def table(self) -> DataFrame:
        return self.whole if self.cut is None else self.whole.unionByName(self.cut.drop(CHUNK))

    # -- windows over one piece: a whole series, or a chunk --

    def _pieces(self) -> tuple[WindowSpec, WindowSpec]:
        return Window.partitionBy(*self.keys), Window.partitionBy(*self.keys, CHUNK)

    def _by_chunk(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)

    def neighbours(
        self, previous: Mapping[str, str] | None = None, following: Mapping[str, str] | None = None
    ) -> Series:
        """Add columns of the row before and the row after: {new name: source column}."""
        previous, following = dict(previous or {}), dict(following or {})
        series_window, chunk_window = (piece.orderBy(*self.order) for piece in self._pieces())

        def shifted(window: WindowSpec) -> dict[str, Column]:
            before = {name: F.lag(source).over(window) for name, source in previous.items()}
            return before | {name: F.lead(source).over(window) for name, source in following.items()}

        whole = self.whole.withColumns(shifted(series_window))
        if self.cut is None:
            return replace(self, whole=whole)

        # First and last row of every chunk, moved on to the chunk after and before it.
        place, is_row = F.struct(*self.order), F.lit(1).alias("row")
        ends = self.cut.groupBy(*self.keys, CHUNK).agg(
            F.max_by(F.struct(is_row, *previous.values()), place).alias("last"),
            F.min_by(F.struct(is_row, *following.values()), place).alias("first"),
        )
        edges = ends.select(
            *self.keys,
            CHUNK,
            F.lag("last").over(self._by_chunk()).alias("edge_before"),
            F.lead("first").over(self._by_chunk()).alias("edge_after"),
        )
        inside = shifted(chunk_window)
        if previous:
            inside["at_start"] = F.lag(F.lit(1)).over(chunk_window).isNull()
        if following:
            inside["at_end"] = F.lead(F.lit(1)).over(chunk_window).isNull()
        patched = {
            name: F.when(F.col("at_start"), F.col("edge_before")[source]).otherwise(F.col(name))
            for name, source in previous.items()
        } | {
            name: F.when(F.col("at_end"), F.col("edge_after")[source]).otherwise(F.col(name))
            for name, source in following.items()
        }
        cut = _match(self.cut.withColumns(inside), edges, (*self.keys, CHUNK), "left")
        cut = cut.withColumns(patched).drop("at_start", "at_end", "edge_before", "edge_after")
        return replace(self, whole=whole, cut=cut)

    def totals(self, aggregates: Mapping[str, Column]) -> Series:
        """Add per-series aggregates to every row."""
        window, _ = self._pieces()
        whole = self.whole.withColumns({name: value.over(window) for name, value in aggregates.items()})
        if self.cut is None:
            return replace(self, whole=whole)
        side = self.cut.groupBy(*self.keys).agg(*[v.alias(name) for name, v in aggregates.items()])
        return replace(self, whole=whole, cut=_match(self.cut, side, self.keys, "left"))

    def numbered(self, name: str) -> Series:
        """Add the 0-based position of each row in its series (BIGINT)."""
        series_window, chunk_window = (piece.orderBy(*self.order) for piece in self._pieces())
        place = F.row_number().over(series_window) - 1
        whole = self.whole.withColumn(name, place.cast("bigint"))
        if self.cut is None:
            return replace(self, whole=whole)
        earlier = self._by_chunk().rowsBetween(Window.unboundedPreceding, -1)
        offsets = (
            self.cut.groupBy(*self.keys, CHUNK)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(*self.keys, CHUNK, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
        )
        local = F.row_number().over(chunk_window) - 1
        cut = _match(self.cut.withColumn(name, local.cast("bigint")), offsets, (*self.keys, CHUNK), "left")
        return replace(
            self, whole=whole, cut=cut.withColumn(name, F.col(name) + F.col("rows_before")).drop("rows_before")
        )


def split_series(
    points: DataFrame | Series,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    max_rows: int | None = MAX_ROWS,
) -> Series:
    """Wrap ``points`` as series, cutting those longer than ``max_rows`` into chunks.

    ``max_rows=None`` skips the measuring pass, for data known to hold short series only. What is
    split already is taken as it is, so several analyses of the same points can share one split.
    """
    if isinstance(points, Series):
        return points
    keys, order = tuple(keys), tuple(order)
    if max_rows is None:
        return Series(points, keys, order)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_rows)
    total = sizes.agg(F.sum("n")).first()[0]
    if total is None:
        return Series(points, keys, order)

    # With more data the limit rises, so no more than MAX_CUTS series can be over it.
    limit = max(max_rows, math.ceil(total / MAX_CUTS))
    cuts = _cut_points(points, sizes.filter(F.col("n") > limit), keys, order, limit)
    place = F.struct(*order)
    # Two steps of search: which group of marks the row falls in, then which mark of that group.
    group = F.size(F.filter("heads", lambda head: head <= place))
    within = F.size(F.filter(F.col("groups")[group - 1], lambda mark: mark <= place))
    chunk = F.when(group == 0, 0).otherwise((group - 1) * F.col("width") + within)
    cut = (
        _match(points, cuts, keys, "inner")
        .select(*points.columns, chunk.alias(CHUNK))
        .repartition(*keys, CHUNK)
    )
    return Series(_match(points, cuts.select(*keys), keys, "left_anti"), keys, order, cut)


def _cut_points(
    points: DataFrame, sizes: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], limit: int
) -> DataFrame:
    """Where to cut each long series: ``groups`` of ascending marks, and the ``heads`` of the groups.

    Marks are rows of the series itself, so ties in time are told apart like everywhere else. They
    only decide where chunks begin; every row stays in the data. At most about
    MAX_PIECES * PROBES short structs are gathered for one series.
    """
    scratch_root(points.sparkSession)
    pieces = F.least(F.ceil(F.col("n") / F.lit(max(limit // 2, 1))), F.lit(MAX_PIECES)).cast("int")
    sizes = sizes.withColumn("pieces", pieces).withColumn(
        "stride", F.greatest(F.expr(f"n div (pieces * {PROBES})"), F.lit(1))
    )
    probes = _match(points.select(*keys, *order), sizes, keys, "inner").filter(
        F.pmod(F.xxhash64(*keys, *order), F.col("stride")) == 0
    )
    step = F.greatest(F.expr("size(probes) div pieces"), F.lit(1))
    width = F.ceil(F.sqrt(F.size("marks"))).cast("int")
    groups = F.transform(
        F.sequence(F.lit(0), F.expr("(size(marks) - 1) div width")),
        lambda g: F.slice("marks", g * F.col("width") + 1, F.col("width")),
    )
    return (
        probes.groupBy(*keys)
        .agg(F.array_sort(F.collect_set(F.struct(*order))).alias("probes"), F.max("pieces").alias("pieces"))
        .select(*keys, F.filter("probes", lambda _, i: (i + 1) % step == 0).alias("marks"))
        .filter(F.size("marks") > 0)
        .withColumn("width", width)
        .select(*keys, "width", groups.alias("groups"))
        .withColumn("heads", F.transform("groups", lambda g: g[0]))
        .checkpoint()
    )
