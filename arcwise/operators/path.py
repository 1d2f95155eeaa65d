"""Geometry of ordered 2-D paths: curvature, tangents, bisectors, peaks and spline knots.

All features of a point come from one pass over one windowed table: one join, one shuffle, one sort.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwise.functions import geometry as g
from arcwise.operators.series import MAX_ROWS, Series, split_series


@dataclass(frozen=True)
class PathColumns:
    """Which columns name a path, order its points and hold their position."""

    keys: tuple[str, ...] = ("animation_id", "effector_index")
    time: str = "time"
    tie: str = "frame_id"
    x: str = "effector_position_x"
    y: str = "effector_position_y"

    @property
    def order(self) -> tuple[str, str]:
        return self.time, self.tie

    @property
    def point(self) -> tuple[str, ...]:
        return *self.keys, self.tie, self.time


EFFECTOR_PATHS = PathColumns()


def path_points(effectors: DataFrame, frames: DataFrame) -> DataFrame:
    """Effectors with their frame's time. Effector 0 is left out: it only travels straight on.

    Frames grow with the effectors and are not to be broadcast, so the join is a merge.
    """
    frame = frames.select("animation_id", "frame_id", "time").hint("merge")
    return (
        effectors.filter(F.col("effector_index") != 0)
        .join(frame, ["animation_id", "frame_id"])
        .select(
            "animation_id",
            "effector_index",
            "frame_id",
            "time",
            "effector_position_x",
            "effector_position_y",
            "effector_orientation",
        )
    )


# -- per point ----------------------------------------------------------------------------------


def with_neighbours(
    points: DataFrame | Series, columns: PathColumns = EFFECTOR_PATHS, max_rows: int | None = MAX_ROWS
) -> Series:
    """Points as series, each with the position before (prev_x/_y) and after it (next_x/_y)."""
    series = split_series(points, columns.keys, columns.order, max_rows)
    return series.neighbours(
        previous={"prev_x": columns.x, "prev_y": columns.y},
        following={"next_x": columns.x, "next_y": columns.y},
    )


def _three_points(columns: PathColumns) -> tuple[Column, ...]:
    names = ("prev_x", "prev_y", columns.x, columns.y, "next_x", "next_y")
    return tuple(F.col(name) for name in names)


def curvature(columns: PathColumns = EFFECTOR_PATHS) -> Column:
    return g.curvature(*_three_points(columns))


def tangent(columns: PathColumns = EFFECTOR_PATHS) -> Column:
    return g.tangent(*_three_points(columns))


def directions(columns: PathColumns = EFFECTOR_PATHS) -> dict[str, Column]:
    """Unit directions from a point back to the one before and ahead to the one after."""
    prev_x, prev_y, x, y, next_x, next_y = _three_points(columns)
    back_x, back_y = g.unit(prev_x - x, prev_y - y)
    ahead_x, ahead_y = g.unit(next_x - x, next_y - y)
    return {"back_x": back_x, "back_y": back_y, "ahead_x": ahead_x, "ahead_y": ahead_y}


_DIRECTIONS = ("back_x", "back_y", "ahead_x", "ahead_y")


def curvatures(points: DataFrame | Series, columns: PathColumns = EFFECTOR_PATHS, max_rows=MAX_ROWS) -> DataFrame:
    series = with_neighbours(points, columns, max_rows)
    return series.table().select(*columns.point, curvature(columns).alias("curvature"))


def tangents(points: DataFrame | Series, columns: PathColumns = EFFECTOR_PATHS, max_rows=MAX_ROWS) -> DataFrame:
    series = with_neighbours(points, columns, max_rows)
    return series.table().select(*columns.point, tangent(columns).alias("tangent"))


def bisectors(points: DataFrame | Series, columns: PathColumns = EFFECTOR_PATHS, max_rows=MAX_ROWS) -> DataFrame:
    rows = with_neighbours(points, columns, max_rows).table().withColumns(directions(columns))
    x, y = g.bisector(*map(F.col, _DIRECTIONS))
    return rows.select(*columns.point, x.alias("bisector_x"), y.alias("bisector_y"))


def turning_angles(points: DataFrame | Series, columns: PathColumns = EFFECTOR_PATHS, max_rows=MAX_ROWS) -> DataFrame:
    """Angle between the directions back and ahead, its share of a half turn, and a weight."""
    rows = with_neighbours(points, columns, max_rows).table().withColumns(directions(columns))
    angle = rows.select(*columns.point, g.angle_between(*map(F.col, _DIRECTIONS)).alias("turning_angle"))
    ratio = F.col("turning_angle") / math.pi
    return angle.withColumns({"turning_ratio": ratio, "turning_weight": g.turning_weight(ratio)})


# -- peaks --------------------------------------------------------------------------------------


def _leveled(series: Series, digits: int | None) -> Series:
    """Adds the curvature as it is compared."""
    return series.with_columns({"level": g.rounded(F.col("curvature"), digits)})


def flag_extrema(series: Series, digits: int | None = None) -> Series:
    """Flags rows at the highest and at the lowest curvature of their series."""
    return (
        _leveled(series, digits)
        .totals({"max_curvature": F.max("level"), "min_curvature": F.min("level")})
        .with_columns(
            {
                "is_positive_peak": F.col("level") == F.col("max_curvature"),
                "is_negative_peak": F.col("level") == F.col("min_curvature"),
            }
        )
    )


def flag_crossovers(series: Series, digits: int | None = None) -> Series:
    """Flags rows whose curvature has the opposite sign of the row before; NULL on the first row."""
    return (
        _leveled(series, digits)
        .neighbours(previous={"level_before": "level"})
        .with_columns({"is_crossover": F.col("level") * F.col("level_before") < 0})
    )


def flag_peaks(series: Series, digits: int | None = None) -> Series:
    """All three flags and the label: positive before negative before crossover, else NULL."""
    label = (
        F.when(F.col("is_positive_peak"), "positive")
        .when(F.col("is_negative_peak"), "negative")
        .when(F.col("is_crossover"), "crossover")
    )
    settled = series.settle()
    return flag_crossovers(flag_extrema(settled, digits), digits).with_columns({"peak_type": label})


def _curved(points: DataFrame | Series, columns: PathColumns, max_rows: int | None) -> Series:
    series = with_neighbours(points, columns, max_rows)
    return series.select(*columns.point, curvature(columns).alias("curvature"))


def peaks(
    curved: DataFrame,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Labelled peaks and crossovers of a stored curvature table (with its time)."""
    series = flag_peaks(split_series(curved, columns.keys, columns.order, max_rows), digits)
    return series.table().filter(F.col("peak_type").isNotNull()).select(*columns.point, "peak_type")


def path_peaks(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Labelled peaks and crossovers straight from the points, without a second shuffle."""
    series = flag_peaks(_curved(points, columns, max_rows), digits)
    return series.table().filter(F.col("peak_type").isNotNull()).select(*columns.point, "peak_type")


# -- knots --------------------------------------------------------------------------------------


def bound(series: Series, columns: PathColumns = EFFECTOR_PATHS) -> Series:
    """Adds the time of the first positive peak, and of the first negative one from there on."""
    kind, time = F.col("peak_type"), F.col(columns.time)
    lower = F.min(F.when(kind == "positive", time))
    upper = F.min(F.when((kind == "negative") & (time >= F.col("lower_bound_time")), time))
    return series.totals({"lower_bound_time": lower}).totals({"upper_bound_time": upper})


def spline_bounds(
    peak_rows: DataFrame, columns: PathColumns = EFFECTOR_PATHS, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """One row per path with a positive peak: where its spline starts and, if it does, ends."""
    series = bound(split_series(peak_rows, columns.keys, columns.order, max_rows), columns)
    return (
        series.table()
        .groupBy(*columns.keys)
        .agg(F.max("lower_bound_time").alias("lower_bound_time"), F.max("upper_bound_time").alias("upper_bound_time"))
        .filter(F.col("lower_bound_time").isNotNull())
    )


def _inside(columns: PathColumns) -> Column:
    time = F.col(columns.time)
    return (time > F.col("lower_bound_time")) & (time < F.col("upper_bound_time"))


def path_knots(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Points strictly between the bounds of their path, numbered from 0, straight from the points."""
    series = bound(flag_peaks(_curved(points, columns, max_rows), digits), columns)
    return _number_knots(series, columns)


def _number_knots(series: Series, columns: PathColumns) -> DataFrame:
    numbered = series.filter(_inside(columns)).numbered("knot_index")
    return numbered.table().select(*columns.point, F.col("knot_index").cast("int").alias("knot_index"))


def knots(
    curved: DataFrame,
    peak_rows: DataFrame,
    columns: PathColumns = EFFECTOR_PATHS,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Knots from stored tables: every sampled point of the paths, and their peaks.

    NULL keys match NULL keys, as they do in a window.
    """
    bounds = spline_bounds(peak_rows, columns, max_rows)
    bounds = bounds.withColumnsRenamed({name: f"bounds_{name}" for name in columns.keys})
    same = F.lit(True)
    for name in columns.keys:
        same = same & F.col(name).eqNullSafe(F.col(f"bounds_{name}"))
    inside = curved.join(bounds, same).filter(_inside(columns)).drop(*[f"bounds_{name}" for name in columns.keys])
    return _number_knots(split_series(inside, columns.keys, columns.order, max_rows), columns)


# -- all at once --------------------------------------------------------------------------------


def feature_series(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> Series:
    """Every point with curvature, tangent, bisector and peak label, in one pass."""
    series = with_neighbours(points, columns, max_rows).with_columns(directions(columns))
    x, y = g.bisector(*map(F.col, _DIRECTIONS))
    series = series.select(
        *columns.point,
        columns.x,
        columns.y,
        curvature(columns).alias("curvature"),
        tangent(columns).alias("tangent"),
        x.alias("bisector_x"),
        y.alias("bisector_y"),
    )
    flagged = flag_peaks(series, digits)
    dropped = ("level", "level_before", "max_curvature", "min_curvature")
    return flagged.drop(*dropped)


def feature_table(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    return feature_series(points, columns, digits, max_rows).table()


class PathTables(dict[str, DataFrame]):
    """The five stored outputs by name, all read from one shared set of rows until ``release``."""

    def __init__(self, shared: list[DataFrame], tables: dict[str, DataFrame]):
        super().__init__(tables)
        self._shared = shared

    def release(self) -> None:
        for rows in self._shared:
            rows.unpersist()


def path_tables(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> PathTables:
    """Curvatures, peaks, tangents, bisectors and knots, for writing out one after the other."""
    series = bound(feature_series(points, columns, digits, max_rows), columns)
    # Kept on disk, so memory is no limit; partitions lost with an executor are computed again.
    kept = [rows.persist(StorageLevel.DISK_ONLY) for rows in (series.whole, series.cut) if rows is not None]
    shared = Series(kept[0], series.keys, series.order, *kept[1:])
    rows, key = shared.table(), [*columns.keys, columns.tie]
    return PathTables(
        kept,
        {
            "curvatures": rows.select(*key, "curvature"),
            "peaks": rows.filter(F.col("peak_type").isNotNull()).select(*key, "peak_type"),
            "tangents": rows.select(*key, "tangent"),
            "bisectors": rows.select(*key, "bisector_x", "bisector_y"),
            "knots": _number_knots(shared, columns).select(*key, "knot_index"),
        },
    )


# The five outputs and the columns each has beside the key of a point.
OUTPUTS = {
    "curvatures": ("curvature",),
    "peaks": ("peak_type",),
    "tangents": ("tangent",),
    "bisectors": ("bisector_x", "bisector_y"),
    "knots": ("knot_index",),
}


def path_outputs(
    points: DataFrame | Series,
    columns: PathColumns = EFFECTOR_PATHS,
    digits: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """The five outputs stacked, for ``outputs.write_outputs``: a point's key, ``output`` and the output's columns.

    Knots are the points of one stretch of time, so their numbers follow from their places on the path; nothing
    is filtered and numbered again, and all outputs come out of one pass.
    """
    series = bound(feature_series(points, columns, digits, max_rows), columns).numbered("position")
    series = series.totals({"first_knot": F.min(F.when(_inside(columns), F.col("position")))})
    values = {
        "curvature": F.col("curvature"),
        "peak_type": F.col("peak_type"),
        "tangent": F.col("tangent"),
        "bisector_x": F.col("bisector_x"),
        "bisector_y": F.col("bisector_y"),
        "knot_index": (F.col("position") - F.col("first_knot")).cast("int"),
    }
    rows = series.table().select(*columns.keys, columns.tie, _inside(columns).alias("is_knot"), *[v.alias(n) for n, v in values.items()])
    kinds = {field.name: field.dataType for field in rows.schema}

    def output(name: str) -> Column:
        own = [F.col(n) if n in OUTPUTS[name] else F.lit(None).cast(kinds[n]) for n in values]
        return F.struct(F.lit(name).alias("output"), *[value.alias(n) for n, value in zip(values, own)])

    wanted = {"peaks": F.col("peak_type").isNotNull(), "knots": F.col("is_knot")}
    every = F.array(*[F.when(wanted[name], output(name)) if name in wanted else output(name) for name in OUTPUTS])
    stacked = rows.select(*columns.keys, columns.tie, F.explode(F.filter(every, lambda one: one.isNotNull())).alias("one"))
    return stacked.select(*columns.keys, columns.tie, "one.*")
