"""Tables behind pictures of paths: lines, poses, segments, phases and whiskers, for all animations.

Nested results are cut into pages of bounded size. A line or animation that fits one page comes out
as one row with page 0; a longer one goes on in pages 1, 2, ... and nothing is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwise.functions.arrays import ordered_list
from arcwise.operators.path import EFFECTOR_PATHS, PathColumns
from arcwise.operators.series import MAX_ROWS, Series, split_series

PAGE_POINTS = 4096
PAGE_LINES = 64

LOWER, UPPER = "positive", "negative"


# -- joining features back ----------------------------------------------------------------------


def fan_in(
    points: DataFrame,
    features: list[DataFrame],
    on: list[str],
    coarse: DataFrame | None = None,
    coarse_on: list[str] | None = None,
) -> DataFrame:
    """Stored feature tables beside their points, by one shuffle of all tables stacked, without a join.

    Points stay, with NULLs where a table has no row of their key; features without a point go. A key
    has at most one row per feature table. ``coarse`` is a further table whose key ``coarse_on``, the first
    columns of ``on``, is shared by many points. Points with a NULL in their key meet nothing and are not
    shuffled. Where features can still be computed from the points, ``path.feature_table`` needs none of this.
    """
    tables = [(table, on) for table in features] + ([(coarse, coarse_on)] if coarse is not None else [])
    added = [(field, key) for table, key in tables for field in table.schema if field.name not in key]
    empty = [F.lit(None).cast(field.dataType).alias(field.name) for field, _ in added]
    keyless = ~reduce(lambda a, b: a & b, [F.col(name).isNotNull() for name in on])
    source, shared = F.lit(0).alias("source_"), coarse_on or on
    stacked = [points.filter(~keyless).select("*", *empty, source)]
    for number, (table, _) in enumerate(tables, 1):
        stacked.append(table.withColumn("source_", F.lit(number)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked).repartition(*shared)
    # Rows of the shorter key lie together, and so do those of the longer one: all windows share this shuffle.
    for key in ([on, shared] if coarse is not None else [on]):
        whole = Window.partitionBy(*key)
        named = [field.name for field, own in added if own == key]
        rows = rows.withColumns({name: F.first(name, ignorenulls=True).over(whole) for name in named})
    placed = rows.filter("source_ = 0").drop("source_")
    return placed.unionByName(points.filter(keyless).select("*", *empty))


def effector_features(effectors: DataFrame, frames: DataFrame, features: list[DataFrame]) -> DataFrame:
    """Every effector with its time, its frame's place and all path features; its position is named x, y."""
    key = ["animation_id", "frame_id", "effector_index"]
    points = effectors.withColumnsRenamed({"effector_position_x": "x", "effector_position_y": "y"})
    times = frames.select("animation_id", "frame_id", "time", "frame_index")
    return fan_in(points, features, key, times, key[:2])


def normalise_curvature(
    features: DataFrame, columns: PathColumns = EFFECTOR_PATHS, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Adds |curvature| as a share of the largest one on the path; 0 on a path without any."""
    largest = F.max(F.abs("curvature"))
    series = split_series(features, columns.keys, columns.order, max_rows).totals({"largest": largest})
    share = F.when(F.col("largest") != 0, F.abs("curvature") / F.col("largest")).otherwise(0.0)
    return series.table().withColumn("curvature_normalised", share).drop("largest")


# -- nested lines and poses ---------------------------------------------------------------------


def _paged(points: DataFrame, page_points: int, page_lines: int) -> DataFrame:
    # Both levels of grouping below then run within these partitions, after a single shuffle.
    page = ["animation_id", "line_page", "point_page"]
    return points.withColumns(
        {
            "line_page": F.floor(F.col("effector_index") / page_lines).cast("int"),
            "point_page": F.floor(F.col("frame_index") / page_points).cast("int"),
        }
    ).repartition(*page)


def polylines(
    points: DataFrame, fields: list[str], page_points: int = PAGE_POINTS, page_lines: int = PAGE_LINES
) -> DataFrame:
    """Per animation ``lines``: the path of each effector, its points by time.

    Needs animation_id, effector_index, frame_index, time and the ``fields`` to keep per point.
    """
    page = ["animation_id", "line_page", "point_page"]
    lines = (
        _paged(points, page_points, page_lines)
        .groupBy(*page, "effector_index")
        .agg(ordered_list(["time", "frame_index"], list(map(F.col, fields))).alias("points"))
    )
    line = [F.col("effector_index"), F.col("points")]
    return lines.groupBy(*page).agg(ordered_list(["effector_index"], line).alias("lines"))


def poses(
    points: DataFrame, fields: list[str], page_points: int = PAGE_POINTS, page_lines: int = PAGE_LINES
) -> DataFrame:
    """Per animation ``lines``: the pose at each frame by time, its points by effector."""
    page = ["animation_id", "line_page", "point_page"]
    frames = (
        _paged(points, page_points, page_lines)
        .groupBy(*page, "time", "frame_index")
        .agg(ordered_list(["effector_index"], list(map(F.col, fields))).alias("points"))
    )
    frame = [F.col("time"), F.col("points")]
    return frames.groupBy(*page).agg(ordered_list(["time", "frame_index"], frame).alias("lines"))


def unnest_lines(lines: DataFrame) -> DataFrame:
    """One row per point of polylines or poses, with the places of line and point."""
    kept = [name for name in lines.columns if name != "lines"]
    opened = lines.select(*kept, F.posexplode_outer("lines").alias("line_position", "line"))
    label = [name for name in opened.schema["line"].dataType.names if name != "points"]
    return opened.select(
        *kept,
        "line_position",
        *[F.col(f"line.{name}").alias(name) for name in label],
        F.posexplode_outer("line.points").alias("point_position", "point"),
    ).select(*kept, "line_position", *label, "point_position", "point.*")


def series_pages(series: Series, fields: list[str], page_points: int = PAGE_POINTS) -> DataFrame:
    """Every series as pages of ordered points: the keys, ``page``, ``points``."""
    numbered = series.numbered("position").table()
    return (
        numbered.withColumn("page", F.floor(F.col("position") / page_points).cast("int"))
        .groupBy(*series.keys, "page")
        .agg(ordered_list(["position"], list(map(F.col, fields))).alias("points"))
    )


def curvature_series(
    frames: DataFrame,
    curvatures: DataFrame,
    peaks: DataFrame,
    max_rows: int | None = MAX_ROWS,
    page_points: int = PAGE_POINTS,
) -> DataFrame:
    """Time, curvature and peak label of each path's points, by time."""
    point = [*EFFECTOR_PATHS.keys, "frame_id"]
    marks = peaks.select(*point, "peak_type").hint("merge")
    # Starts from the measured points: one without a peak stays, a frame without points gives no row.
    labelled = curvatures.select(*point, "curvature").join(marks, point, "left").join(frames, ["animation_id", "frame_id"])
    series = split_series(labelled, EFFECTOR_PATHS.keys, EFFECTOR_PATHS.order, max_rows)
    return series_pages(series, ["time", "curvature", "peak_type"], page_points)


def unnest_pages(pages: DataFrame) -> DataFrame:
    kept = [name for name in pages.columns if name != "points"]
    return pages.select(*kept, F.posexplode_outer("points").alias("point_position", "point")).select(
        *kept, "point_position", "point.*"
    )


# -- segments and phases ------------------------------------------------------------------------


def segments(
    points: DataFrame,
    keys: tuple[str, ...],
    order: tuple[str, ...],
    x: str,
    y: str,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Straight pieces between consecutive points, along a path or along a pose.

    The last column of ``order`` must not be NULL; it tells whether there is a next point.
    """
    series = split_series(points.select(*keys, *order, x, y), keys, order, max_rows)
    series = series.neighbours(following={"x1": x, "y1": y, "next_point": order[-1]})
    return (
        series.table()
        .filter(F.col("next_point").isNotNull())
        .select(*keys, *order, F.col(x).alias("x0"), F.col(y).alias("y0"), "x1", "y1")
    )


def path_segments(points: DataFrame, columns: PathColumns = EFFECTOR_PATHS, max_rows=MAX_ROWS) -> DataFrame:
    return segments(points, columns.keys, columns.order, columns.x, columns.y, max_rows)


def pose_segments(effectors: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    return segments(
        effectors,
        ("animation_id", "frame_id"),
        ("effector_index",),
        "effector_position_x",
        "effector_position_y",
        max_rows,
    )


def _first_bounds(labelled: Series) -> Series:
    """Adds each row's position and the positions of the first bounds of its path.

    "Was there a bound among the points so far" is then a comparison with the first one's position.
    """
    position, kind = F.col("position"), F.col("peak_type")
    return labelled.numbered("position").totals(
        {
            "first_lower": F.min(F.when(kind == LOWER, position)),
            "first_upper": F.min(F.when(kind == UPPER, position)),
            "later_upper": F.min(F.when((kind == UPPER) & (position > 0), position)),
            "last_position": F.max(position),
        }
    )


def _reached(first: str, position: Column) -> Column:
    return F.coalesce(F.col(first) <= position, F.lit(False))


def _phases(
    labelled: DataFrame, columns: PathColumns, max_rows: int | None, lower: Column, upper: Column, weight: Column
) -> DataFrame:
    series = split_series(labelled, columns.keys, columns.order, max_rows)
    rows = _first_bounds(series).table().withColumns({"after_lower": lower, "after_upper": upper})
    return rows.withColumn("weight", weight).select(
        *columns.point, "position", "last_position", "after_lower", "after_upper", "weight"
    )


def _faded(flag: str, by: float) -> Column:
    return F.when(F.col(flag), F.lit(by)).otherwise(F.lit(1.0))


def _unless(flag: str, by: float) -> Column:
    return F.when(F.col(flag), F.lit(1.0)).otherwise(F.lit(by))


def _segments_only(phases: DataFrame) -> DataFrame:
    return phases.filter(F.col("position") < F.col("last_position")).drop("last_position")


def curve_segment_phases(
    labelled: DataFrame, columns: PathColumns = EFFECTOR_PATHS, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Segments of a curvature curve: a lower bound at its start counts, an upper one at point 0 does not."""
    position = F.col("position")
    weight = _unless("after_lower", 0.4) * _faded("after_upper", 0.4)
    lower, upper = _reached("first_lower", position), _reached("later_upper", position)
    return _segments_only(_phases(labelled, columns, max_rows, lower, upper, weight))


def path_segment_phases(
    labelled: DataFrame, columns: PathColumns = EFFECTOR_PATHS, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Segments of a path: the first one lies before both bounds, whatever its points are."""
    position = F.col("position")
    weight = _unless("after_lower", 0.1) * _faded("after_upper", 0.1)
    started = position >= 1
    lower = started & _reached("first_lower", position)
    upper = started & _reached("first_upper", position)
    return _segments_only(_phases(labelled, columns, max_rows, lower, upper, weight))


def point_phases(
    labelled: DataFrame, columns: PathColumns = EFFECTOR_PATHS, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Points of a path: both bounds themselves still belong to the stretch between them."""
    position = F.col("position")
    lower, upper = _reached("first_lower", position), _reached("first_upper", position - 1)
    outside = ~F.col("after_lower") | F.col("after_upper")
    weight = F.when(outside, 0.1).otherwise(1.0)
    return _phases(labelled, columns, max_rows, lower, upper, weight).drop("last_position")


# -- whiskers and ids ---------------------------------------------------------------------------

POINT_WHISKER = 0.1
PEAK_WHISKER = 0.2


def whiskers(
    features: DataFrame,
    columns: PathColumns = EFFECTOR_PATHS,
    length: float = POINT_WHISKER,
    peaks_only: bool = False,
    scale: Column | None = None,
) -> DataFrame:
    """A short line from each point against its bisector; on peaks only, crossovers have none."""
    scale = F.lit(1.0) if scale is None else scale
    kept = F.col("bisector_x").isNotNull() & F.col("bisector_y").isNotNull()
    if peaks_only:
        kept = kept & F.col("peak_type").isin(LOWER, UPPER)
    x, y = F.col(columns.x), F.col(columns.y)
    return features.filter(kept).select(
        *columns.point,
        x.alias("x0"),
        y.alias("y0"),
        (x - F.col("bisector_x") * length * scale).alias("x1"),
        (y - F.col("bisector_y") * length * scale).alias("y1"),
    )


def animation_ids(peaks: DataFrame) -> DataFrame:
    return peaks.select("animation_id").distinct()
