"""Samples of a path kept as state: pages of ordered samples, their curvatures, and folding in of new ones.

A state of a path is a set of pages of at most ``page_samples`` samples each. A page holds

* ``first_sample``: the number of its first sample on the path,
* ``sample_ids``, ``sample_moments``, ``sample_positions``: its samples by time and tie,
* ``curvature_sample_indices``: for each curvature the numbers of the three samples that form it,
* ``curvatures`` and ``curvature_magnitudes``: its value with and without sign.

A curvature lies on the page of its middle sample; it is NULL where the step before has no length. The ends
of a path have none. New samples only rewrite the pages from the first one they touch.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arcwise.functions import geometry as g
from arcwise.functions.arrays import ordered_list
from arcwise.operators.path import EFFECTOR_PATHS, PathColumns, curvature
from arcwise.operators.series import MAX_ROWS, Series, split_series

PAGE_SAMPLES = 4096


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [left[name].eqNullSafe(right[f"side_{name}"]) for name in keys])


def _beside(rows: DataFrame, side: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """``rows`` with the columns of ``side``, which has one row per path; NULL keys meet NULL keys."""
    side = side.withColumnsRenamed({name: f"side_{name}" for name in keys})
    return rows.join(side, _same(rows, side, keys), how).drop(*[f"side_{name}" for name in keys])


def _measured(points: DataFrame, columns: PathColumns, max_rows: int | None) -> Series:
    """Points with ``is_inner``, their ``curvature`` where both neighbours have a place, and their number ``local``."""
    series = split_series(points.withColumn("row_", F.lit(1)), columns.keys, columns.order, max_rows)
    series = series.neighbours(
        previous={"prev_x": columns.x, "prev_y": columns.y, "row_before": "row_"},
        following={"next_x": columns.x, "next_y": columns.y, "row_after": "row_"},
    )
    placed = F.col("prev_x").isNotNull() & F.col("next_x").isNotNull()
    return series.with_columns(
        {
            "is_inner": F.col("row_before").isNotNull() & F.col("row_after").isNotNull(),
            "curvature": F.when(placed, curvature(columns)),
        }
    ).numbered("local")


def _pages(rows: DataFrame, columns: PathColumns, page_samples: int) -> DataFrame:
    """Pages of measured rows with their number on the path, ``position``."""
    rows = rows.withColumn("page", F.floor(F.col("position") / page_samples).cast("int"))
    fields = [
        F.col("position"),
        F.col(columns.tie).alias("id"),
        F.col(columns.time).alias("moment"),
        F.struct(F.col(columns.x).alias("x"), F.col(columns.y).alias("y")).alias("place"),
        F.col("is_inner"),
        F.col("curvature"),
    ]
    paged = rows.groupBy(*columns.keys, "page").agg(ordered_list(["position"], fields).alias("samples"))
    curved = F.filter("samples", lambda s: s["is_inner"])
    return paged.withColumn("curved", curved).select(
        *columns.keys,
        "page",
        (F.col("page").cast("bigint") * page_samples).alias("first_sample"),
        F.transform("samples", lambda s: s["id"]).alias("sample_ids"),
        F.transform("samples", lambda s: s["moment"]).alias("sample_moments"),
        F.transform("samples", lambda s: s["place"]).alias("sample_positions"),
        F.transform("curved", lambda s: F.array(s["position"] - 1, s["position"], s["position"] + 1)).alias(
            "curvature_sample_indices"
        ),
        F.transform("curved", lambda s: s["curvature"]).alias("curvatures"),
        F.transform("curved", lambda s: F.abs(s["curvature"])).alias("curvature_magnitudes"),
    )


def state_samples(
    points: DataFrame,
    columns: PathColumns = EFFECTOR_PATHS,
    page_samples: int = PAGE_SAMPLES,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """The pages of every path, from all its points; one shuffle by path."""
    rows = _measured(points, columns, max_rows).table().withColumnRenamed("local", "position")
    return _pages(rows, columns, page_samples)


def _first_changed(pages: DataFrame, added: DataFrame, columns: PathColumns) -> DataFrame:
    """Per path with new samples the first page that they touch: ``from_page``, NULL for a new path.

    A page ends where the next one starts, and its last curvature reaches to that start. So a page stays
    when the next page's first sample comes before all new ones. Only first samples are looked at.
    """
    key = list(columns.keys)
    first_new = added.groupBy(*key).agg(
        F.min(F.struct(F.col(columns.time).alias("moment"), F.col(columns.tie).alias("id"))).alias("first_new")
    )
    head = F.struct(F.get("sample_moments", F.lit(0)).alias("moment"), F.get("sample_ids", F.lit(0)).alias("id"))
    next_head = F.lead("head").over(Window.partitionBy(*key).orderBy("page"))
    heads = pages.select(*key, "page", head.alias("head")).withColumn("next_head", next_head)
    touched = _beside(heads, first_new, columns.keys, "inner").filter(
        F.col("next_head").isNull() | (F.col("next_head") >= F.col("first_new"))
    )
    starts = touched.groupBy(*key).agg(F.min("page").alias("from_page"))
    return _beside(first_new.select(*key), starts, columns.keys, "left")


def fold_samples(
    pages: DataFrame,
    added: DataFrame,
    columns: PathColumns = EFFECTOR_PATHS,
    page_samples: int = PAGE_SAMPLES,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """The pages after new points came in: the same rows as ``state_samples`` over old and new points.

    ``pages`` is a stored state made with the same ``page_samples``. Pages before the first touched one stay
    as they are; the others are opened, with the one sample before them as a neighbour, and made anew.
    A sample that comes again counts again.
    """
    key = list(columns.keys)
    marked = _beside(pages, _first_changed(pages, added, columns).withColumn("is_new", F.lit(True)), columns.keys, "left")
    kept = marked.filter(F.col("is_new").isNull() | (F.col("page") < F.col("from_page"))).select(*pages.columns)
    opened = marked.filter(F.col("page") >= F.col("from_page") - 1).select(
        *key,
        (F.col("page") < F.col("from_page")).alias("is_before"),
        (F.size("sample_ids") - 1).alias("last"),
        "first_sample",
        F.posexplode(F.arrays_zip("sample_ids", "sample_moments", "sample_positions")).alias("at", "sample"),
    )
    opened = opened.filter(~F.col("is_before") | (F.col("at") == F.col("last")))
    place = {
        columns.tie: F.col("sample.sample_ids"),
        columns.time: F.col("sample.sample_moments"),
        columns.x: F.col("sample.sample_positions.x"),
        columns.y: F.col("sample.sample_positions.y"),
    }
    before = F.when(F.col("is_before"), F.col("first_sample") + F.col("at")).alias("place_before")
    old = opened.select(*key, *[value.alias(name) for name, value in place.items()], before)
    new = added.select(*key, *place, F.lit(None).cast("bigint").alias("place_before"))
    series = _measured(old.unionByName(new), columns, max_rows).totals({"start": F.max("place_before")})
    rows = series.table().withColumn("position", F.col("local") + F.coalesce("start", F.lit(0).cast("bigint")))
    return kept.unionByName(_pages(rows.filter(F.col("place_before").isNull()), columns, page_samples))


def unnest_samples(pages: DataFrame, columns: PathColumns = EFFECTOR_PATHS) -> DataFrame:
    """One row per sample: its number and place, and the three samples and size of the curvature at it, if any."""
    rows = pages.select(
        *columns.keys,
        "page",
        "first_sample",
        F.coalesce(F.get(F.get("curvature_sample_indices", F.lit(0)), F.lit(1)), F.lit(0)).alias("first_curved"),
        "curvature_sample_indices",
        "curvature_magnitudes",
        F.posexplode(F.arrays_zip("sample_ids", "sample_moments", "sample_positions")).alias("at", "sample"),
    )
    number = F.col("first_sample") + F.col("at")
    # Curvatures are those of successive samples, so a sample's place among them follows from the first.
    place = (number - F.col("first_curved")).cast("int")
    trio = F.get("curvature_sample_indices", place)
    return rows.select(
        *columns.keys,
        "page",
        number.alias("sample_index"),
        F.col("sample.sample_ids").alias("sample_id"),
        F.col("sample.sample_moments").alias("moment"),
        F.col("sample.sample_positions.x").alias("x"),
        F.col("sample.sample_positions.y").alias("y"),
        F.get(trio, F.lit(0)).alias("from_sample"),
        F.get(trio, F.lit(2)).alias("to_sample"),
        F.get("curvature_magnitudes", place).alias("curvature_magnitude"),
    )


def sample_features(
    pages: DataFrame, columns: PathColumns = EFFECTOR_PATHS, digits: int | None = None
) -> DataFrame:
    """``state.state_features`` from stored pages, without the geometry: one row per path.

    Each page is summed up on its own row; a change of sign between two pages is seen from the last
    curvature of the page before, so only a few values per page are shuffled.
    """
    moments = F.col("sample_moments")
    level = F.transform("curvatures", lambda value: g.rounded(value, digits))
    curved = F.transform(
        F.arrays_zip(level.alias("level"), F.col("curvature_sample_indices").alias("trio")),
        lambda c: F.struct(
            c["level"].alias("level"),
            F.get(moments, (F.get(c["trio"], F.lit(1)) - F.col("first_sample")).cast("int")).alias("moment"),
        ),
    )

    def crossing(before: Column, now: Column) -> Column:
        size, size_before = F.abs(now["level"]), F.abs(before["level"])
        at = before["moment"] + (now["moment"] - before["moment"]) * (size_before / (size_before + size))
        return F.when(now["level"] * before["level"] < 0, at)

    last = F.get("curved", F.size("curved") - 1)
    inside = F.filter(
        F.transform("curved", lambda c, i: crossing(F.get("curved", i - 1), c)), lambda value: value.isNotNull()
    )
    short = pages.withColumn("curved", curved).select(
        *columns.keys,
        "page",
        F.size("sample_ids").alias("samples"),
        F.size(F.filter("curvatures", lambda value: value.isNotNull())).alias("known"),
        F.array_min("curvature_magnitudes").alias("lowest"),
        F.get("curved", F.lit(0)).alias("head"),
        last.alias("tail"),
        F.get(inside, F.lit(0)).alias("within"),
    )
    tail_before = F.lag("tail").over(Window.partitionBy(*columns.keys).orderBy("page"))
    short = short.withColumn("tail_before", tail_before)
    first = F.coalesce(crossing(F.col("tail_before"), F.col("head")), F.col("within"))
    short = short.withColumn("crossing", first)
    return short.groupBy(*columns.keys).agg(
        F.sum("samples").alias("sample_count"),
        F.sum("known").alias("curvature_count"),
        F.min("lowest").alias("lowest_curvature_magnitude"),
        F.bool_or(F.col("crossing").isNotNull()).alias("curvature_sign_change"),
        F.min_by("crossing", F.when(F.col("crossing").isNotNull(), F.col("page"))).alias("guessed_zero_crossing"),
    )


def state_pages(pages: DataFrame, features: DataFrame, columns: PathColumns = EFFECTOR_PATHS) -> DataFrame:
    """The whole state, one row per page: the features of its path beside the samples of the page."""
    return _beside(pages, features, columns.keys, "left")
