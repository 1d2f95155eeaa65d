"""Series cut into chunks must give exactly what whole series give."""

import random

import pytest
from pyspark.sql import functions as F

from arcwise.operators import path, shapes, state
from arcwise.operators.path import PathColumns
from arcwise.operators.series import CHUNK, split_series

COLUMNS = PathColumns(keys=("k",), time="time", tie="id", x="x", y="y")


@pytest.fixture(scope="module")
def points(spark):
    """One series with a third of all rows, one without a key, tied and missing times, many short ones."""
    rng = random.Random(7)
    rows, number = [], 0
    for key, size in [(0, 900), (None, 700)] + [(k, rng.randint(1, 40)) for k in range(1, 50)]:
        for _ in range(size):
            time = float(rng.randint(0, 300)) if key in (0, 3) else rng.random()
            if key == 0 and rng.random() < 0.02:
                time = None
            x = None if key == 0 and rng.random() < 0.02 else rng.random()
            rows.append((key, number, time, x, rng.random() - 0.5))
            number += 1
    rng.shuffle(rows)
    schema = "k bigint, id bigint, time double, x double, y double"
    return spark.createDataFrame(rows, schema).repartition(7).cache()


def rows_of(table):
    return sorted(map(repr, table.select(*sorted(table.columns)).collect()))


def test_long_series_are_cut_and_short_ones_are_not(points):
    series = split_series(points, ("k",), COLUMNS.order, max_rows=60)
    sizes = series.cut.groupBy("k", CHUNK).count().collect()
    assert {r["k"] for r in sizes} == {0, None}
    for key in (0, None):
        assert sum(r["k"] == key for r in sizes) > 10
    assert max(r["count"] for r in sizes) < 150
    assert series.whole.filter("k IS NULL OR k = 0").count() == 0
    assert series.table().count() == points.count()


def test_chunks_follow_the_order(points):
    rows = split_series(points, ("k",), COLUMNS.order, max_rows=60).cut.filter("k = 0").collect()
    rows.sort(key=lambda r: (r["time"] is not None, r["time"] or 0.0, r["id"]))
    chunks = [r[CHUNK] for r in rows]
    assert chunks == sorted(chunks) and chunks[0] == 0


def test_nothing_is_cut_below_the_limit(points):
    assert split_series(points, ("k",), COLUMNS.order, max_rows=10_000).cut is None
    assert split_series(points, ("k",), COLUMNS.order, max_rows=None).cut is None


@pytest.mark.parametrize(
    ("analyse", "max_rows"),
    [
        (path.curvatures, 60),
        (path.tangents, 60),
        (path.bisectors, 60),
        (path.turning_angles, 60),
        (path.path_peaks, 60),
        (path.path_knots, 60),
        (path.path_knots, 5),
        (path.feature_table, 60),
        (path.feature_table, 5),
        (shapes.path_segments, 60),
        (state.state_features, 60),
    ],
)
def test_cut_series_give_the_same_rows(points, analyse, max_rows):
    assert rows_of(analyse(points, COLUMNS, max_rows=max_rows)) == rows_of(
        analyse(points, COLUMNS, max_rows=None)
    )


@pytest.mark.parametrize(
    "analyse",
    [
        shapes.normalise_curvature,
        shapes.curve_segment_phases,
        shapes.path_segment_phases,
        shapes.point_phases,
    ],
    ids=lambda f: f.__name__,
)
def test_cut_features_give_the_same_rows(points, analyse):
    features = path.feature_table(points, COLUMNS, max_rows=None)
    assert rows_of(analyse(features, COLUMNS, max_rows=60)) == rows_of(
        analyse(features, COLUMNS, max_rows=None)
    )


def test_cut_stored_tables_give_the_same_knots(points):
    curved = path.curvatures(points, COLUMNS, max_rows=None)
    peaks = path.peaks(curved, COLUMNS, max_rows=60)
    assert rows_of(peaks) == rows_of(path.peaks(curved, COLUMNS, max_rows=None))
    # The series without a key has its knots by either route.
    expected = path.path_knots(points, COLUMNS, max_rows=None)
    assert rows_of(path.knots(curved, peaks, COLUMNS, max_rows=60)) == rows_of(expected)
    assert rows_of(path.spline_bounds(peaks, COLUMNS, max_rows=5)) == rows_of(
        path.spline_bounds(peaks, COLUMNS, max_rows=None)
    )


def test_stored_knots_of_a_series_without_a_key(spark):
    levels = [0.0, -3.0, 2.0, 1.0, 1.0, -3.0]
    rows = [(key, place, float(place), level) for key in (None, 7) for place, level in enumerate(levels)]
    curved = spark.createDataFrame(rows, "k LONG, id LONG, time DOUBLE, curvature DOUBLE")
    found = path.knots(curved, path.peaks(curved, COLUMNS), COLUMNS).collect()
    assert {(r["k"], r["id"], r["knot_index"]) for r in found} == {(None, 3, 0), (None, 4, 1), (7, 3, 0), (7, 4, 1)}


def test_pages_hold_every_point_once_and_in_order(points):
    cut = split_series(points, ("k",), COLUMNS.order, max_rows=60)
    pages = shapes.series_pages(cut, ["time", "id"], page_points=50)
    assert pages.filter(F.size("points") > 50).count() == 0
    opened = shapes.unnest_pages(pages).filter("k = 0").collect()
    opened.sort(key=lambda r: (r["page"], r["point_position"]))
    order = [(r["time"] is not None, r["time"] or 0.0, r["id"]) for r in opened]
    assert len(order) == 900 and order == sorted(order)


def test_number_and_neighbours_by_brute_force(points):
    by_key = {}
    for row in points.collect():
        by_key.setdefault(row["k"], []).append((row["time"] is not None, row["time"] or 0.0, row["id"]))
    expected = {}
    for rows in by_key.values():
        rows.sort()
        for place, (*_, number) in enumerate(rows):
            before = rows[place - 1][-1] if place else None
            after = rows[place + 1][-1] if place + 1 < len(rows) else None
            expected[number] = (place, before, after, len(rows))
    series = (
        split_series(points, ("k",), COLUMNS.order, max_rows=30)
        .numbered("place")
        .neighbours({"before": "id"}, {"after": "id"})
        .totals({"size": F.count(F.lit(1))})
    )
    found = {r["id"]: (r["place"], r["before"], r["after"], r["size"]) for r in series.table().collect()}
    assert found == expected


def test_one_split_serves_several_analyses(points):
    shared = split_series(points, ("k",), COLUMNS.order, max_rows=60)
    for analyse in (path.curvatures, path.path_peaks):
        assert rows_of(analyse(shared, COLUMNS)) == rows_of(analyse(points, COLUMNS, max_rows=None))
