"""Edge cases of path geometry."""

import math

import pytest

from arcwise.operators import path
from arcwise.operators.path import PathColumns

COLUMNS = PathColumns(keys=("p",), time="time", tie="id", x="x", y="y")


def table(spark, xy, path_id="a"):
    rows = [(path_id, i, float(i), float(x), float(y)) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "p string, id int, time double, x double, y double")


def features(spark, xy, digits=9):
    return path.feature_table(table(spark, xy), COLUMNS, digits).orderBy("time").collect()


@pytest.mark.parametrize("xy", [[(0, 0)], [(0, 0), (1, 2)]])
def test_one_and_two_points(spark, xy):
    for row in features(spark, xy):
        assert (row["curvature"], row["tangent"], row["bisector_x"]) == (0.0, 0.0, None)
        assert row["peak_type"] == "positive"
    assert path.path_knots(table(spark, xy), COLUMNS).count() == 0


def test_no_step_in_gives_null_and_no_error(spark):
    row = features(spark, [(0, 0), (1, 1), (1, 1), (2, 0)])[2]
    assert row["curvature"] is None and row["bisector_x"] is None


def test_no_step_out_gives_zero(spark):
    row = features(spark, [(0, 0), (1, 1), (1, 1), (2, 0)])[1]
    assert (row["curvature"], row["tangent"]) == (0.0, 0.0)


@pytest.mark.parametrize("slope", [0, 3])
def test_straight_line(spark, slope):
    rows = features(spark, [(x, slope * x) for x in range(6)])
    assert all(abs(r["curvature"]) < 1e-12 for r in rows)
    assert all(r["bisector_x"] is None and r["bisector_y"] is None for r in rows)
    assert all(r["peak_type"] == "positive" for r in rows)
    assert all(r["tangent"] == pytest.approx(math.atan(slope)) for r in rows[1:-1])
    assert path.path_knots(table(spark, [(x, slope * x) for x in range(6)]), COLUMNS, 9).count() == 0


def test_bisector_of_a_right_angle(spark):
    row = features(spark, [(0, 1), (0, 0), (1, 0)])[1]
    assert row["bisector_x"] == pytest.approx(math.sqrt(0.5))
    assert row["bisector_y"] == pytest.approx(math.sqrt(0.5))
    assert row["curvature"] == pytest.approx(1.0)
    angle = path.turning_angles(table(spark, [(0, 1), (0, 0), (1, 0)]), COLUMNS).filter("id = 1").first()
    assert angle["turning_angle"] == pytest.approx(math.pi / 2)
    assert angle["turning_ratio"] == pytest.approx(0.5)
    assert angle["turning_weight"] == pytest.approx(1.5)


def curve(spark, levels):
    rows = [("a", i, float(i), float(k)) for i, k in enumerate(levels)]
    return spark.createDataFrame(rows, "p string, id int, time double, curvature double")


def labels(spark, levels):
    rows = path.peaks(curve(spark, levels), COLUMNS).collect()
    return {r["id"]: r["peak_type"] for r in rows}


def knots(spark, levels):
    curved = curve(spark, levels)
    rows = path.knots(curved, path.peaks(curved, COLUMNS), COLUMNS).collect()
    return {r["id"]: r["knot_index"] for r in rows}


def test_ties_are_all_peaks_and_the_first_one_bounds(spark):
    levels = [0, 2, 1, 2, -1, -3, 0]
    assert labels(spark, levels) == {1: "positive", 3: "positive", 4: "crossover", 5: "negative"}
    assert knots(spark, levels) == {2: 0, 3: 1, 4: 2}


def test_negative_peak_before_the_positive_one_leaves_no_knots(spark):
    assert labels(spark, [0, -3, 1, 2, 0]) == {1: "negative", 2: "crossover", 3: "positive"}
    assert knots(spark, [0, -3, 1, 2, 0]) == {}


def test_a_later_negative_peak_bounds_the_knots(spark):
    assert knots(spark, [0, -3, 2, 1, 1, -3]) == {3: 0, 4: 1}


def test_zero_between_signs_is_no_crossover(spark):
    assert labels(spark, [1, 0, -1, 0.5]) == {0: "positive", 2: "negative", 3: "crossover"}


def test_points_are_ordered_by_time_not_by_row(spark):
    shuffled = table(spark, [(0, 1), (0, 0), (1, 0), (1, 1)]).orderBy("x", "y").repartition(3)
    ordered = table(spark, [(0, 1), (0, 0), (1, 0), (1, 1)])
    a = path.feature_table(shuffled, COLUMNS).orderBy("id").collect()
    assert a == path.feature_table(ordered, COLUMNS).orderBy("id").collect()
