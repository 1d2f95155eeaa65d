"""States, actions and validation on small tables worked out by hand."""

import pytest
from pyspark.sql import types as T

from arcwise.operators import state, validate


def test_priorities_by_hand(spark):
    schema = (
        "id string, curvature_count bigint, curvature_sign_change boolean, guessed_zero_crossing double,"
        " verified_guessed_zero_crossing boolean, true_zero_crossing double"
    )
    states = spark.createDataFrame(
        [
            ("fresh", 0, False, None, None, None),
            ("guessed", 4, True, 0.5, None, None),
            ("right", 4, False, 0.5, True, 0.5),
            ("wrong", 4, True, 0.5, False, None),
        ],
        schema,
    )
    ranked = state.rank_actions(states, ["id"]).collect()
    found = {
        key: [(r["action_id"], r["priority"]) for r in sorted(ranked, key=lambda r: r["rank"]) if r["id"] == key]
        for key in ("fresh", "guessed", "right", "wrong")
    }
    near, far = "add_4_samples_at_guess__bounded", "add_4_samples_at_guess__unbounded"
    assert found["fresh"] == [("add_4_samples", 0), ("make_guess", 0), (near, 0), (far, 0)]
    # 5 * 0.8 * 0.95 = 3.8, cut to 3
    assert found["guessed"][0] == (near, 3)
    # (5 + 15 / (1 + 0.5)) * 0.76 = 11.4
    assert found["right"][:2] == [("make_guess", 11), (far, 3)]
    # -5 * 0.76 = -3.8, cut towards zero
    assert found["wrong"] == [(near, 3), ("add_4_samples", 0), (far, 0), ("make_guess", -3)]
    totals = {r["id"]: r["total_priority"] for r in ranked}
    assert totals == {"fresh": 0, "guessed": 3, "right": 14, "wrong": 0}


def test_defaults_fill_gaps_only(spark):
    rows = spark.createDataFrame([("a", True), ("b", None)], "id string, curvature_sign_change boolean")
    filled = {r["id"]: r for r in state.with_defaults(rows).collect()}
    assert filled["a"]["curvature_sign_change"] is True and filled["b"]["curvature_sign_change"] is False
    assert filled["a"]["sample_moments"] == [] and filled["a"]["action_taken"] is None


def test_unknown_aggregation_is_refused(spark):
    with pytest.raises(ValueError, match="unknown aggregation"):
        state.state_param({"t": spark.range(1)}, state.StateParam("p", "t", ("id",), "id", "exec"))


def test_zero_crossing_lies_on_the_line_between(spark):
    from arcwise.operators.path import PathColumns

    columns = PathColumns(keys=("p",), time="t", tie="i", x="x", y="y")
    xy = [(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (5, 0)]
    rows = [("a", i, float(i), float(x), float(y)) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "p string, i int, t double, x double, y double")
    row = state.state_features(points, columns).first()
    assert (row["sample_count"], row["curvature_count"]) == (6, 4)
    assert row["curvature_sign_change"] is True
    # curvature 1 at t=1, -1 / 2^1.5 at t=2
    other = 1 / 2**1.5
    assert row["guessed_zero_crossing"] == pytest.approx(1 + 1 / (1 + other))
    assert row["lowest_curvature_magnitude"] == pytest.approx(other)


def test_rules_on_a_damaged_table(spark):
    good = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.7), ("b", 0, 0.9)], "k string, i int, v double")
    bad = spark.createDataFrame(
        [("a", 0, 0.5), ("a", 0, 1.7), ("a", 3, None), (None, 1, 0.9), ("z", 0, 0.1)],
        "k string, i int, v double",
    )
    parents = spark.createDataFrame([("a",), ("b",)], "k string")
    declared = T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.LongType())])

    def violations(table):
        rules = [
            validate.NotNull("t", "k"),
            validate.Between("t", "v", 0.0, 1.0),
            validate.OneOf("t", "k", ("a", "b")),
            validate.Unique("t", ("k", "i")),
            validate.References("t", ("k",), "parents", ("k",)),
            validate.Contiguous("t", ("k",), "i"),
            validate.HasSchema("t", declared),
        ]
        result = validate.validate({"t": table, "parents": parents}, rules).collect()
        assert all(r["passed"] == (r["n_violations"] == 0) for r in result)
        return {r["rule"].split("(")[0]: r["n_violations"] for r in result}

    rows = {"not_null": 0, "between": 0, "one_of": 0, "unique": 0, "references": 0, "contiguous": 0}
    assert violations(good) == {**rows, "schema": 1}
    assert violations(bad) == {
        "not_null": 1,
        "between": 1,
        "one_of": 1,
        "unique": 1,
        "references": 1,
        "contiguous": 2,
        "schema": 1,
    }
