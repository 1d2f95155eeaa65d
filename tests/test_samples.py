"""Samples kept as state: folding equals making anew, whatever comes in and wherever."""

import random

import pytest

from arcwise.operators import samples, state
from arcwise.operators.path import PathColumns

COLUMNS = PathColumns(keys=("p",), time="t", tie="i", x="x", y="y")
SCHEMA = "p string, i int, t double, x double, y double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pages(frame):
    return sorted((repr(row) for row in frame.collect()))


def paths(seed, sizes):
    dice = random.Random(seed)
    rows = []
    for key, size in sizes.items():
        for i in range(size):
            place = dice.random(), dice.random()
            if i and dice.random() < 0.1:
                place = rows[-1][3:]  # a step without length
            rows.append((key, i, float(dice.randrange(size)), *place))
    return rows


@pytest.mark.parametrize("limit", [None, 9])
def test_folding_equals_making_anew(spark, tmp_path, limit):
    rows = paths(1, {"a": 40, "b": 23, "c": 1, "d": 2, None: 17, "late": 6})
    dice = random.Random(2)
    for number, is_new in enumerate(
        (
            lambda row: row[0] == "late" or dice.random() < 0.2,  # anywhere, and a new path
            lambda row: row[2] >= 15,  # at the end
            lambda row: row[2] < 3 or row[0] == "c",  # at the start
            lambda row: False,
            lambda row: True,
        )
    ):
        flags = [is_new(row) for row in rows]
        old = samples.state_samples(table(spark, [r for r, new in zip(rows, flags) if not new]), COLUMNS, 4, limit)
        old.write.parquet(f"{tmp_path}/{number}")
        added = table(spark, [r for r, new in zip(rows, flags) if new])
        folded = samples.fold_samples(spark.read.parquet(f"{tmp_path}/{number}"), added, COLUMNS, 4, limit)
        assert pages(folded) == pages(samples.state_samples(table(spark, rows), COLUMNS, 4, limit))


def test_untouched_pages_are_not_opened(spark):
    rows = [("a", i, float(i), float(i), float(i * i % 7)) for i in range(20)]
    old = samples.state_samples(table(spark, rows), COLUMNS, 4)
    first = samples._first_changed(old, table(spark, [("a", 99, 9.5, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0)]), COLUMNS)
    # Samples 8 to 11 lie on page 2; page 1 ends with sample 7, whose curvature reaches to sample 8.
    assert {row["p"]: row["from_page"] for row in first.collect()} == {"a": 2, "b": None}
    first = samples._first_changed(old, table(spark, [("a", 99, 7.5, 0.0, 0.0)]), COLUMNS)
    assert first.first()["from_page"] == 1


def test_features_of_pages_equal_features_of_points(spark):
    rows = paths(3, {"a": 40, "b": 23, "c": 1, "d": 2, None: 17})
    rows += [("flat", i, float(i), float(i), 0.0) for i in range(9)]
    rows += [("gap", i, float(i), None if i == 4 else float(i), float(i % 3)) for i in range(9)]
    wanted = state.state_features(table(spark, rows), COLUMNS, 9)
    for page_samples in (1, 2, 5, 100):
        own = samples.sample_features(samples.state_samples(table(spark, rows), COLUMNS, page_samples), COLUMNS, 9)
        assert own.dtypes == wanted.dtypes
        assert pages(own) == pages(wanted)


def test_samples_of_a_curvature(spark):
    rows = [("a", i, float(i), float(i), float(i % 2)) for i in range(6)]
    made = samples.state_samples(table(spark, rows), COLUMNS, 3)
    trios = {row["page"]: row["curvature_sample_indices"] for row in made.collect()}
    assert trios == {0: [[0, 1, 2], [1, 2, 3]], 1: [[2, 3, 4], [3, 4, 5]]}
    opened = samples.unnest_samples(made, COLUMNS).collect()
    assert [(r["sample_index"], r["from_sample"], r["to_sample"]) for r in sorted(opened, key=lambda r: r["sample_index"])] == [
        (0, None, None), (1, 0, 2), (2, 1, 3), (3, 2, 4), (4, 3, 5), (5, None, None)
    ]
    assert samples.state_samples(table(spark, []), COLUMNS).count() == 0
