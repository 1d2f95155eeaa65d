"""Several outputs by one job: the same rows as table by table, seen together or not at all."""

import random

import pytest

from arcwise.operators import path
from arcwise.operators.path import PathColumns
from arcwise.sources.outputs import read_output, write_outputs

COLUMNS = PathColumns(keys=("p",), time="t", tie="i", x="x", y="y")
SCHEMA = "p string, i int, t double, x double, y double"


def points(spark, seed, sizes):
    dice = random.Random(seed)
    rows = [(key, i, float(dice.randrange(size)), dice.random(), dice.random()) for key, size in sizes.items() for i in range(size)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("limit", [None, 9])
def test_outputs_equal_the_five_tables(spark, tmp_path, limit):
    table = points(spark, 1, {"a": 40, "b": 23, "c": 1, None: 17})
    write_outputs(path.path_outputs(table, COLUMNS, 9, limit), str(tmp_path / "out"))
    wanted = path.path_tables(table, COLUMNS, 9, limit)
    for name, own in path.OUTPUTS.items():
        found = read_output(spark, str(tmp_path / "out"), name, ["p", "i", *own])
        assert found.dtypes == wanted[name].dtypes
        assert rows_of(found) == rows_of(wanted[name])
    wanted.release()


def test_readers_follow_the_manifest(spark, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(ValueError, match="no outputs"):
        read_output(spark, folder, "knots", ["knot_index"])
    first = path.path_outputs(points(spark, 1, {"a": 8}), COLUMNS)
    write_outputs(first, folder)
    assert read_output(spark, folder, "curvatures", ["p"]).count() == 8
    # A run that ended before its manifest row, or in the middle of its data, is not seen.
    first.write.partitionBy("output").parquet(f"{folder}/data/left")
    assert read_output(spark, folder, "curvatures", ["p"]).count() == 8
    write_outputs(path.path_outputs(points(spark, 2, {"a": 5}), COLUMNS), folder)
    assert read_output(spark, folder, "curvatures", ["p"]).count() == 5
    write_outputs(path.path_outputs(points(spark, 2, {}), COLUMNS), folder)
    assert read_output(spark, folder, "knots", ["p", "knot_index"]).collect() == []


def test_one_output_reads_its_own_files_and_columns(spark, tmp_path):
    folder = str(tmp_path / "out")
    write_outputs(path.path_outputs(points(spark, 1, {"a": 8}), COLUMNS), folder)
    plan = read_output(spark, folder, "tangents", ["p", "tangent"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(output" in plan
    assert "ReadSchema: struct<p:string,tangent:double>" in plan
