"""Validation by few aggregates, damaged stored tables, drifting documents and feature tables side by side."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.operators import shapes, validate
from arcwise.plans.catalog import TABLE_RULES
from arcwise.sources.files import read_json, write_csv, write_json


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


def shuffles(table):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", plan(table)))


def test_all_rules_take_one_scan_per_table_and_few_shuffles(spark, tmp_path):
    names = {rule.table for rule in TABLE_RULES} | {rule.parent for rule in TABLE_RULES if isinstance(rule, validate.References)}
    kinds = {"value": "double", "event_type": "string"}
    columns: dict[str, set] = {name: set() for name in names}
    for rule in TABLE_RULES:
        own = [getattr(rule, "column", None), *getattr(rule, "columns", ()), *getattr(rule, "keys", ())]
        columns[rule.table] |= {name for name in own if name}
        if isinstance(rule, validate.References):
            columns[rule.parent] |= set(rule.parent_columns)
    tables = {}
    for name in names:
        wanted = [F.col("id").cast(kinds.get(c, "long")).alias(c) for c in sorted(columns[name])]
        spark.range(20).select(*wanted).write.parquet(f"{tmp_path}/{name}")
        tables[name] = spark.read.parquet(f"{tmp_path}/{name}")
    result = validate.validate(tables, TABLE_RULES)
    text = plan(result)
    assert shuffles(result) == 4 and text.count("FileScan") + text.count("Scan parquet") >= len(names)
    assert len(re.findall(r"(?:FileScan|Scan) parquet", text)) == len(names)
    assert "Join" not in text
    assert result.count() == len(TABLE_RULES)


def test_empty_tables_and_null_keys(spark):
    empty = spark.createDataFrame([], "k string, i int")
    rules = [validate.NotNull("t", "k"), validate.Unique("t", ("k",)), validate.Contiguous("t", ("k",), "i"), validate.References("t", ("k",), "p", ("k",))]
    assert {(r.n_rows, r.n_violations) for r in validate.validate({"t": empty, "p": empty}, rules).collect()} == {(0, 0)}
    some = spark.createDataFrame([(None, 0), (None, 0), ("a", 0)], "k string, i int")
    found = [r.n_violations for r in validate.validate({"t": some, "p": empty}, rules).collect()]
    # Two NULL keys are equal, and no reference; "a" has no parent.
    assert found == [2, 1, 1, 1]


def test_signed_zeros_are_one_key(spark):
    rows = spark.createDataFrame([(0.0,), (-0.0,), (1.5,)], "x double")
    assert validate.validate({"t": rows}, [validate.Unique("t", ("x",))]).first().n_violations == 1


DECLARED = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType())])


def cells(spark, path):
    return {r.rule: (r.n_rows, r.n_violations) for r in validate.stored_cells(spark, str(path), "t", DECLARED).collect()}


def test_damaged_files_are_reported_and_do_not_abort(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,n,x\na,1,0.5\nb,two,0.25\nc,3\nd,4,1e3,more\n,,\n"",7,nan?\n')
    (tmp_path / "b.csv").write_text("k,x,n\ne,5,0.5\nf,99999999999,1\n")
    assert cells(spark, tmp_path) == {
        "header": (2, 1),  # b.csv begins with other names
        "whole_rows": (9, 2),  # "c,3" and "d,4,1e3,more"; the other header counts as a row
        "cells(k)": (9, 0),
        "cells(n)": (9, 3),  # two, x, 99999999999
        "cells(x)": (9, 2),  # nan?, n
    }
    rows = validate.lenient_csv(spark, str(tmp_path), DECLARED)
    assert rows.filter("k = 'b'").first() == ("b", None, 0.25)


def test_a_written_table_is_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a,\"b\"", 1, 0.5), ("", None, None), (None, 3, float("inf"))], DECLARED)
    write_csv(rows.repartition(2), f"{tmp_path}/t.csv")
    found = cells(spark, f"{tmp_path}/t.csv")
    assert found["whole_rows"] == (3, 0) and found["header"][1] == 0
    assert all(found[f"cells({name})"] == (3, 0) for name in DECLARED.names)


def test_documents_with_other_keys_are_refused(spark, tmp_path):
    declared = "id string, root struct<x: double, tips: array<struct<y: double>>>"
    good = spark.createDataFrame([("a", (1.0, [(2.0,)])), ("b", None)], declared)
    write_json(good, f"{tmp_path}/good")
    assert read_json(spark, f"{tmp_path}/good", declared).count() == 2
    (tmp_path / "bad.json").write_text('{"id": "a", "root": {"x": 1.0, "tips": [{"z": 2.0}]}, "rot": 1}\n')
    with pytest.raises(ValueError, match=r"unknown \.rot.*unknown \.root\.tips\[\]\.z.*missing \.root\.tips\[\]\.y"):
        read_json(spark, f"{tmp_path}/bad.json", declared)
    assert read_json(spark, f"{tmp_path}/bad.json", declared, check_keys=False).first().root.tips[0].y is None
    write_json(good.limit(0), f"{tmp_path}/none")
    assert read_json(spark, f"{tmp_path}/none", declared).count() == 0


def joined(points, features, on):
    for table in features:
        points = points.join(table, on, "left")
    return points


def feature_tables(spark):
    points = spark.createDataFrame(
        [("a", "f1", 0, 1.0), ("a", "f1", 1, 2.0), ("a", "f2", 0, 3.0), ("a", "f2", 0, 3.5), ("b", None, 0, 4.0), (None, None, None, 5.0)],
        "animation_id string, frame_id string, effector_index int, effector_position_x double",
    ).withColumn("effector_position_y", F.col("effector_position_x") * 2)
    key = "animation_id string, frame_id string, effector_index int"
    bent = spark.createDataFrame([("a", "f1", 0, 0.5), ("a", "f2", 0, None), ("z", "f1", 0, 9.0), ("b", None, 0, 8.0)], f"{key}, curvature double")
    named = spark.createDataFrame([("a", "f1", 1, "positive"), (None, None, None, "none")], f"{key}, peak_type string")
    frames = spark.createDataFrame(
        [("a", "f1", 0, 0.0), ("a", "f2", 1, 0.25), ("c", "f9", 0, 0.5)], "animation_id string, frame_id string, frame_index int, time double"
    )
    return points, [bent, named], frames


def test_features_beside_points_equal_left_joins(spark):
    points, features, frames = feature_tables(spark)
    on = ["animation_id", "frame_id", "effector_index"]
    beside = shapes.fan_in(points, features, on)
    expected = joined(points, features, on).select(*beside.columns)
    assert sorted(map(str, beside.collect())) == sorted(map(str, expected.collect()))
    whole = shapes.effector_features(points, frames, features)
    expected = joined(points, features, on).join(frames, on[:2], "left").withColumnsRenamed({"effector_position_x": "x", "effector_position_y": "y"})
    assert sorted(map(str, whole.collect())) == sorted(map(str, expected.select(*whole.columns).collect()))


def test_features_beside_points_take_one_shuffle(spark, tmp_path):
    points, features, frames = feature_tables(spark)
    for name, table in {"points": points, "bent": features[0], "named": features[1], "frames": frames}.items():
        table.write.parquet(f"{tmp_path}/{name}")
    points, bent, named, frames = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("points", "bent", "named", "frames"))
    table = shapes.effector_features(points, frames, [bent, named])
    assert shuffles(table) == 1 and "Join" not in plan(table)
    # By the frame, then within it by the effector.
    assert plan(table).count("Sort [") == 2
