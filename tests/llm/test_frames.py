import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arcwise.llm import exact, packing, passages
from arcwise.llm.frames import free_name, kept, map_batches, numbered
from tests.llm.common import docs_of

PARALLELISM = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def many(spark, tmp_path):
    """4,000 rows in one file of small row groups and some more files, with columns of the helpers' names."""
    rows = [(k, f"text {k % 1500} " + "filler " * 40, k, k, "p") for k in range(4000)]
    path = str(tmp_path / "many.parquet")
    frame = spark.createDataFrame(rows, "doc_id LONG, text STRING, _row LONG, _at LONG, _path STRING")
    frame.coalesce(1).write.option("parquet.block.size", 20_000).parquet(path)
    frame.limit(50).repartition(3).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def under(spark, cores, work):
    spark.conf.set(PARALLELISM, str(cores))
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        return work()
    finally:
        spark.conf.unset(PARALLELISM)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_numbers_do_not_follow_the_splits(spark, many):
    def read():
        frame = numbered(many, "number")
        return frame.rdd.getNumPartitions(), sorted(map(tuple, frame.collect()))

    (few, one), (more, other) = under(spark, 2, read), under(spark, 16, read)
    assert few != more and one == other
    assert len({row[-1] for row in one}) == len(one) == 4050
    assert all(row[2] == row[3] == row[0] and row[4] == "p" for row in one)


def test_other_frames_are_stored_first(spark):
    frame = spark.range(100).withColumn("x", F.col("id") * 2)
    rows = numbered(frame, "number").collect()
    assert len({row.number for row in rows}) == 100 and free_name(frame, "ID") == "ID_"


def test_dropped_rows_are_those_judged(spark, many):
    groups = under(spark, 2, lambda: exact.exact_groups(many, F.col("doc_id") % 2 == 0))
    dropped = groups.filter("NOT kept").select("row_id")
    kept = under(spark, 16, lambda: corpus_pipeline._without(many, dropped).collect())
    assert sorted(row.doc_id for row in kept) == list(range(1500))
    assert kept[0].asDict().keys() == set(many.columns) and all(row._row == row.doc_id for row in kept)


def test_passages_under_other_cores(spark, tmp_path):
    planted = " ".join(f"planted{k}" for k in range(60))
    rows = [(k, " ".join(f"own{k}x{j}" for j in range(60)) + (" " + planted if k in (5, 40) else "")) for k in range(60)]
    docs = docs_of(spark, tmp_path, rows)
    found = [under(spark, cores, lambda: sorted(map(tuple, passages.repeated_passages(docs).collect()))) for cores in (1, 7)]
    assert found[0] == found[1] and {row[0] for row in found[0]} == {5, 40}


def test_packing_keeps_columns_of_any_name(spark):
    rows = [(k, 100 + k, "g", -k, True, 7, "a.b") for k in range(60)]
    pieces = spark.createDataFrame(rows, "doc_id LONG, length LONG, _group STRING, _row LONG, `group` BOOLEAN, c0 LONG, `x.y` STRING")
    packed = packing.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(tuple(row)[:7] for row in packed.collect()) == sorted(rows)


class Here:
    """Runs a task in this process."""

    @staticmethod
    def mapInArrow(work, schema):  # noqa: N802
        return list(work(iter([])))


def own_mb():
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_task_gives_back_its_memory():
    last = []

    def work(batches):
        parts = [bytes([k % 256]) * 2000 for k in range(100_000)]
        last.append(parts[-1])  # keeps the top of the heap, so nothing goes back by itself
        del parts
        yield from batches

    before = own_mb()
    map_batches(Here, work, None)
    assert own_mb() < before + 60


def test_what_tasks_keep_goes_with_the_next_operator():
    made = []

    @kept
    def model(name):
        made.append(name)
        return name

    def using(batches):
        model("m")
        yield from batches

    for _ in range(3):
        map_batches(Here, using, None)
    assert made == ["m"]
    map_batches(Here, lambda batches: batches, None)
    map_batches(Here, using, None)
    assert made == ["m", "m"]
