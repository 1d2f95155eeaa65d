"""What the physical plans must look like."""

import re

import pytest
from pyspark.sql import functions as F

from arcwise.operators import kinematics, motion, path, state, sweep
from arcwise.operators.path import PathColumns

COLUMNS = PathColumns(keys=("k",), time="time", tie="id", x="x", y="y")


def plan(table):
    return table._jdf.queryExecution().executedPlan().toString()


def shuffles(table):
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|RoundRobin)", plan(table)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Motions, joints, animations, frames and points as stored tables."""
    folder = tmp_path_factory.mktemp("stored")
    proposals = motion.propose_motions(spark, 4)
    joints = motion.motion_joints(proposals)
    animations, frames = sweep.sweep(joints, 20)
    tables = [motion.motion_roots(proposals), joints, animations, frames]
    points = spark.range(200).selectExpr(
        "id % 5 AS k", "id", "rand(1) AS time", "rand(2) AS x", "rand(3) AS y", "'unused' AS note"
    )
    for number, table in enumerate([*tables, points]):
        table.write.parquet(f"{folder}/{number}")
    return [spark.read.parquet(f"{folder}/{number}") for number in range(5)]


@pytest.mark.parametrize("analyse", [path.curvatures, path.path_peaks, path.path_knots, path.feature_table])
def test_paths_take_one_shuffle_and_one_sort(stored, analyse):
    table = analyse(stored[4], COLUMNS)
    assert shuffles(table) == 1
    assert plan(table).count("Sort [") == 1


def test_only_needed_columns_are_read(stored):
    text = plan(path.tangents(stored[4], COLUMNS))
    assert "note" not in text


def test_state_and_ranking_add_no_shuffle(stored):
    features = state.state_features(stored[4], COLUMNS)
    assert shuffles(features) == 1
    assert shuffles(state.rank_actions(state.with_defaults(features), ["k"])) == 1


def test_frames_are_neither_shuffled_nor_broadcast(stored):
    text = plan(kinematics.effector_table(*stored[:4]))
    # The one shuffle gathers the joints of each motion, before frames come in.
    assert shuffles(kinematics.effector_table(*stored[:4])) == 1
    frames_branch = text.split("BroadcastExchange")[0]
    assert "frame_index" in frames_branch or "frame_id" in frames_branch
    assert not re.search(r"BroadcastExchange(?:(?!BroadcastExchange).)*frame_id", text, re.S)


def test_chains_are_resolved_once_per_frame(stored):
    text = plan(kinematics.effector_table(*stored[:4]))
    assert "size(transform" not in text


def test_knots_between_paths_and_times_on_effectors_need_no_join(stored):
    effectors = kinematics.effector_table(*stored[:4], keep=("time",)).filter("effector_index <> 0")
    table = path.feature_table(effectors, max_rows=None)
    assert "SortMergeJoin" not in plan(table)
    assert shuffles(table) == 2


def test_long_chains_are_dealt_by_their_joints_at_frames(spark, monkeypatch):
    """What a task sorts is bounded by measured counts, not by the packed bytes that it reads."""
    motions = motion.propose_motions(spark, 40, motion.MotionDefaults(joint_count=12))
    joints = motion.motion_joints(motions)
    animations, frames = sweep.sweep(joints, 10)
    inputs = (motion.motion_roots(motions), joints, animations, frames)
    whole = {tuple(row) for row in kinematics.effector_table(*inputs).collect()}
    monkeypatch.setattr(kinematics, "SMALL_ENTRIES", 10)
    monkeypatch.setattr(kinematics, "tasks_of", lambda rows: -(-rows // 200))
    blocks = kinematics.chain_blocks(joints, 2, kinematics.tasks_of(480))
    assert blocks.count() == 240 and blocks.rdd.getNumPartitions() == 3
    posed = kinematics.posed_long_frames(*inputs, limit=0, block_joints=2).withColumn("task", F.spark_partition_id())
    tasks = [row["count"] for row in posed.groupBy("task").count().collect()]
    assert sum(tasks) == 2400 and max(tasks) <= 400 and len(tasks) > 12
    found = kinematics.resolve_long_chains(*inputs, limit=0, block_joints=2).collect()
    key = lambda row: (row[0], row[1], row[2], *(round(value, 6) + 0.0 for value in row[3:]))
    assert {key(row) for row in found} == {key(row) for row in whole}
