"""Synthesis, sweeps and kinematics, from the default run's known values to the odd cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from arcwise.functions.arrays import expand_range
from arcwise.operators import kinematics, motion, path, sweep


@pytest.fixture(scope="module")
def default_run(spark):
    proposals = motion.propose_motions(spark, 1)
    motions, joints = motion.motion_roots(proposals), motion.motion_joints(proposals)
    animations, frames = sweep.sweep(joints, 20)
    effectors = kinematics.effector_table(motions, joints, animations, frames).cache()
    return motions, joints, animations, frames.cache(), effectors


def test_default_motion(default_run):
    motions, joints, *_ = default_run
    assert [tuple(r) for r in motions.collect()] == [("motion_0", 0.0, 3.455751918948773, 1.0)]
    full_turn = 6.283185307179586
    assert [tuple(r) for r in joints.orderBy("joint_index").collect()] == [
        ("motion_0", 0, 0.0, 0.2, full_turn, 0.0),
        ("motion_0", 1, 1.0, 0.2, full_turn, 0.0),
        ("motion_0", 2, 1.0, 0.2, full_turn, 0.0),
        ("motion_0", 3, 1.0, 0.0, 0.0, 0.0),
    ]


def test_default_frames(default_run):
    frames = default_run[3].orderBy("frame_index").collect()
    assert len(frames) == 20
    assert tuple(frames[1]) == ("anim_1", 0, 1, 0.049999999999999996, "frame_2")
    assert frames[0]["time"] == 0.0 and frames[19]["frame_id"] == "frame_20"


def test_default_effectors(default_run):
    effectors = default_run[4]
    assert effectors.count() == 80
    found = {r["effector_index"]: tuple(r)[3:] for r in effectors.filter("frame_id = 'frame_7'").collect()}
    # Known values of the default run.
    assert found[0] == (-0.285316954888546, -0.09270509831248432, 0.19021130325903074)
    assert found[1] == (0.6966473518062293, 0.09636129314154766, 0.3804226065180615)
    assert found[2] == (1.625155151051331, 0.46767418914843073, 0.5706339097770923)


def test_default_peaks_and_knots(default_run):
    points = path.path_points(default_run[4], default_run[3])
    peaks = {(r["effector_index"], r["frame_id"]): r["peak_type"] for r in path.path_peaks(points).collect()}
    # Known values of the default run.
    assert peaks == {
        (1, "frame_6"): "positive",
        (1, "frame_11"): "crossover",
        (1, "frame_17"): "negative",
        (2, "frame_6"): "positive",
        (2, "frame_9"): "crossover",
        (2, "frame_17"): "negative",
        (2, "frame_19"): "crossover",
        (3, "frame_7"): "positive",
        (3, "frame_9"): "crossover",
        (3, "frame_17"): "negative",
        (3, "frame_19"): "crossover",
    }
    knots = {(r["effector_index"], r["frame_id"]): r["knot_index"] for r in path.path_knots(points).collect()}
    assert knots == {
        (effector, f"frame_{frame}"): frame - first
        for effector, first in ((1, 7), (2, 7), (3, 8))
        for frame in range(first, 17)
    }


def test_default_path_tables(default_run):
    tables = path.path_tables(path.path_points(default_run[4], default_run[3]))
    counts = {name: rows.count() for name, rows in tables.items()}
    assert counts == {"curvatures": 60, "peaks": 11, "tangents": 60, "bisectors": 60, "knots": 29}
    lengths = tables["bisectors"].filter("bisector_x IS NOT NULL").select(F.hypot("bisector_x", "bisector_y").alias("n"))
    assert lengths.count() == 54
    assert all(r["n"] == pytest.approx(1.0) for r in lengths.collect())
    tables.release()


def test_two_motions_stay_apart(spark):
    proposals = motion.propose_motions(spark, 2)
    motions, joints = motion.motion_roots(proposals), motion.motion_joints(proposals)
    animations, frames = sweep.sweep(joints, 20)
    assert sorted(r["animation_id"] for r in animations.collect()) == ["anim_1", "anim_2"]
    assert frames.select("frame_id").distinct().count() == 40
    assert kinematics.effector_table(motions, joints, animations, frames).count() == 2 * 4 * 20


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_ids_do_not_depend_on_partitions(spark, partitions):
    proposals = motion.propose_motions(spark, 5).repartition(partitions)
    joints = motion.motion_joints(proposals)
    rows = sweep.sweep(joints, 3)[1].orderBy("animation_id", "frame_index").collect()
    assert [r["frame_id"] for r in rows] == [f"frame_{i + 1}" for i in range(15)]


def test_no_joints_and_one_frame(spark):
    empty = spark.createDataFrame([("motion_0", 0)], "motion_id string, joint_count int")
    assert motion.motion_joints(empty).count() == 0
    joints = motion.motion_joints(motion.propose_motions(spark, 1))
    frames = sweep.sweep(joints, 1)[1].collect()
    assert [(r["frame_index"], r["time"]) for r in frames] == [(0, 0.0)]


def test_long_ranges_are_blocks(spark):
    rows = spark.createDataFrame([("a", 25), ("b", 3), ("c", 0), ("d", 10)], "k string, n int")
    found = {}
    for r in expand_range(rows, "n", "i", block=10).collect():
        found.setdefault(r["k"], []).append(r["i"])
    assert {k: sorted(v) for k, v in found.items()} == {"a": list(range(25)), "b": [0, 1, 2], "d": list(range(10))}


def long_inputs(spark, counts=(3, 40, 150)):
    proposals = spark.createDataFrame(
        [(f"motion_{i}", count) for i, count in enumerate(counts)], "motion_id string, joint_count int"
    )
    motions, joints = motion.motion_roots(proposals), motion.motion_joints(proposals)
    joints = joints.withColumn("orientation_phase_offset", F.col("joint_index") * 0.1)
    return motions, joints, *sweep.sweep(joints, 4)


def brute_effectors(inputs):
    motions, joints, animations, frames = (t.collect() for t in inputs)
    by_motion = {m["motion_id"]: m for m in motions}
    chains = {}
    for j in sorted(joints, key=lambda j: j["joint_index"]):
        chains.setdefault(j["motion_id"], []).append(j)
    motion_of = {a["animation_id"]: a["motion_id"] for a in animations}
    found = {}
    for f in frames:
        m, t = by_motion[motion_of[f["animation_id"]]], f["time"]
        x = m["root_velocity_magnitude"] * math.cos(m["root_velocity_orientation"]) * t
        y = m["root_velocity_magnitude"] * math.sin(m["root_velocity_orientation"]) * t
        heading = 0.0
        for j in chains[m["motion_id"]]:
            x += j["position_x"] * math.cos(heading)
            y += j["position_x"] * math.sin(heading)
            heading += j["orientation_amplitude"] * math.sin(
                j["orientation_phase"] * t + j["orientation_phase_offset"]
            )
            found[f["animation_id"], f["frame_id"], j["joint_index"]] = (x, y, heading)
    return found


@pytest.mark.parametrize("limit", [0, 10, 64, 1000])
def test_chains_of_any_length(spark, limit):
    inputs = long_inputs(spark)
    rows = kinematics.effector_table(*inputs, limit=limit).collect()
    expected = brute_effectors(inputs)
    assert len(rows) == len(expected)
    for r in rows:
        found = (r["effector_position_x"], r["effector_position_y"], r["effector_orientation"])
        assert found == pytest.approx(expected[r["animation_id"], r["frame_id"], r["effector_index"]], abs=1e-9)


@pytest.mark.parametrize("longest", [1, 2, 8, 9])
def test_short_chains_by_both_routes(spark, longest):
    inputs = long_inputs(spark, range(1, longest + 1))
    expected = brute_effectors(inputs)
    posed = kinematics.posed_frames(*inputs)
    rows = kinematics.explode_effectors(posed).collect()
    assert len(rows) == len(expected)
    for r in rows:
        found = (r["effector_position_x"], r["effector_position_y"], r["effector_orientation"])
        assert found == pytest.approx(expected[r["animation_id"], r["frame_id"], r["effector_index"]], abs=1e-12)
    assert posed.filter(F.size("joints") != F.size("effectors")).count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_of_any_size(spark, block):
    inputs = long_inputs(spark)
    rows = kinematics.resolve_long_chains(*inputs, limit=10, block_joints=block).collect()
    expected = {k: v for k, v in brute_effectors(inputs).items() if k[0] != "anim_1"}
    assert len(rows) == len(expected)
    for r in rows:
        found = (r["effector_position_x"], r["effector_position_y"], r["effector_orientation"])
        assert found == pytest.approx(expected[r["animation_id"], r["frame_id"], r["effector_index"]], abs=1e-9)


def test_documents_of_chains_of_any_length(spark):
    inputs = long_inputs(spark)
    expected = brute_effectors(inputs)
    rows = kinematics.unnest_effectors(kinematics.document_table(*inputs, limit=10, block_joints=60))
    blocks = {}
    for r in rows.collect():
        frame = (int(r["animation_id"][5:]) - 1) * 4 + r["page"] * 4096 + r["frame_position"] + 1
        index = r["joint_page"] * 60 + r["effector_position"]
        found = (r["position_x"], r["position_y"], r["orientation"])
        assert found == pytest.approx(expected[r["animation_id"], f"frame_{frame}", index], abs=1e-9)
        blocks.setdefault(r["animation_id"], set()).add(r["joint_page"])
    assert rows.count() == len(expected)
    assert blocks == {"anim_1": {0}, "anim_2": {0}, "anim_3": {0, 1, 2}}


def test_large_fan_out_side_is_not_broadcast(spark, monkeypatch, default_run):
    monkeypatch.setattr(kinematics, "SMALL_ENTRIES", 0)
    motions, joints, animations, frames, effectors = default_run
    again = kinematics.effector_table(motions, joints, animations, frames)
    assert again.exceptAll(effectors).count() == 0 and again.count() == 80


def test_documents_are_ordered_and_paged(spark, default_run):
    posed = kinematics.posed_frames(*default_run[:4])
    whole = kinematics.animation_documents(posed).collect()
    assert len(whole) == 1 and whole[0]["page"] == 0
    frames = whole[0]["animations"][0]["frames"]
    assert [f["time"] for f in frames] == sorted(f["time"] for f in frames)
    assert [j["position_x"] for j in frames[0]["joints"]] == [0.0, 1.0, 1.0, 1.0]
    pages = kinematics.unnest_frames(kinematics.animation_documents(posed, page_frames=6))
    assert pages.count() == 20 and pages.select("page").distinct().count() == 4
    motions, joints = default_run[:2]
    paged = motion.motion_documents(motions, joints, page_joints=3)
    assert {(r["page"], len(r["motions"][0]["joints"])) for r in paged.collect()} == {(0, 3), (1, 1)}


def brute_tree(joints):
    by_id = {j[0]: j for j in joints}
    done = {}

    def place(joint_id, seen):
        if joint_id in done:
            return done[joint_id]
        if joint_id in seen or joint_id not in by_id:
            return None
        _, parent, x, y, turn = by_id[joint_id]
        if parent is None:
            done[joint_id] = (x, y, turn)
        else:
            up = place(parent, seen | {joint_id})
            if up is None:
                return None
            done[joint_id] = (up[0] + x * math.cos(up[2]), up[1] + y * math.sin(up[2]), up[2] + turn)
        return done[joint_id]

    for joint_id in by_id:
        place(joint_id, frozenset())
    return done


def test_tree_of_every_shape(spark):
    rng = random.Random(3)
    value = lambda: rng.random() * 2 - 1
    joints = [(0, None, value(), value(), value())]
    joints += [(i, i - 1, value(), value(), value()) for i in range(1, 60)]  # one long chain
    joints += [(i, 0, value(), value(), value()) for i in range(100, 400)]  # one crowded parent
    joints += [(i, rng.randrange(100, i), value(), value(), value()) for i in range(400, 500)]
    joints += [(900, 901, 1.0, 1.0, 1.0), (901, 902, 1.0, 1.0, 1.0), (902, 900, 1.0, 1.0, 1.0)]  # a cycle
    joints += [(950, 900, 1.0, 1.0, 1.0), (960, 12345, 1.0, 1.0, 1.0)]  # off the cycle, no parent
    schema = (
        "joint_id bigint, parent_id bigint, local_position_x double, local_position_y double,"
        " local_orientation double"
    )
    rows = kinematics.resolve_tree(spark.createDataFrame(joints, schema)).collect()
    expected = brute_tree(joints)
    assert {r["joint_id"] for r in rows} == set(expected) and len(rows) == len(expected) == 460
    for r in rows:
        assert (r["position_x"], r["position_y"], r["orientation"]) == pytest.approx(
            expected[r["joint_id"]], abs=1e-9
        )


def test_refine_keeps_the_grid_and_drops_repeats(spark):
    schema = (
        "animation_id string, effector_index int, lod_index int, frame_index int, time double,"
        " resolution int, end_frame_time double, x double, y double, curvature double,"
        " is_positive_peak boolean, is_negative_peak boolean, is_crossover boolean"
    )
    rows = [
        ("anim_1", 1, 0, 0, 0.0, 4, 0.75, 0.0, 0.0, 2.0, True, False, None),
        ("anim_1", 1, 0, 1, 0.25, 4, 0.75, 0.0, 0.0, -2.0, False, True, True),
        ("anim_1", 1, 0, 2, 0.5, 4, 0.75, 0.0, 0.0, 0.1, False, False, False),
    ]
    refined = sweep.refine(spark.createDataFrame(rows, schema)).collect()
    places = sorted((r["frame_index"], r["curvature"] is None) for r in refined)
    assert places == [(0, False), (1, True), (2, False), (3, True)]
    assert all(r["lod_index"] == 1 for r in refined)
    assert sum(r["h"] is None for r in refined) == 2


def test_long_chains_by_merged_groups(spark, monkeypatch):
    """Small groups and no broadcast: two levels of blocks, and no hash table that holds joints."""
    monkeypatch.setattr(kinematics, "SMALL_ENTRIES", 0)
    monkeypatch.setattr(kinematics, "GROUP_BLOCKS", 3)
    inputs = long_inputs(spark)
    table = kinematics.resolve_long_chains(*inputs, limit=10, block_joints=7)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text
    assert not re.search(r"(?:BroadcastExchange|ShuffledHashJoin)(?:(?!Exchange).)*chain#", text)
    expected = {k: v for k, v in brute_effectors(inputs).items() if k[0] != "anim_1"}
    rows = table.collect()
    assert len(rows) == len(expected)
    for r in rows:
        found = (r["effector_position_x"], r["effector_position_y"], r["effector_orientation"])
        assert found == pytest.approx(expected[r["animation_id"], r["frame_id"], r["effector_index"]], abs=1e-9)


@pytest.mark.parametrize("limit", [0, 64])
def test_a_repeated_joint_raises_on_every_route(spark, limit):
    motions, joints, animations, frames = long_inputs(spark, [3])
    twice = joints.unionByName(joints.filter("joint_index = 1"))
    with pytest.raises(Exception, match="joint_index is repeated"):
        kinematics.effector_table(motions, twice, animations, frames, limit=limit).collect()
    rows = kinematics.oscillate_joints(kinematics.animation_joints(motions, twice, animations, frames))
    local = rows.select("animation_id", "frame_id", "joint_index", "position_x", "orientation")
    with pytest.raises(Exception, match="joint_index is repeated"):
        kinematics.resolve_chains(local).collect()


TREE = (
    "joint_id bigint, parent_id bigint, local_position_x double, local_position_y double,"
    " local_orientation double"
)


@pytest.mark.parametrize("small_hubs", [100, 0])
def test_crowded_ancestors(spark, monkeypatch, small_hubs):
    """Hubs by broadcast and by salted parts give the same places as one plain join."""
    monkeypatch.setattr(kinematics, "SMALL_HUBS", small_hubs)
    rng = random.Random(5)
    value = lambda: rng.random() * 2 - 1
    joints = [(i, None if i == 0 else i - 1 if i < 20 else rng.choice((0, 7, 19, i - 1)), value(), value(), value()) for i in range(400)]
    rows = kinematics.resolve_tree(spark.createDataFrame(joints, TREE), hub_children=30).collect()
    expected = brute_tree(joints)
    assert {r["joint_id"] for r in rows} == set(expected) and len(rows) == 400
    for r in rows:
        assert (r["position_x"], r["position_y"], r["orientation"]) == pytest.approx(expected[r["joint_id"]], abs=1e-9)


def test_rounds_and_rows_written_by_trees(spark, monkeypatch):
    """A star takes one round; a path of 100 takes seven, and finished joints are not written again."""
    written = []
    keep = kinematics.stored

    def counted(rows, name):
        table = keep(rows, name)
        if name == "tree":
            written.append(table.count())
        return table

    monkeypatch.setattr(kinematics, "stored", counted)
    star = [(i, None if i == 0 else 0, 1.0, 1.0, 0.1) for i in range(100)]
    assert len(kinematics.resolve_tree(spark.createDataFrame(star, TREE), hub_children=10).collect()) == 100
    assert written == [100, 99]
    written.clear()
    line = [(i, None if i == 0 else i - 1, 1.0, 1.0, 0.1) for i in range(100)]
    assert len(kinematics.resolve_tree(spark.createDataFrame(line, TREE)).collect()) == 100
    # After k rounds the joints of depth under 2^k are finished.
    assert written == [100, 99, 98, 96, 92, 84, 68, 36]


def test_a_repeated_joint_of_a_tree_raises(spark):
    joints = [(0, None, 0.0, 0.0, 0.0), (1, 0, 1.0, 1.0, 0.0), (1, 0, 2.0, 2.0, 0.0)]
    with pytest.raises(ValueError, match="joint_id 1 is repeated"):
        kinematics.resolve_tree(spark.createDataFrame(joints, TREE))
