"""Inputs that once gave wrong results: odd ids, sparse and repeated joints, odd texts, no shared folder."""

import pytest

from arcwise import session
from arcwise.operators import kinematics, shapes, sweep
from arcwise.sources.files import read_csv, write_csv

MOTIONS = (
    "motion_id STRING, root_orientation DOUBLE, root_velocity_orientation DOUBLE, root_velocity_magnitude DOUBLE"
)
JOINTS = (
    "motion_id STRING, joint_index INT, position_x DOUBLE, orientation_amplitude DOUBLE,"
    " orientation_phase DOUBLE, orientation_phase_offset DOUBLE"
)


def inputs_of(spark, chains, resolution=3):
    motions = spark.createDataFrame([(name, 0.0, 0.5, 1.0) for name in chains], MOTIONS)
    rows = [(name, k, 1.0 + k, 0.3, 1.0, 0.1 * k) for name, own in chains.items() for k in own]
    joints = spark.createDataFrame(rows, JOINTS)
    return motions, joints, *sweep.sweep(joints, resolution)


def test_ids_of_any_name_stay_apart(spark):
    names = ["walk_1", "run_1", "1", "5", "motion_4", "motion_04", "motion_999999999999999999", "motion_0", "id:walk_1"]
    inputs = inputs_of(spark, {name: [0, 1] for name in names})
    frames = inputs[3].collect()
    assert inputs[2].select("animation_id").distinct().count() == len(names)
    assert len({row.frame_id for row in frames}) == len(frames) == 3 * len(names)
    assert {row.animation_id for row in inputs[2].collect()} >= {"anim_5", "anim_1", "anim_id:walk_1"}
    assert kinematics.effector_table(*inputs).count() == 2 * 3 * len(names)


def test_sparse_chains_keep_their_joint_numbers_on_every_route(spark):
    inputs = inputs_of(spark, {"motion_0": [0, 2], "motion_1": [1, 4, 9], "motion_2": [0, 1, 2]})
    routes = []
    for limit in (0, 5, 8, 64):
        rows = kinematics.effector_table(*inputs, limit=limit).collect()
        found = {
            (r.animation_id, r.frame_id, r.effector_index): (round(r.effector_position_x, 9), round(r.effector_orientation, 9))
            for r in rows
        }
        assert len(found) == len(rows) == 3 * 8
        routes.append(found)
    assert all(route == routes[0] for route in routes)
    assert {key[2] for key in routes[0] if key[0] == "anim_2"} == {1, 4, 9}


def test_a_repeated_joint_raises(spark):
    inputs = inputs_of(spark, {"motion_0": [0, 1, 1]})
    with pytest.raises(Exception, match="joint_index is repeated"):
        kinematics.effector_table(*inputs).collect()


@pytest.mark.parametrize("joints", [64, 65])
def test_pages_do_not_depend_on_the_length_of_the_chain(spark, joints):
    inputs = inputs_of(spark, {"motion_0": range(joints)}, resolution=100)
    rows = kinematics.document_table(*inputs).collect()
    assert sorted((row.page, len(row.animations[0].frames)) for row in rows) == [(0, 64), (1, 36)]


def test_csv_gives_texts_back(spark, tmp_path):
    texts = ["  a  ", "", None, "b\\c", 'say "x"', "\\", '"', ",", "é", "\t", "\\N", 'a\\"b', "NULL", '""']
    rows = [(k, text) for k, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "k INT, text STRING")
    write_csv(table, str(tmp_path / "plain"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "plain"), table.schema).collect())) == rows
    rows += [(100, "a\nb"), (101, "a\r\nb\n"), (102, "\r")]
    table = spark.createDataFrame(rows, "k INT, text STRING")
    write_csv(table, str(tmp_path / "lines"), multi_line=True)
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "lines"), table.schema, multi_line=True).collect())) == rows
    with pytest.raises(Exception, match="line break"):
        write_csv(table, str(tmp_path / "refused"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)

        @staticmethod
        def getCheckpointDir():
            return None

    class Spark:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Spark())


def test_curvature_series_starts_from_measured_points(spark):
    frames = spark.createDataFrame([("a", f"f{k}", 0, k, float(k)) for k in range(4)],
                                   "animation_id STRING, frame_id STRING, lod_index INT, frame_index INT, time DOUBLE")
    curvatures = spark.createDataFrame([("a", 0, f"f{k}", 0.5 * k) for k in range(3)],
                                       "animation_id STRING, effector_index INT, frame_id STRING, curvature DOUBLE")
    peaks = spark.createDataFrame([("a", 0, "f2", "positive")], "animation_id STRING, effector_index INT, frame_id STRING, peak_type STRING")
    rows = shapes.unnest_pages(shapes.curvature_series(frames, curvatures, peaks)).orderBy("time").collect()
    assert [(row.time, row.curvature, row.peak_type) for row in rows] == [(0.0, 0.0, None), (1.0, 0.5, None), (2.0, 1.0, "positive")]
