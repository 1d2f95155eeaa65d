"""All stages through files, then the checks and the tables behind the pictures."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from arcwise import schemas
from arcwise.operators import kinematics, shapes
from arcwise.plans import stages
from arcwise.session import scratch_path, scratch_root
from arcwise.sources.files import Source, load_sources, read_csv, read_json, register_views


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return stages.run_all(spark, str(tmp_path_factory.mktemp("tables")), motion_count=3)


def test_table_sizes(store):
    counts = {name: store.read(name).count() for name in stages.TABLES if name != "refined_frames"}
    assert counts == {
        "motion_proposals": 3,
        "motions": 3,
        "motion_joints": 12,
        "animations": 3,
        "animation_frames": 60,
        "animation_joints": 240,
        "animation_effectors": 240,
        "path_curvatures": 180,
        "path_curvature_peaks": 33,
        "path_tangents": 180,
        "path_bisectors": 180,
        "spline_knots": 87,
    }


def test_stored_tables_pass_their_rules(store):
    failed = stages.check(store).filter("NOT passed").collect()
    assert failed == []


def test_refinement_of_stored_paths(store):
    stages.propose_animations(store, mode="refine")
    rows = store.read("refined_frames").filter("animation_id = 'anim_2' AND effector_index = 1").collect()
    measured = {r["frame_index"] for r in rows if r["curvature"] is not None}
    asked = {r["frame_index"] for r in rows if r["curvature"] is None}
    # Peaks and crossover at frames 6, 11 and 17 of 20, counted from 1.
    assert measured == {10, 20, 32} and asked == {9, 11, 19, 21, 31, 33}
    assert {r["lod_index"] for r in rows} == {1} and len(rows) == 9
    with pytest.raises(ValueError, match="unknown mode"):
        stages.propose_animations(store, mode="other")


def test_columns_in_another_order_are_refused(spark, tmp_path):
    (tmp_path / "swapped.csv").write_text("joint_count,motion_id\n4,motion_0\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path / "swapped.csv"), schemas.MOTION_PROPOSALS).collect()


def test_documents_read_back(spark, store):
    documents = read_json(spark, store.path("animations.json"), schemas.ANIMATION_DOCUMENTS)
    opened = kinematics.unnest_effectors(documents.withColumns({"page": F.lit(0), "joint_page": F.lit(0)}))
    assert opened.count() == 240
    motions = read_json(spark, store.path("motions.json"), schemas.MOTION_DOCUMENTS).collect()
    assert sorted(m["motions"][0]["id"] for m in motions) == ["motion_0", "motion_1", "motion_2"]
    line = next(Path(store.path("motions.json")).glob("part-*")).read_text().splitlines()[0]
    assert set(json.loads(line)["motions"][0]) == {"id", "root", "joints"}


def test_picture_tables(store):
    tables = stages.picture_tables(store)
    lines = {r["animation_id"]: r["lines"] for r in tables["polylines"].collect()}
    assert set(lines) == {"anim_1", "anim_2", "anim_3"}
    assert [line["effector_index"] for line in lines["anim_1"]] == [0, 1, 2, 3]
    assert all(len(line["points"]) == 20 for line in lines["anim_1"])
    poses = {r["animation_id"]: r["lines"] for r in tables["poses"].collect()}
    times = [pose["time"] for pose in poses["anim_2"]]
    assert times == sorted(times) and all(len(pose["points"]) == 4 for pose in poses["anim_2"])
    series = tables["curvature_series"].collect()
    assert len(series) == 9 and all(len(r["points"]) == 20 for r in series)
    assert tables["path_segments"].count() == 3 * 4 * 19
    assert tables["peak_whiskers"].count() == 3 * 6
    assert tables["point_whiskers"].count() == 3 * 54


def test_lines_in_small_pages_hold_the_same_points(store):
    effectors, frames = store.read("animation_effectors"), store.read("animation_frames")
    points = effectors.join(frames, ["animation_id", "frame_id"])
    fields = ["frame_id", "effector_position_x"]
    for nest in (shapes.polylines, shapes.poses):
        paged = nest(points, fields, page_points=7, page_lines=3)
        assert paged.count() == 3 * 3 * 2
        assert shapes.unnest_lines(paged).count() == 240
        assert shapes.unnest_lines(paged).select(*fields).exceptAll(points.select(*fields)).count() == 0


def test_named_sources(spark, store):
    tables = load_sources(spark, [Source("motions", store.path("motions.csv"), schemas.MOTIONS)])
    assert tables["motions"].count() == 3
    register_views(tables)
    assert spark.sql("SELECT count(*) FROM motions").first()[0] == 3
    with pytest.raises(ValueError, match="unknown format"):
        load_sources(spark, [Source("x", "nowhere", format="xml")])


class _Settings:
    """A session's settings, with or without a named checkpoint folder."""

    master = "local[8]"

    def __init__(self, named=None):
        self.named, self.checkpoint_dir = named, None
        self.conf = self.sparkContext = self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default

    def getConf(self):
        return self

    def getCheckpointDir(self):
        return self.checkpoint_dir

    def setCheckpointDir(self, folder):
        self.checkpoint_dir = folder


def test_scratch_folder_follows_the_cluster_setting():
    cluster = _Settings("hdfs:///shared")
    assert scratch_root(cluster) == cluster.checkpoint_dir == "hdfs:///shared"
    assert scratch_path(cluster, "t").startswith("hdfs:///shared/t-")
    assert scratch_path(cluster, "t") != scratch_path(cluster, "t")
    alone = _Settings()
    assert scratch_root(alone) == scratch_root(alone) == alone.checkpoint_dir
