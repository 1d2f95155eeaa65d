"""The stages from motion proposals to path tables, each reading and writing stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from arcwise import schemas
from arcwise.operators import kinematics, motion, path, shapes, sweep, validate
from arcwise.sources.files import read_csv, write_csv, write_json
from arcwise.sources.outputs import read_output, write_outputs

TABLES = {
    "motion_proposals": schemas.MOTION_PROPOSALS,
    "motions": schemas.MOTIONS,
    "motion_joints": schemas.MOTION_JOINTS,
    "animations": schemas.ANIMATIONS,
    "animation_frames": schemas.ANIMATION_FRAMES,
    "animation_joints": schemas.ANIMATION_JOINTS,
    "animation_effectors": schemas.ANIMATION_EFFECTORS,
    "path_curvatures": schemas.PATH_CURVATURES,
    "path_curvature_peaks": schemas.PATH_CURVATURE_PEAKS,
    "path_tangents": schemas.PATH_TANGENTS,
    "path_bisectors": schemas.PATH_BISECTORS,
    "spline_knots": schemas.SPLINE_KNOTS,
    "refined_frames": schemas.REFINED_FRAMES,
}

PATH_TABLES = {
    "curvatures": "path_curvatures",
    "peaks": "path_curvature_peaks",
    "tangents": "path_tangents",
    "bisectors": "path_bisectors",
    "knots": "spline_knots",
}


class Store:
    """One folder of tables, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return read_csv(self.spark, f"{self.path(name)}.csv", TABLES[name])

    def write(self, name: str, rows: DataFrame) -> None:
        write_csv(rows, f"{self.path(name)}.csv")

    def write_documents(self, name: str, documents: DataFrame) -> None:
        write_json(documents, f"{self.path(name)}.json")


def propose_motions(store: Store, motion_count: int = 1) -> None:
    store.write("motion_proposals", motion.propose_motions(store.spark, motion_count))


def build_motions(store: Store) -> None:
    proposals = store.read("motion_proposals")
    motions, joints = motion.motion_roots(proposals), motion.motion_joints(proposals)
    store.write("motions", motions)
    store.write("motion_joints", joints)
    store.write_documents("motions", motion.motion_documents(motions, joints).select("motions"))


def propose_animations(store: Store, mode: str = "sweep", resolution: int = 20) -> None:
    """``sweep``: a uniform grid for every motion. ``refine``: finer frames around path features."""
    if mode == "refine":
        animations, frames = store.read("animations"), store.read("animation_frames")
        features = path.feature_table(path.path_points(store.read("animation_effectors"), frames))
        refined = sweep.refine(sweep.refinable(features, animations, frames))
        store.write("refined_frames", refined.select(*schemas.REFINED_FRAMES.names))
        return
    if mode != "sweep":
        raise ValueError(f"unknown mode {mode!r}; known: sweep, refine")
    animations, frames = sweep.sweep(store.read("motion_joints"), resolution)
    store.write("animations", animations)
    store.write("animation_frames", frames)


def animate(store: Store) -> None:
    inputs = [store.read(name) for name in ("motions", "motion_joints", "animations", "animation_frames")]
    store.write("animation_joints", kinematics.animation_joints(*inputs))
    store.write("animation_effectors", kinematics.effector_table(*inputs))
    documents = kinematics.document_table(*inputs)
    store.write_documents("animations", documents.select("animations"))


def analyse_paths(store: Store) -> None:
    """All five tables come from one job, in Parquet; the CSV tables are copies of its outputs."""
    points = path.path_points(store.read("animation_effectors"), store.read("animation_frames"))
    folder = store.path("path_outputs")
    write_outputs(path.path_outputs(points), folder)
    for output, name in PATH_TABLES.items():
        store.write(name, read_output(store.spark, folder, output, TABLES[name].names))


def picture_tables(store: Store) -> dict[str, DataFrame]:
    """The tables behind the pictures, for all animations."""
    effectors, frames = store.read("animation_effectors"), store.read("animation_frames")
    curvatures, peaks = store.read("path_curvatures"), store.read("path_curvature_peaks")
    features = shapes.effector_features(
        effectors, frames, [curvatures, peaks, store.read("path_tangents"), store.read("path_bisectors")]
    )
    fields = ["x", "y", "peak_type", "tangent", "bisector_x", "bisector_y"]
    drawn = path.PathColumns(x="x", y="y")
    return {
        "polylines": shapes.polylines(features, fields),
        "poses": shapes.poses(features, fields),
        "curvature_series": shapes.curvature_series(frames, curvatures, peaks),
        "path_segments": shapes.path_segments(features, drawn),
        "path_segment_phases": shapes.path_segment_phases(features, drawn),
        "point_phases": shapes.point_phases(features, drawn),
        "point_whiskers": shapes.whiskers(features, drawn),
        "peak_whiskers": shapes.whiskers(features, drawn, shapes.PEAK_WHISKER, peaks_only=True),
    }


def check(store: Store) -> DataFrame:
    """Validation results of all stored tables: what they say cell by cell, then the rules between them.

    A table with cells that do not read as declared is reported by the first part; the rules read it
    cell by cell too, with NULL for such a cell.
    """
    rules = [rule for rule in validate.standard_rules() if not isinstance(rule, validate.HasSchema)]
    names = list(dict.fromkeys(rule.table for rule in rules))
    cells = [validate.stored_cells(store.spark, f"{store.path(name)}.csv", name, TABLES[name]) for name in names]
    tables = {name: validate.lenient_csv(store.spark, f"{store.path(name)}.csv", TABLES[name]) for name in names}
    return reduce(DataFrame.unionByName, [*cells, validate.validate(tables, rules)])


def run_all(spark: SparkSession, folder: str, motion_count: int = 1, resolution: int = 20) -> Store:
    store = Store(spark, folder)
    propose_motions(store, motion_count)
    build_motions(store)
    propose_animations(store, resolution=resolution)
    animate(store)
    analyse_paths(store)
    return store
