"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.geometry import rounded
from arcwise.operators import kinematics, motion, path, samples, shapes, state, sweep, validate
from arcwise.operators.series import split_series
from arcwise.plans import bindings as b
from arcwise.plans.bindings import COMPARE_DIGITS, EVENT_PATHS, RESOLUTION
from arcwise.session import scratch_path, stored
from arcwise.sources.files import Source, load_sources, read_csv, read_json, write_csv, write_json
from arcwise.sources.outputs import read_output, write_outputs

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _six(rows: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    """DOUBLE columns rounded to six places, except those in ``keep``."""
    return rows.select(
        *[
            rounded(F.col(name), places).alias(name) if kind == "double" and name not in keep else F.col(name)
            for name, kind in rows.dtypes
        ]
    )


# -- files --------------------------------------------------------------------------------------


@query
def csv_round_trip(spark, folder):
    documents = b.table(spark, folder, "documents")
    target = scratch_path(spark, "documents-csv")
    write_csv(documents, target, multi_line=True)
    return read_csv(spark, target, documents.schema, multi_line=True)


@query
def json_round_trip(spark, folder):
    parts = b.table(spark, folder, "part")
    target = scratch_path(spark, "part-json")
    write_json(parts, target)
    return read_json(spark, target, parts.schema)


# -- motions ------------------------------------------------------------------------------------


@query
def motion_proposals(spark, folder):
    """A motion per order, with a joint per line number."""
    return motion.proposals_of(b.table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query
def motion_roots(spark, folder):
    return b.customer_motions(spark, folder)[0]


@query
def motion_joints(spark, folder):
    return b.customer_motions(spark, folder)[1]


@query
def motion_documents(spark, folder):
    documents = motion.motion_documents(*b.customer_motions(spark, folder))
    return motion.unnest_motion_documents(documents)


# -- frame grids --------------------------------------------------------------------------------


@query
def sweep_animations(spark, folder):
    return sweep.sweep_animations(b.customer_motions(spark, folder)[1], RESOLUTION)


@query
def sweep_frames(spark, folder):
    return b.customer_animations(spark, folder)[3]


@query
def sweep_frames_finer(spark, folder):
    animations = sweep.sweep_animations(b.customer_motions(spark, folder)[1], RESOLUTION)
    return sweep.sweep_frames(animations, RESOLUTION, lod_index=1)


def _refinable(spark, folder):
    """Event paths as a measured grid: frame = place of the event, resolution = number of events."""
    series = path.feature_series(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS)
    series = series.numbered("position").totals(
        {"samples": F.count(F.lit(1)), "end_frame_time": F.max("time")}
    )
    return series.table().select(
        F.concat(F.lit("anim_"), "user_id").alias("animation_id"),
        F.lit(1).alias("effector_index"),
        F.lit(0).alias("lod_index"),
        F.col("position").cast("int").alias("frame_index"),
        "time",
        F.col("samples").cast("int").alias("resolution"),
        "end_frame_time",
        "x",
        "y",
        "curvature",
        *sweep.FEATURE_FLAGS,
    )


@query
def refine_pivots(spark, folder):
    return _six(sweep.refine_pivots(_refinable(spark, folder)))


@query
def refine_frames(spark, folder):
    return _six(sweep.refine(_refinable(spark, folder)))


# -- kinematics ---------------------------------------------------------------------------------


@query
def animation_roots(spark, folder):
    motions, _, animations, frames = b.customer_animations(spark, folder)
    return _six(kinematics.animation_roots(motions, animations, frames), "time")


@query
def root_translation(spark, folder):
    motions, _, animations, frames = b.customer_animations(spark, folder)
    return _six(kinematics.translate_roots(kinematics.animation_roots(motions, animations, frames)), "time")


@query
def animation_joints(spark, folder):
    return kinematics.animation_joints(*b.customer_animations(spark, folder))


@query
def joint_oscillation(spark, folder):
    return _six(kinematics.oscillate_joints(kinematics.animation_joints(*b.customer_animations(spark, folder))))


@query
def fk_world(spark, folder):
    return _six(kinematics.effector_table(*b.customer_animations(spark, folder)))


@query
def fk_fold(spark, folder):
    return _six(kinematics.explode_effectors(kinematics.posed_frames(*b.customer_animations(spark, folder))))


@query
def fk_long_chains(spark, folder):
    """All chains by the route for long ones, in blocks of two joints."""
    inputs = b.customer_animations(spark, folder)
    return _six(kinematics.resolve_long_chains(*inputs, limit=0, block_joints=2))


@query
def fk_sparse_chains(spark, folder):
    """Chains of thousands of joints with gaps, in blocks of the usual size; sums of thousands, so three places."""
    return _six(kinematics.effector_table(*b.order_chains(spark, folder, 4)), places=3)


def _local_effectors(spark, folder):
    inputs = b.customer_animations(spark, folder)
    joints = kinematics.oscillate_joints(kinematics.animation_joints(*inputs))
    return kinematics.resolve_chains(
        joints.select("animation_id", "frame_id", "joint_index", "position_x", "orientation"),
        longest_chain=kinematics.measure(inputs[1], inputs[2]).longest_chain,
    ).drop("joint_index")


@query
def fk_effectors(spark, folder):
    return _six(_local_effectors(spark, folder))


@query
def fk_placed(spark, folder):
    motions, _, animations, frames = b.customer_animations(spark, folder)
    roots = kinematics.translate_roots(kinematics.animation_roots(motions, animations, frames))
    return _six(kinematics.place_effectors(_local_effectors(spark, folder), roots))


@query
def fk_tree(spark, folder):
    return _six(kinematics.resolve_tree(b.part_tree(spark, folder)))


@query
def fk_tree_star(spark, folder):
    """All parts under one root, which counts as a hub from 64 children on."""
    return _six(kinematics.resolve_tree(b.part_star(spark, folder), hub_children=64))


@query
def fk_tree_path(spark, folder):
    """A tree as deep as it has joints. Positions are sums of thousands, so three places; headings are sums of six."""
    placed = kinematics.resolve_tree(b.part_path(spark, folder))
    return _six(placed.withColumn("orientation", rounded(F.col("orientation"), 6)), "orientation", places=3)


@query
def animation_documents(spark, folder):
    documents = kinematics.document_table(*b.customer_animations(spark, folder))
    return _six(kinematics.unnest_effectors(documents))


@query
def unnest_documents(spark, folder):
    documents = kinematics.document_table(*b.customer_animations(spark, folder))
    frames = kinematics.unnest_frames(documents)
    return frames.select(
        "animation_id",
        "page",
        "joint_page",
        "frame_position",
        "time",
        F.size("effectors").alias("effector_count"),
        F.size("joints").alias("joint_count"),
    )


# -- paths --------------------------------------------------------------------------------------


@query
def path_points(spark, folder):
    inputs = b.customer_animations(spark, folder)
    return _six(path.path_points(kinematics.effector_table(*inputs), inputs[3]), "time")


@query
def path_curvature(spark, folder):
    return _six(path.curvatures(b.event_points(spark, folder), EVENT_PATHS))


@query
def path_tangent(spark, folder):
    return _six(path.tangents(b.event_points(spark, folder), EVENT_PATHS))


@query
def path_bisector(spark, folder):
    return _six(path.bisectors(b.event_points(spark, folder), EVENT_PATHS))


@query
def turning_angle(spark, folder):
    return _six(path.turning_angles(b.event_points(spark, folder), EVENT_PATHS))


def _curved(spark, folder):
    curved = path.curvatures(b.event_points(spark, folder), EVENT_PATHS)
    return curved, split_series(curved, EVENT_PATHS.keys, EVENT_PATHS.order)


@query
def curvature_extrema(spark, folder):
    flagged = path.flag_extrema(_curved(spark, folder)[1], COMPARE_DIGITS).table()
    return _six(
        flagged.select(
            "user_id", "event_id", "max_curvature", "min_curvature", "is_positive_peak", "is_negative_peak"
        )
    )


@query
def curvature_crossovers(spark, folder):
    flagged = path.flag_crossovers(_curved(spark, folder)[1], COMPARE_DIGITS).table()
    return flagged.select("user_id", "event_id", "is_crossover")


@query
def curvature_peaks(spark, folder):
    return _six(path.path_peaks(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS))


@query
def curvature_peaks_stored(spark, folder):
    return _six(path.peaks(_curved(spark, folder)[0], EVENT_PATHS, COMPARE_DIGITS))


@query
def spline_bounds(spark, folder):
    peaks = path.path_peaks(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS)
    return _six(path.spline_bounds(peaks, EVENT_PATHS))


@query
def spline_knots(spark, folder):
    return _six(path.path_knots(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS))


@query
def spline_knots_stored(spark, folder):
    curved = _curved(spark, folder)[0]
    return _six(path.knots(curved, path.peaks(curved, EVENT_PATHS, COMPARE_DIGITS), EVENT_PATHS))


@query
def feature_table(spark, folder):
    return _six(path.feature_table(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS))


@query
def path_tables(spark, folder):
    """The five outputs of one shared table, stacked: a point's key and the output's values."""
    return _stacked(path.path_tables(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS))


@query
def path_outputs_stored(spark, folder):
    """The same, written by one job and read back from its outputs."""
    target = scratch_path(spark, "path-outputs")
    write_outputs(path.path_outputs(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS), target)
    key = ["user_id", "event_id"]
    return _stacked({name: read_output(spark, target, name, [*key, *own]) for name, own in path.OUTPUTS.items()})


def _stacked(tables: dict[str, DataFrame]) -> DataFrame:
    def stacked(name: str, first: str | None = None, second: str | None = None, label: str | None = None) -> DataFrame:
        def value(column: str | None, kind: str):
            return F.lit(None).cast(kind) if column is None else F.col(column).cast(kind)

        return tables[name].select(
            F.lit(name).alias("output"),
            "user_id",
            "event_id",
            value(first, "double").alias("first_value"),
            value(second, "double").alias("second_value"),
            value(label, "string").alias("label"),
        )

    rows = stacked("curvatures", "curvature").unionByName(stacked("peaks", label="peak_type"))
    rows = rows.unionByName(stacked("tangents", "tangent"))
    rows = rows.unionByName(stacked("bisectors", "bisector_x", "bisector_y"))
    return _six(rows.unionByName(stacked("knots", "knot_index")))


# -- shapes -------------------------------------------------------------------------------------


@query
def feature_fan_in(spark, folder):
    points = b.event_points(spark, folder)
    series = split_series(points, EVENT_PATHS.keys, EVENT_PATHS.order)
    on = ["user_id", "event_id"]
    features = [
        path.curvatures(series, EVENT_PATHS),
        path.path_peaks(series, EVENT_PATHS, COMPARE_DIGITS),
        path.tangents(series, EVENT_PATHS),
        path.bisectors(series, EVENT_PATHS),
    ]
    return _six(shapes.fan_in(points, [table.drop("time") for table in features], on))


@query
def curvature_normalised(spark, folder):
    curved = path.curvatures(b.event_points(spark, folder), EVENT_PATHS)
    return _six(shapes.normalise_curvature(curved, EVENT_PATHS))


@query
def effector_polylines(spark, folder):
    inputs = b.customer_animations(spark, folder)
    points = kinematics.effector_table(*inputs, keep=("frame_index", "time"))
    lines = shapes.polylines(points, ["time", "effector_position_x", "effector_position_y"])
    return _six(shapes.unnest_lines(lines), "time")


@query
def frame_poses(spark, folder):
    inputs = b.customer_animations(spark, folder)
    points = kinematics.effector_table(*inputs, keep=("frame_index", "time"))
    lines = shapes.poses(points, ["effector_index", "effector_position_x", "effector_position_y"])
    return _six(shapes.unnest_lines(lines), "time")


@query
def curvature_series(spark, folder):
    """From tables of points, curvatures and peaks, as they are stored."""
    points = b.event_points(spark, folder).select(
        F.col("user_id").alias("animation_id"),
        F.lit(1).alias("effector_index"),
        F.col("event_id").alias("frame_id"),
        "time",
        F.col("x").alias("effector_position_x"),
        F.col("y").alias("effector_position_y"),
    )
    series = split_series(points, path.EFFECTOR_PATHS.keys, path.EFFECTOR_PATHS.order)
    curvatures = path.curvatures(series)
    peaks = path.path_peaks(series, digits=COMPARE_DIGITS)
    frames = points.select("animation_id", "frame_id", "time")
    pages = shapes.curvature_series(frames, curvatures, peaks, page_points=32)
    return _six(shapes.unnest_pages(pages.withColumnRenamed("animation_id", "user_id").drop("effector_index")))


@query
def path_segments(spark, folder):
    return _six(shapes.path_segments(b.event_points(spark, folder), EVENT_PATHS))


@query
def pose_segments(spark, folder):
    return _six(shapes.pose_segments(kinematics.effector_table(*b.customer_animations(spark, folder))))


def _features(spark, folder):
    return path.feature_table(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS)


@query
def segment_phase_curve(spark, folder):
    return _six(shapes.curve_segment_phases(_features(spark, folder), EVENT_PATHS))


@query
def segment_phase_path(spark, folder):
    return _six(shapes.path_segment_phases(_features(spark, folder), EVENT_PATHS))


@query
def point_phase(spark, folder):
    return _six(shapes.point_phases(_features(spark, folder), EVENT_PATHS))


@query
def bisector_whiskers(spark, folder):
    return _six(shapes.whiskers(_features(spark, folder), EVENT_PATHS))


@query
def peak_whiskers(spark, folder):
    return _six(shapes.whiskers(_features(spark, folder), EVENT_PATHS, shapes.PEAK_WHISKER, peaks_only=True))


@query
def animation_ids(spark, folder):
    peaks = path.path_peaks(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS)
    return shapes.animation_ids(peaks.select(F.concat(F.lit("anim_"), "user_id").alias("animation_id")))


# -- states and actions -------------------------------------------------------------------------

STATE_PARAMS = [
    state.StateParam("largest_value", "events", ("user_id",), "value"),
    state.StateParam("smallest_value", "events", ("user_id", "event_type"), "value", "min"),
    state.StateParam("orders_placed", "orders", ("o_custkey",), "o_orderkey", "count"),
    state.StateParam("mean_total", "orders", ("o_custkey", "o_orderstatus"), "o_totalprice", "avg"),
    state.StateParam("segment_balance", "customer", ("c_mktsegment",), "c_acctbal", "sum"),
]


@query
def state_params(spark, folder):
    names = sorted({param.source for param in STATE_PARAMS})
    tables = load_sources(
        spark, [Source(name, f"{folder}/{name}.parquet", format="parquet") for name in names]
    )
    return state.state_params(tables, STATE_PARAMS).withColumn("param_value", F.round("param_value", 6))


def _states(spark, folder):
    return state.state_features(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS)


@query
def state_features(spark, folder):
    return _six(_states(spark, folder))


PAGE_SAMPLES = 32


def _folded_pages(spark, folder):
    """The samples of all events: purchases come late and are folded into the state of the others."""
    points = b.event_points(spark, folder, "event_type")
    late = F.coalesce(F.col("event_type") == "purchase", F.lit(False))
    early = samples.state_samples(points.filter(~late), EVENT_PATHS, PAGE_SAMPLES)
    return samples.fold_samples(stored(early, "samples"), points.filter(late), EVENT_PATHS, PAGE_SAMPLES)


@query
def state_samples(spark, folder):
    pages = samples.state_samples(b.event_points(spark, folder), EVENT_PATHS, PAGE_SAMPLES)
    return _six(samples.unnest_samples(pages, EVENT_PATHS))


@query
def state_samples_folded(spark, folder):
    return _six(samples.unnest_samples(_folded_pages(spark, folder), EVENT_PATHS))


@query
def state_features_folded(spark, folder):
    return _six(samples.sample_features(_folded_pages(spark, folder), EVENT_PATHS, COMPARE_DIGITS))


@query
def state_defaults(spark, folder):
    """The whole state by pages of samples; what is not known yet has its default."""
    pages = samples.state_samples(b.event_points(spark, folder), EVENT_PATHS, PAGE_SAMPLES)
    features = samples.sample_features(pages, EVENT_PATHS, COMPARE_DIGITS)
    filled = state.with_defaults(samples.state_pages(pages, features, EVENT_PATHS))
    arrays = [v.name for v in state.STATE_VARIABLES if v.kind.startswith("array")]
    kept = ["user_id", "page", *[name for name in features.columns if name != "user_id"]]
    kept += [v.name for v in state.STATE_VARIABLES if v.name not in (*arrays, *kept)]
    return _six(filled.select(*kept, *[F.size(name).alias(name) for name in arrays]))


def _judged_states(spark, folder):
    """States in which part of the guesses have been checked and the true crossing is known."""
    checked = F.when(F.col("user_id") % 3 == 1, True).when(F.col("user_id") % 3 == 2, False)
    true_crossing = F.when(F.col("user_id") % 5 > 0, (F.col("user_id") % 5) / 10)
    return state.with_defaults(
        _states(spark, folder).withColumns(
            {"verified_guessed_zero_crossing": checked, "true_zero_crossing": true_crossing}
        )
    )


@query
def action_eligibility(spark, folder):
    scored = state.score_actions(_judged_states(spark, folder), ["user_id"])
    return scored.select("user_id", "action_id", "eligible")


@query
def action_scores(spark, folder):
    scored = state.score_actions(_judged_states(spark, folder), ["user_id"])
    return _six(scored.select("user_id", "action_id", "reward", "score", "priority"))


@query
def action_ranking(spark, folder):
    return state.rank_actions(_judged_states(spark, folder), ["user_id"])


# -- validation ---------------------------------------------------------------------------------

TABLE_RULES: list[validate.Rule] = [
    validate.NotNull("events", "user_id"),
    validate.Between("events", "value", 0.0, 200.0),
    validate.OneOf("events", "event_type", ("click", "view", "purchase", "error")),
    validate.Unique("events", ("user_id", "ts")),
    validate.Unique("lineitem", ("l_orderkey", "l_linenumber")),
    validate.References("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    validate.References("orders", ("o_custkey",), "customer", ("c_custkey",)),
    validate.References("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    validate.Contiguous("part", (), "p_partkey"),
    validate.Contiguous("conversations", ("conv_id",), "turn"),
    validate.NotNull("knots", "knot_index"),
    validate.Contiguous("knots", ("user_id",), "knot_index"),
    validate.References("knots", ("user_id", "event_id"), "events", ("user_id", "event_id")),
]


@query
def validate_tables(spark, folder):
    names = ("events", "lineitem", "orders", "customer", "supplier", "nation", "part", "conversations")
    tables = {name: b.table(spark, folder, name) for name in names}
    tables["knots"] = path.path_knots(b.event_points(spark, folder), EVENT_PATHS, COMPARE_DIGITS)
    return validate.validate(tables, TABLE_RULES)


@query
def validate_generated(spark, folder):
    """The standard rules over the generated chains, frames and effectors of all customers."""
    motions, joints, animations, frames = b.customer_animations(spark, folder)
    effectors = kinematics.effector_table(motions, joints, animations, frames)
    tables = {
        "motions": motions,
        "motion_joints": joints,
        "animations": animations,
        "animation_frames": frames.select("animation_id", "lod_index", "frame_index", "time", "frame_id"),
        "animation_effectors": effectors,
    }
    return validate.validate(tables, validate.standard_rules(tables))


@query
def validate_damaged(spark, folder):
    """Orders written as CSV with some cells, dates and rows damaged; the scan reports them and does not abort."""
    orders = b.table(spark, folder, "orders")
    key = F.col("o_orderkey")
    damaged = orders.select(
        F.when(key % 7 == 3, F.lit("no key")).otherwise(key.cast("string")).alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.when(key % 11 == 5, F.concat(F.lit("$"), F.col("o_totalprice"))).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(key % 13 == 1, F.lit("soon")).otherwise(F.col("o_orderdate").cast("string")).alias("o_orderdate"),
        "o_orderpriority",
    )
    target = scratch_path(spark, "orders-damaged")
    write_csv(damaged, target)
    return validate.stored_cells(spark, target, "orders", orders.schema).filter("rule <> 'header'")
