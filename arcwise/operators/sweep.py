"""Frame grids: uniform sweeps over all motions, and refinement around path features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwise.functions.arrays import expand_range, motion_number, spread

TOTAL_TIME = 1.0


def frame_count(resolution: int, lod_index: int = 0) -> int:
    return resolution * 2**lod_index


def time_step(frames: int) -> float:
    """Time between frames; the last frame lies one sweep step before the end. One frame: at 0."""
    if frames < 2:
        return 0.0
    return (TOTAL_TIME - TOTAL_TIME / frames) / (frames - 1)


def _animation_id() -> Column:
    """Named after the motion's own number, so ids are unique without ranking all motions.

    A motion without one gives ``anim_id:`` and its id, which no number can look like.
    """
    number = motion_number(F.col("motion_id"))
    named = F.concat(F.lit("id:"), F.col("motion_id"))
    return F.concat(F.lit("anim_"), F.coalesce((number + 1).cast("string"), named))


def sweep_animations(joints: DataFrame, resolution: int) -> DataFrame:
    """One animation for every motion that has joints."""
    return (
        joints.select("motion_id")
        .distinct()
        .select(_animation_id().alias("animation_id"), "motion_id", F.lit(resolution).alias("resolution"))
    )


def sweep_frames(animations: DataFrame, resolution: int, lod_index: int = 0) -> DataFrame:
    """A uniform grid of ``resolution * 2^lod_index`` frames for every animation.

    ``frame_id`` counts on from motion to motion and follows from the row alone, so it does not
    depend on how the data is partitioned.
    """
    frames = frame_count(resolution, lod_index)
    number = motion_number(F.col("motion_id"))
    counted = (number * frames + F.col("frame_index") + 1).cast("string")
    named = F.concat(F.lit("id:"), F.col("motion_id"), F.lit(":"), F.col("frame_index") + 1)
    grid = expand_range(
        spread(animations.select("animation_id", "motion_id"), "animation_id").withColumn(
            "frames", F.lit(frames)
        ),
        "frames",
        "frame_index",
    )
    return grid.select(
        "animation_id",
        F.lit(lod_index).alias("lod_index"),
        "frame_index",
        (F.col("frame_index").cast("double") * F.lit(time_step(frames))).alias("time"),
        F.concat(F.lit("frame_"), F.coalesce(counted, named)).alias("frame_id"),
    )


def sweep(joints: DataFrame, resolution: int) -> tuple[DataFrame, DataFrame]:
    animations = sweep_animations(joints, resolution)
    return animations, sweep_frames(animations, resolution)


FEATURE_FLAGS = ("is_positive_peak", "is_negative_peak", "is_crossover")


def refinable(features: DataFrame, animations: DataFrame, frames: DataFrame) -> DataFrame:
    """Measured samples as ``refine`` wants them, from the features of effector paths."""
    ends = frames.groupBy("animation_id").agg(F.max("time").alias("end_frame_time"))
    grid = (
        frames.join(animations.select("animation_id", "resolution"), "animation_id")
        .join(ends, "animation_id")
        .select("animation_id", "frame_id", "lod_index", "frame_index", "resolution", "end_frame_time")
    )
    # Grids have a row per frame and grow with the features, so the two are merged.
    return features.join(grid.hint("merge"), ["animation_id", "frame_id"]).select(
        "animation_id",
        "effector_index",
        "lod_index",
        "frame_index",
        "time",
        "resolution",
        "end_frame_time",
        F.col("effector_position_x").alias("x"),
        F.col("effector_position_y").alias("y"),
        "curvature",
        *FEATURE_FLAGS,
    )


def _pivots(samples: DataFrame) -> DataFrame:
    """Samples at a peak or crossover, moved to the grid of the next level of detail.

    Needs animation_id, effector_index, lod_index, frame_index, time, resolution, end_frame_time,
    x, y, curvature and the three flags. The new grid spans the time from the sample to the end.
    """
    flagged = F.col(FEATURE_FLAGS[0]) | F.col(FEATURE_FLAGS[1]) | F.col(FEATURE_FLAGS[2])
    span = F.col("end_frame_time") - F.col("time")
    pivots = (
        samples.filter(flagged)
        .withColumns(
            {
                "lod_index": F.col("lod_index") + 1,
                "frame_count": F.col("resolution") * F.pow(F.lit(2.0), F.col("lod_index") + 1),
                "span": span,
            }
        )
        .withColumn("h", F.col("span") / F.col("frame_count"))
    )
    step = (F.col("span") - F.col("h")) / F.nullif(F.col("frame_count") - 1, F.lit(0.0))
    return (
        pivots.withColumns({"time_factor": step, "frame_index": F.col("frame_index") * 2})
        .withColumn("time", F.col("frame_index") * F.col("time_factor"))
        .drop("span", "end_frame_time")
    )


def refine_pivots(samples: DataFrame) -> DataFrame:
    """The refinement's starting points alone."""
    return _pivots(samples).drop("frame_count")


def refine(samples: DataFrame) -> DataFrame:
    """The pivots and, half a step to either side of each, new frames still to be measured.

    New frames outside the grid are left out. Two pivots next to each other ask for the same frame
    between them; the earlier time is kept. Not yet measured values are NULL.
    """
    pivots = _pivots(samples)
    key = ["animation_id", "effector_index", "lod_index", "frame_index"]
    side = F.explode(F.array(F.lit(-1), F.lit(1)))
    children = (
        pivots.withColumn("side", side)
        .withColumns(
            {
                "time": F.col("time") + F.col("side") * F.col("h"),
                "frame_index": F.col("frame_index") + F.col("side"),
                "x": F.lit(None).cast("double"),
                "y": F.lit(None).cast("double"),
                "curvature": F.lit(None).cast("double"),
                "is_positive_peak": F.lit(None).cast("boolean"),
                "is_negative_peak": F.lit(None).cast("boolean"),
            }
        )
        .filter((F.col("frame_index") >= 0) & (F.col("frame_index") < F.col("frame_count")))
        .drop("h", "frame_count")
    )
    rest = [name for name in children.columns if name not in (*key, "side")]
    children = (
        children.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct("time", "side")).alias("kept"))
        .select(*key, "kept.*")
    )
    return children.unionByName(pivots.drop("frame_count"), allowMissingColumns=True)
