"""Motion synthesis: proposals, root features, joint chains, nested motion documents."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.functions.arrays import expand_range, ordered_list


@dataclass(frozen=True)
class MotionDefaults:
    """Fixed values of a synthesised motion."""

    joint_count: int = 4
    root_orientation: float = 0.0
    root_velocity_orientation: float = math.pi * 1.1
    root_velocity_magnitude: float = 1.0
    bone_length: float = 1.0
    orientation_amplitude: float = 0.2
    orientation_phase: float = math.pi * 2.0
    orientation_phase_offset: float = 0.0


DEFAULTS = MotionDefaults()


def propose_motions(spark: SparkSession, motion_count: int, defaults: MotionDefaults = DEFAULTS) -> DataFrame:
    """``motion_count`` proposals ``motion_0``, ``motion_1``, ..."""
    return spark.range(motion_count).select(
        F.concat(F.lit("motion_"), F.col("id")).alias("motion_id"),
        F.lit(defaults.joint_count).alias("joint_count"),
    )


def proposals_of(rows: DataFrame, number: str, joints: str) -> DataFrame:
    """A proposal per ``number`` of a table: its motion is ``motion_<number>``, as long as its largest ``joints``.

    Rows without a number propose nothing; a motion has at least one joint.
    """
    chains = rows.filter(F.col(number).isNotNull()).groupBy(number).agg(F.max(joints).alias("joint_count"))
    return chains.select(
        F.concat(F.lit("motion_"), number).alias("motion_id"),
        F.greatest(F.coalesce("joint_count", F.lit(1)), F.lit(1)).cast("int").alias("joint_count"),
    )


def motion_roots(proposals: DataFrame, defaults: MotionDefaults = DEFAULTS) -> DataFrame:
    """Root orientation, heading and speed of each motion."""
    return proposals.select(
        "motion_id",
        F.lit(defaults.root_orientation).alias("root_orientation"),
        F.lit(defaults.root_velocity_orientation).alias("root_velocity_orientation"),
        F.lit(defaults.root_velocity_magnitude).alias("root_velocity_magnitude"),
    )


def motion_joints(proposals: DataFrame, defaults: MotionDefaults = DEFAULTS) -> DataFrame:
    """One row per joint. The first joint sits on the root; the last one does not swing."""
    is_first = F.col("joint_index") == 0
    is_last = F.col("joint_index") == F.col("joint_count") - 1
    chain = expand_range(proposals.select("motion_id", "joint_count"), "joint_count", "joint_index")
    return chain.select(
        "motion_id",
        "joint_index",
        F.when(is_first, 0.0).otherwise(defaults.bone_length).alias("position_x"),
        F.when(is_last, 0.0).otherwise(defaults.orientation_amplitude).alias("orientation_amplitude"),
        F.when(is_last, 0.0).otherwise(defaults.orientation_phase).alias("orientation_phase"),
        F.lit(defaults.orientation_phase_offset).alias("orientation_phase_offset"),
    )


# Joints per document. A chain that does not fit goes on in further documents of the same motion.
PAGE_JOINTS = 100_000


def motion_documents(motions: DataFrame, joints: DataFrame, page_joints: int = PAGE_JOINTS) -> DataFrame:
    """One nested document per motion: root features and the joints in chain order.

    Columns: ``motion_id``, ``page`` and ``motions`` (the document). ``page`` is 0 unless the chain
    is longer than ``page_joints``; then each page holds the next stretch of the chain.
    """
    chains = (
        joints.withColumn("page", F.floor(F.col("joint_index") / page_joints).cast("int"))
        .groupBy("motion_id", "page")
        .agg(
            ordered_list(
                ["joint_index"],
                [
                    F.col(name)
                    for name in (
                        "position_x",
                        "orientation_amplitude",
                        "orientation_phase",
                        "orientation_phase_offset",
                    )
                ],
            ).alias("joints")
        )
    )
    root = F.struct(
        F.col("root_orientation").alias("orientation"),
        F.col("root_velocity_orientation").alias("velocity_orientation"),
        F.col("root_velocity_magnitude").alias("velocity_magnitude"),
    )
    document = F.struct(F.col("motion_id").alias("id"), "root", "joints")
    return (
        motions.select("motion_id", root.alias("root"))
        .join(chains, "motion_id", "left")
        .select("motion_id", F.coalesce("page", F.lit(0)).alias("page"), F.array(document).alias("motions"))
    )


def unnest_motion_documents(documents: DataFrame) -> DataFrame:
    """Back to one row per joint, with its place in the document."""
    motion = documents.select("page", F.explode("motions").alias("motion"))
    return motion.select(
        F.col("motion.id").alias("motion_id"),
        "page",
        F.col("motion.root").alias("root"),
        F.posexplode_outer("motion.joints").alias("joint_position", "joint"),
    ).select("motion_id", "page", "joint_position", "root.*", "joint.*")
