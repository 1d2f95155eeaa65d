"""The given tables seen as paths, motions and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.operators import kinematics, motion, sweep
from arcwise.operators.path import PathColumns

RESOLUTION = 20

# Curvatures are rounded to this many places before they are compared with each other.
COMPARE_DIGITS = 9

EVENT_PATHS = PathColumns(keys=("user_id",), time="time", tie="event_id", x="x", y="y")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _hours(ts: Column) -> Column:
    """Hours since the start of 2024, built from date and time of day so that no time zone matters."""
    days = F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date"))
    second = F.extract(F.lit("SECOND"), ts).cast("double")
    return (days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + second) / 3600


def event_points(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    """Each user's events as a path: hours to the right, value upwards; with ``more`` columns of the table."""
    hours = _hours(F.col("ts"))
    return table(spark, folder, "events").select(
        "user_id", "event_id", hours.alias("time"), hours.alias("x"), F.col("value").alias("y"), *more
    )


def customer_proposals(spark: SparkSession, folder: str) -> DataFrame:
    """A motion of 2 to 5 joints per customer."""
    return table(spark, folder, "customer").select(
        F.concat(F.lit("motion_"), "c_custkey").alias("motion_id"),
        (F.col("c_custkey") % 4 + 2).cast("int").alias("joint_count"),
    )


def customer_motions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    proposals = customer_proposals(spark, folder)
    return motion.motion_roots(proposals), motion.motion_joints(proposals)


def customer_animations(
    spark: SparkSession, folder: str, resolution: int = RESOLUTION
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Motions, joints, animations and frames of all customers."""
    motions, joints = customer_motions(spark, folder)
    animations, frames = sweep.sweep(joints, resolution)
    return motions, joints, animations, frames


def part_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a binary joint tree by key; the two lowest keys are roots."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("joint_id"),
        F.when(key > 1, F.floor(key / 2)).cast("bigint").alias("parent_id"),
        (F.col("p_size") / 50).alias("local_position_x"),
        (F.col("p_size") / 25).alias("local_position_y"),
        (F.col("p_retailprice") / 10000).alias("local_orientation"),
    )


def part_star(spark: SparkSession, folder: str) -> DataFrame:
    """All parts as children of the one of the smallest key."""
    parts = part_tree(spark, folder)
    return parts.withColumn("parent_id", F.when(F.col("joint_id") > 0, F.lit(0)).cast("bigint"))


def part_path(spark: SparkSession, folder: str) -> DataFrame:
    """Each part as the child of the part before it."""
    parts = part_tree(spark, folder)
    return parts.withColumn("parent_id", F.when(F.col("joint_id") > 0, F.col("joint_id") - 1))


def order_chains(
    spark: SparkSession, folder: str, resolution: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A chain of joints per line number, one joint per order that has such a line: long, with gaps.

    Lines repeat in the given table, so a joint sums or takes the largest of what its lines say.
    """
    lines = table(spark, folder, "lineitem")
    # Hardly any two lines share a key, so they are dealt first: hash tables then hold a task's share, not a file's.
    values = lines.select("l_linenumber", "l_orderkey", "l_quantity", "l_discount", "l_tax")
    dealt = values.repartition(kinematics.tasks_of(lines.count()), "l_linenumber", "l_orderkey")
    joints = dealt.groupBy("l_linenumber", "l_orderkey").agg(
        (F.sum("l_quantity") / 1000).alias("position_x"),
        (F.max("l_discount") / 10).alias("orientation_amplitude"),
        (F.max("l_tax") * 50).alias("orientation_phase"),
        (F.min("l_tax") * 30).alias("orientation_phase_offset"),
    )
    joints = joints.select(
        F.concat(F.lit("motion_"), "l_linenumber").alias("motion_id"),
        F.col("l_orderkey").cast("int").alias("joint_index"),
        "position_x",
        "orientation_amplitude",
        "orientation_phase",
        "orientation_phase_offset",
    )
    motions = motion.motion_roots(
        lines.select(F.concat(F.lit("motion_"), "l_linenumber").alias("motion_id"), F.lit(1).alias("joint_count")).distinct()
    )
    animations, frames = sweep.sweep(motions, resolution)
    return motions, joints, animations, frames
