"""Ordered arrays, ranges and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Longest array one generator row may hold; longer ranges are cut into blocks of this size.
BLOCK = 8192


def running_sums(values: Column) -> Column:
    """Prefix sums of a short DOUBLE array: one more element than the input, starting at 0."""
    start = F.array(F.lit(0.0))
    return F.aggregate(values, start, lambda sums, v: F.array_append(sums, F.element_at(sums, -1) + v))


def ordered_list(order: list[str], fields: list[Column]) -> Column:
    """Aggregate rows into an array of structs sorted by ``order``, which is dropped again.

    ``collect_list`` promises no order after a shuffle, so the sort key travels inside.
    """
    packed = F.struct(F.struct(*order).alias("key"), F.struct(*fields).alias("item"))
    return F.transform(F.array_sort(F.collect_list(packed)), lambda entry: entry["item"])


def motion_number(text: Column) -> Column:
    """The number of ids that are exactly ``motion_0``, ``motion_1`` and so on, NULL for all others.

    Leading zeros, other names and more than 12 digits are no numbers, so that equal numbers mean
    equal ids and a number times the frames of a grid stays a BIGINT.
    """
    return F.regexp_extract(text, "^motion_(0|[1-9][0-9]{0,11})$", 1).try_cast("bigint")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Distribute few rows over all shuffle partitions before they are multiplied.

    The number is given outright: left to itself, adaptive execution would merge the small
    partitions by their size now, and one task would then write out all of their expansion.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, *keys)


def expand_range(rows: DataFrame, count: str, name: str, block: int = BLOCK) -> DataFrame:
    """One output row per 0 <= ``name`` < ``count`` (INT) for every input row.

    Short ranges are exploded in place. Long ones are first cut into blocks that are spread over
    the cluster, so neither one huge array nor one task ever holds a whole long range.
    """
    size = F.col(count)
    short = rows.filter((size > 0) & (size <= block)).withColumn(
        name, F.explode_outer(F.sequence(F.lit(0), size.cast("int") - 1))
    )
    first = F.col("block_start")
    long = (
        rows.filter(size > block)
        .withColumn("block_start", F.explode_outer(F.sequence(F.lit(0), size.cast("int") - 1, F.lit(block))))
        .transform(spread, *rows.columns, "block_start")
        .withColumn(
            name, F.explode_outer(F.sequence(first, F.least(first + (block - 1), size.cast("int") - 1)))
        )
        .drop("block_start")
    )
    return short.unionByName(long)
