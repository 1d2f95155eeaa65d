"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 4 bits differ in at most 2 bits in one of their 32-bit halves. Every
fingerprint emits, for each half, all values within one bit of it (half of that radius); two values
within 2 bits meet in the middle. Distinct fingerprints are shuffled on these values and colliding
pairs are verified. Where very many fingerprints collide on one value, they emit the ball of 2,081
values within 2 bits of the whole word instead, and all that meet there are within 4 bits for
certain: they are linked to the smallest one without comparing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.components import components
from arcwise.llm.frames import batch_of, map_batches, numbered, stored

HASH_SEED = 42
RADIUS = 4
PAIRED = 256  # fingerprints on one value that are compared pair by pair within a task
VOTE_ROWS = 1 << 15


def fingerprint(text: str, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 without words."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(part) + 1 for part in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = min(words, len(parts))
    cuts = zip(starts[: len(parts) - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in cuts], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTE_ROWS):
        bits = np.unpackbits(hashes[at : at + VOTE_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fp (the fingerprint as a signed long) and row_id of every row; a null text is empty."""
    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_column].dataType),
            T.StructField("row_id", T.LongType()),
            T.StructField("fp", T.LongType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text or "", words) for text in batch.column(2).to_pylist()]
            yield batch_of(schema, [batch.column(0), batch.column(1), np.array(found, np.uint64).view(np.int64)])

    rows = numbered(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "row_id")
    return map_batches(rows.select("id", "row_id", "text"), work, schema)


def _half_values() -> Column:
    flips = F.array(F.lit(0), *[F.lit(1 << bit) for bit in range(32)])
    low, high = F.expr("fp & 4294967295"), F.expr("shiftrightunsigned(fp, 32)")
    lows = F.transform(flips, lambda flip: low.bitwiseXOR(flip))
    highs = F.transform(flips, lambda flip: high.bitwiseXOR(flip).bitwiseOR(F.lit(1 << 32)))
    return F.explode(F.concat(lows, highs)).alias("value")


def _ball_values() -> Column:
    bits = [F.lit((1 << bit) if bit < 63 else -(1 << 63)) for bit in range(64)]
    one = F.array(F.lit(0), *bits)
    # Two flips of the same bit cancel, so pairs of distinct bits and pairs with 0 give the ball.
    two = F.flatten(F.transform(one, lambda x, i: F.transform(F.slice(one, i + 2, 64), lambda y: x.bitwiseXOR(y))))
    return F.explode(F.transform(F.concat(F.array(F.lit(0)), two), lambda flip: F.col("fp").bitwiseXOR(flip)))


LINKS = T.StructType(
    [T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("dense", T.BooleanType())]
)


def _links_of(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Index pairs within the radius that join all such pairs of at most PAIRED fingerprints.

    A spanning forest: fewer pairs than fingerprints, whatever the size of a group.
    """
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    one, two = [], []
    left = np.ones(len(fps), bool)
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        open_ones = [root]
        while open_ones:
            own = open_ones.pop()
            reached = np.flatnonzero(near[own] & left)
            left[reached] = False
            one.extend([own] * len(reached))
            two.extend(reached.tolist())
            open_ones.extend(reached.tolist())
    return one, two


def _verify(radius: int, paired: int):
    """Streams rows sorted by value; a run of up to ``paired`` is verified, a longer one only marked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_value, held, dense = None, np.zeros(0, np.uint64), False

        def finish(fps: np.ndarray, out: list) -> None:
            one, two = _links_of(fps, radius)
            if len(one):
                out.append((fps[one], fps[two], False))

        def marked(fps: np.ndarray, out: list) -> None:
            out.append((fps, fps, True))

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            out: list = []
            edges = np.flatnonzero(np.diff(values)) + 1
            bounds = np.concatenate([[0], edges, [len(values)]]) if len(values) else np.zeros(0, np.int64)
            sizes = np.diff(bounds)
            for k in range(len(sizes)):
                start, end = int(bounds[k]), int(bounds[k + 1])
                inner = 0 < k < len(sizes) - 1
                if inner and sizes[k] == 1:
                    continue
                value, run = values[start], fps[start:end]
                if value != open_value:
                    if len(held) > 1:
                        finish(held, out)
                    open_value, held, dense = value, run[:0], False
                if dense:
                    marked(run, out)
                    continue
                held = np.concatenate([held, run])
                if len(held) > paired:
                    marked(held, out)
                    held, dense = held[:0], True
            if out:
                yield _as_links(out)
        if len(held) > 1:
            out = []
            finish(held, out)
            if out:
                yield _as_links(out)

    return work


def _as_links(out: list) -> pa.RecordBatch:
    first = np.concatenate([a for a, _, _ in out]).view(np.int64)
    second = np.concatenate([b for _, b, _ in out]).view(np.int64)
    return batch_of(LINKS, [first, second, np.concatenate([np.full(len(a), dense) for a, _, dense in out])])


def fingerprint_links(distinct: DataFrame, paired: int = PAIRED) -> DataFrame:
    """a, b: links between distinct fingerprints that join all pairs within 4 bits.

    Every pair within 4 bits is a link itself or joined by links of pairs within 4 bits.
    """
    emitted = distinct.select(_half_values(), "fp")
    # One shuffle on the values; a value's rows are one row per distinct fingerprint and streamed.
    sorted_rows = emitted.repartition(F.col("value")).sortWithinPartitions("value")
    found = stored(map_batches(sorted_rows, _verify(RADIUS, paired), LINKS), "links")
    ball = found.filter("dense").select(F.col("a").alias("fp")).distinct().select(_ball_values().alias("value"), "fp")
    centre = ball.groupBy("value").agg(F.min("fp").alias("a"), F.max("fp").alias("top"))
    # A value with one fingerprint links nothing; the rest hang on the smallest one of their value. Neither side may be
    # broadcast: Spark takes a ball for as large as its fingerprint.
    stars = ball.hint("merge").join(centre.filter("a < top").hint("merge"), "value").filter("fp <> a").select("a", F.col("fp").alias("b"))
    return found.filter("NOT dense").select("a", "b").union(stars).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 4, id_column: str = "doc_id", text_column: str = "text", paired: int = PAIRED
) -> DataFrame:
    """One row per row of ``docs``: the id, fingerprint, component_id, kept and row_id.

    Fingerprints link at 4 or fewer differing bits; ``component_id`` is the smallest id reachable.
    A text without words, null ones too, has fingerprint zero and links like any other. Of each
    component the smallest id is ``kept``, of its repeated rows the first; null ids come last.
    ``row_id`` is the number of ``frames.numbered`` over ``docs``, which must be a stored Parquet table. An
    empty table gives an empty one; other columns are not read.
    """
    rows = stored(fingerprints(docs, words, id_column, text_column), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_id")).alias("first")
    distinct = stored(rows.groupBy("fp").agg(first), "distinct")
    links = stored(fingerprint_links(distinct.select("fp"), paired), "fplinks")
    member = components(links)
    joined = distinct.join(member, distinct.fp == member.node, "left")
    named = joined.select("fp", F.coalesce("component", "fp").alias("component"), "first")
    lowest = named.groupBy("component").agg(F.min("first").alias("lowest"))
    named = stored(named.join(lowest, "component").select("fp", "lowest"), "named")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("lowest.id").alias("component_id"),
        (F.col("row_id") == F.col("lowest.row_id")).alias("kept"),
        "row_id",
    )
