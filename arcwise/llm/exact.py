"""Exact deduplication against an immutable snapshot, screened by static binary-fuse filters.

A snapshot's digests are dealt to buckets, and each bucket has one static filter. Incoming digests
are screened by their bucket's filter. What passes joins the snapshot's exact rows and is compared
byte for byte; duplicates within the incoming rows are grouped apart from the snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcwise.llm.frames import numbered, stored, with_keys

BUCKET_KEYS = 50_000
LEAST_BUCKETS = 128
SPACE = r"[\x20\x09-\x0D]"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and a seed."""
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


@dataclass
class FuseFilter:
    """A static three-wise binary-fuse filter: no false negative, false positives about 1 in 65,536."""

    seed: int
    segment: int
    segments: int
    prints: np.ndarray

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        start = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
        low = np.stack([h, h >> np.uint64(18), h >> np.uint64(36)]) & np.uint64(segment - 1)
        return ((start + np.arange(3, dtype=np.uint64)[:, None]) * np.uint64(segment) + low).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """From distinct 64-bit keys: peel slots that one key alone holds, fill them in reverse."""
        n = max(1, len(keys))
        segment = 1 << max(2, min(18, int(np.floor(np.log(n) / np.log(3.33) + 2.25)) if n > 1 else 2))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        for seed in range(1, 200):
            slots = int(n * factor) + 16
            segments = max(1, -(-slots // segment) - 2)
            size = (segments + 2) * segment
            h = _mixed(keys, seed)
            places = cls._places(h, segment, segments)
            count = np.zeros(size, np.int64)
            which = np.zeros(size, np.int64)
            for row in places:
                count += np.bincount(row, minlength=size)
                np.bitwise_xor.at(which, row, np.arange(len(keys)))
            rounds, left = [], len(keys)
            single = np.flatnonzero(count == 1)
            while len(single):
                peeled, first = np.unique(which[single], return_index=True)
                owned = single[first]
                rounds.append((peeled, owned))
                left -= len(peeled)
                touched = places[:, peeled]
                for row in touched:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(which, row, peeled)
                near = np.unique(touched)
                single = near[count[near] == 1]
            if left == 0:
                prints = np.zeros(size, np.uint16)
                mark = (h ^ (h >> np.uint64(32))).astype(np.uint16)
                for peeled, owned in reversed(rounds):
                    others = np.bitwise_xor.reduce(prints[places[:, peeled]], axis=0)
                    prints[owned] = mark[peeled] ^ others ^ prints[owned]
                return cls(seed, segment, segments, prints)
            factor *= 1.05
        raise ValueError("keys of a static filter must be distinct")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = _mixed(keys, self.seed)
        mark = (h ^ (h >> np.uint64(32))).astype(np.uint16)
        return np.bitwise_xor.reduce(self.prints[self._places(h, self.segment, self.segments)], axis=0) == mark

    def pack(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], "<i8").tobytes() + self.prints.tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> FuseFilter:
        return cls(*np.frombuffer(data[:24], "<i8").tolist(), np.frombuffer(data[24:], np.uint16))


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    data = b"".join(digests.to_pylist())
    return np.frombuffer(data, ">u8").reshape(-1, 4)[:, 1].astype(np.uint64)


def bucketed(digests: DataFrame, buckets: int) -> DataFrame:
    return digests.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def snapshot_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One static filter per bucket of distinct digests."""

    def build(table: pa.Table) -> pa.Table:
        filters = FuseFilter.build(np.unique(_keys(table.column("digest"))))
        return pa.table({"bucket": table.column("bucket")[:1], "filter": pa.array([filters.pack()], pa.binary())})

    return bucketed(digests, buckets).groupBy("bucket").applyInArrow(build, "bucket INT, filter BINARY")


def screened(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """The distinct digests that their bucket's filter lets pass; all digests of the snapshot do."""

    def screen(own: pa.Table, filters: pa.Table) -> pa.Table:
        digests = own.select(["digest"])
        if not own.num_rows or not filters.num_rows:
            return digests.slice(0, 0)
        passed = FuseFilter.unpack(filters.column("filter")[0].as_py()).holds(_keys(own.column("digest")))
        return digests.filter(pa.array(passed))

    left = bucketed(digests, buckets).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInArrow(screen, "digest BINARY")


def exact_groups(
    docs: DataFrame, in_snapshot: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256 and row_id.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; a null
    text is empty. Of equal texts the one with the most code points stays, then the smallest id; of
    repeated rows with one id exactly one stays; a null id comes last. ``in_snapshot`` tells, from
    columns of ``docs``, which rows make the snapshot (null: incoming); the groups do not depend on it.
    ``row_id`` is the number of ``frames.numbered`` over ``docs``, which must be a stored Parquet table.
    An empty table gives an empty one; other columns are not read.
    """
    texts = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(in_snapshot, F.lit(False)).alias("old"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    texts = numbered(texts, "row_id")
    bare = texts.withColumn("bare", normalised(F.col("text")))
    digested = bare.withColumn("digest", F.unhex(F.sha2("bare", 256)))
    rows = stored(digested.select("id", "row_id", "old", F.length("text").alias("points"), "digest"), "digests")

    # The longest text, then the smallest id, then the first row; ids count down, so null comes last.
    best = F.max(F.struct("points", (-F.col("id")).alias("down"), (-F.col("row_id")).alias("row"))).alias("best")
    groups = stored(rows.groupBy("digest", "old").agg(F.count("*").alias("size"), best), "groups")
    old, new = (groups.filter(F.col("old") == flag).select("digest") for flag in (True, False))
    buckets = max(LEAST_BUCKETS, -(-groups.count() // BUCKET_KEYS))
    passed = stored(screened(new, snapshot_filters(old, buckets), buckets), "passed")

    # Bytes of digests that passed, each text once per side: copies collapse before they are moved.
    sides = with_keys(digested.select("digest", "bare", "old"), passed, "digest", keep=True)
    sides = sides.distinct()
    proven = sides.filter("NOT old").join(sides.filter("old"), ["digest", "bare"], "left_semi")
    proven = stored(proven.select("digest").distinct(), "proven")

    matched = groups.join(proven.withColumn("proven", F.lit(True)), "digest", "left")
    side = F.when(F.col("proven"), F.lit(None)).otherwise(F.col("old"))
    whole = matched.groupBy("digest", side.alias("side")).agg(
        F.sum("size").alias("size"), F.max("best").alias("best"), F.collect_set("old").alias("sides")
    )
    whole = whole.select("digest", F.explode("sides").alias("old"), "size", "best")
    joined = rows.join(whole, ["digest", "old"])
    return joined.select(
        F.col("id").alias(id_column),
        (-F.col("best.down")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row_id") == -F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "row_id",
    )
