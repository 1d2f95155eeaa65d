"""Exact integer k-means with a pivot table (LAESA).

Distances of every vector to a few fixed pivots are computed once and stored with it. In each round
the centroids' distances to the same pivots bound all vector-to-centroid distances from below, as
|d(v, p) - d(c, p)| <= d(v, c) for each pivot p. The centroid of the smallest bound is measured
first; only centroids whose bound does not exceed that distance get an exact integer distance.

To the driver go ``PIVOT_SAMPLE`` vectors once and one row of sums per cluster and round, whatever
the number of vectors. To the tasks go the pivots and centroids: (pivots + clusters) x size integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, map_batches, stored
from arcwise.llm.vectors import integers, packed, unpacked, usable

PIVOT_SAMPLE = 512
"""Vectors among which the pivots are chosen: those of the smallest hashes."""
PIVOTS = 12
PAIRS = 16_384
"""Vector-centroid pairs measured at a time."""


@dataclass(frozen=True)
class Settings:
    size: int = 64
    scale: int = 64
    clusters: int = 16
    rounds: int = 3
    pivots: int = PIVOTS
    seed: str = "1"


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the sample that lie far apart: each next one has the largest least distance."""
    if not len(sample):
        return sample
    chosen = [0]
    least = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and least.max() > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def lengths_to(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all vectors to all pivots."""
    found = np.empty((len(vectors), len(pivots)))
    for at, pivot in enumerate(pivots):
        found[:, at] = np.sqrt(((vectors - pivot) ** 2).sum(axis=1).astype(np.float64))
    return found


def nearest(
    vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid, and how many distances were measured.

    Of equally near centroids the smaller number is taken: a centroid at the least distance is never
    excluded, as bounds are compared with a slack above their rounding errors.
    """
    n = len(vectors)
    bounds = np.zeros((n, len(centroids)))
    for column, own in zip(to_pivots.T, centroid_pivots.T, strict=True):
        np.maximum(bounds, np.abs(column[:, None] - own[None, :]), out=bounds)
    likely = bounds.argmin(axis=1)
    first = ((vectors - centroids[likely]) ** 2).sum(axis=1)
    slack = 1e-9 * (1 + to_pivots.max(axis=1, initial=0) + centroid_pivots.max(initial=0))
    alive = bounds <= (np.sqrt(first.astype(np.float64)) + slack)[:, None]
    rows, numbers = np.nonzero(alive)
    distances = np.full((n, len(centroids)), np.iinfo(np.int64).max)
    for at in range(0, len(rows), PAIRS):
        some, those = rows[at : at + PAIRS], numbers[at : at + PAIRS]
        distances[some, those] = ((vectors[some] - centroids[those]) ** 2).sum(axis=1)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(n), best], len(rows) + n


def _tabled(vectors: DataFrame, pivots: np.ndarray, use: Settings) -> DataFrame:
    """The pivot table: id, integer vector and its distances to all pivots, stored."""
    id_type = vectors.schema["vec_id"].dataType
    schema = T.StructType().add("vec_id", id_type).add("vector", T.BinaryType()).add("to_pivots", T.BinaryType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.array(integers(batch.column("vector"), use.scale), np.int64).reshape(-1, use.size)
            table = lengths_to(whole, pivots).astype("<f8")
            yield batch_of(schema, [batch.column("vec_id"), packed(whole), pa.array([row.tobytes() for row in table], pa.binary())])

    return stored(map_batches(vectors, work, schema), "pivots")


def _assigned(batch: pa.RecordBatch, pivots: np.ndarray, centroids: np.ndarray, size: int):
    vectors = unpacked(batch.column("vector"), size)
    table = np.frombuffer(b"".join(batch.column("to_pivots").to_pylist()), "<f8").reshape(-1, len(pivots))
    return vectors, *nearest(vectors, table, centroids, lengths_to(centroids, pivots))


def _moved(table: DataFrame, pivots: np.ndarray, centroids: np.ndarray, use: Settings) -> np.ndarray:
    """The centroids after one round: floors of the means of their vectors."""
    schema = T.StructType.fromDDL("cluster INT, n LONG, sums ARRAY<BIGINT>")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            vectors, best, _, _ = _assigned(batch, pivots, centroids, use.size)
            order = np.argsort(best, kind="stable")
            met, begins = np.unique(best[order], return_index=True)
            if len(met):
                sums[met] += np.add.reduceat(vectors[order], begins, axis=0)
                counts += np.bincount(best, minlength=len(centroids))
        met = np.nonzero(counts)[0]
        yield batch_of(schema, [met.tolist(), counts[met].tolist(), sums[met].tolist()])

    # One row per task and cluster; one column per component keeps the sums in generated code.
    partial = map_batches(table.select("vector", "to_pivots"), work, schema)
    columns = [F.sum(F.get("sums", F.lit(at))).alias(f"s{at}") for at in range(use.size)]
    moved = centroids.copy()
    for row in partial.groupBy("cluster").agg(F.sum("n").alias("n"), *columns).collect():
        moved[row["cluster"]] = [row[f"s{at}"] // row["n"] for at in range(use.size)]
    return moved


def pivot_clusters(
    frame: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", use: Settings = Settings()
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per usable vector.

    Usable are vectors of exactly ``use.size`` components, none null or not finite; all others are
    left out. Only the two named columns are read. Repeated rows count each; a null id is kept and
    starts no cluster while ids are left. Fewer vectors than clusters give fewer clusters, an empty
    table an empty result. A component of 2^27 or more after scaling raises.
    """
    spark = frame.sparkSession
    kept = frame.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("vector"))
    kept = kept.filter((F.size("vector") == use.size) & usable(F.col("vector")))
    hashed = F.sha2(F.concat(F.lit(f"{use.seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = (
        kept.withColumn("hash", hashed)
        .orderBy(F.asc_nulls_last("hash"), "vector")
        .limit(max(PIVOT_SAMPLE, use.clusters))
        .select("vector")
        .toArrow()
    )
    sample = np.array(integers(chosen.column("vector"), use.scale), np.int64).reshape(-1, use.size)
    centroids, pivots = sample[: use.clusters], choose_pivots(sample, use.pivots)
    table = _tabled(kept, pivots, use)
    for _ in range(use.rounds if len(sample) else 0):
        centroids = _moved(table, pivots, centroids, use)

    schema = T.StructType().add(kept.schema["vec_id"]).add("cluster", T.IntegerType()).add("distance", T.LongType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, best, distances, _ = _assigned(batch, pivots, centroids, use.size)
            yield batch_of(schema, [batch.column("vec_id"), best.astype(np.int32), distances])

    assigned = stored(map_batches(table, work, schema), "clusters")
    # At most one row per cluster comes to the driver.
    sums = {row["cluster"]: row["total"] for row in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    whole = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest() for centroid in centroids.tolist()]
    totals = spark.createDataFrame(
        [(at, sums[at], whole, digest) for at, digest in enumerate(digests) if at in sums],
        "cluster INT, cluster_inertia LONG, inertia LONG, centroid_sha256 STRING",
    )
    return assigned.join(F.broadcast(totals), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
