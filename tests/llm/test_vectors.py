"""Hard negatives and centroid clustering against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise.llm import gnat
from arcwise.llm.catalog import op11_gnat_negatives, op12_laesa_centroids
from arcwise.llm.centroids import Settings, choose_pivots, lengths_to, nearest, pivot_clusters
from tests.llm.common import FOLDER, needs_tables

VECTORS = "vec_id LONG, embedding ARRAY<FLOAT>, label INT"


def usable(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def brute_negatives(rows, every=50):
    kept = {}
    for key, vector, label in rows:
        if key is not None and label is not None and usable(vector):
            kept[key] = min(kept.get(key, (math.inf,)), (label, list(vector)))
    ints = {key: (label, [math.floor(256 * float(x)) for x in vector]) for key, (label, vector) in kept.items()}
    found = set()
    for a, (label, vector) in ints.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, other)), b) for b, (_, other) in ints.items() if b != a)
        for down, p in [(s, b) for s, b in scored if ints[b][0] == label][:5]:
            inside = [(s, b) for s, b in scored if ints[b][0] != label and -50 * down <= -100 * s <= -95 * down]
            found |= {(a, p, k + 1, b, -down, -s) for k, (s, b) in enumerate(inside[:3])}
    return found


def mined(result):
    rows = [tuple(row) for row in result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_vectors(count, size=6, labels=4, seed=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, size))
    rows = [(k, [float(x) for x in np.float32(centres[k % 12] + draw.normal(size=size) * 0.4)], int(draw.integers(labels))) for k in range(count)]
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"leaf_rows": 2, "block_rows": 7, "chunk_anchors": 2}])
def test_negatives_equal_brute_force(spark, limits):
    rows = random_vectors(400)
    # A third of all rows is one vector, labels of its rows differ, and scores tie.
    rows += [(k, [0.5, -0.25, 1.0, 0.0, 0.75, -1.0], k % 4) for k in range(400, 600)]
    rows += [(600, [0.0] * 6, 1), (650, [-x for x in rows[0][1]], 2)]
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    assert mined(gnat.hard_negatives(frame, F.col("vec_id") % 50 == 0, **limits)) == brute_negatives(rows)


def test_negatives_of_rows_that_take_no_part(spark):
    rows = random_vectors(120, labels=2)
    rows += [(500, None, 1), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (None, [0.5] * 6, 0), (700, [0.5] * 6, None)]
    rows += [(750, [float("nan")] + [0.0] * 5, 1), (800, [float("inf")] + [0.0] * 5, 1), rows[0], rows[0], (rows[1][0], [9.0] * 6, 1)]
    frame = spark.createDataFrame(rows, VECTORS)
    clash = frame.withColumns({name: F.lit("x") for name in ("vector", "leaf", "block", "chunk", "anchor_id", "norm", "slot")})
    assert mined(gnat.hard_negatives(clash, F.col("vec_id") % 50 == 0)) == brute_negatives(rows)


def test_negatives_of_short_vectors_and_no_rows(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0], 0), (2, [0.75, 0.0, 5.0], 1), (3, [], 0), (4, [], 1)]
    found = mined(gnat.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0))
    # Filled up with zeros, 1 scores 256^2 and 3 scores 0 with the anchor 0.
    assert found == {(0, 1, 1, 2, 65536, 49152), (0, 3, 1, 4, 0, 0)}
    empty = spark.createDataFrame([], VECTORS)
    assert gnat.hard_negatives(empty, F.col("vec_id") % 50 == 0).collect() == []
    with pytest.raises(Exception, match="2\\^56|reaches"):
        gnat.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], VECTORS), F.lit(True)).collect()


def test_ranges_leave_leaves_out():
    """Clustered rows: most leaves fall to the ranges alone, and none that holds a row of the annulus."""
    draw = np.random.default_rng(5)
    centres = draw.integers(-400, 400, size=(16, 8))
    rows = np.concatenate([c + draw.integers(-9, 10, size=(50, 8)) for c in centres])
    tree = gnat.build_tree(rows[::2], math.sqrt((rows**2).sum(axis=1).max()), 2)
    low, high = tree.low, tree.high

    def seen(node, lengths, own):
        for child in np.unique(own):
            low[node][:, child] = np.minimum(low[node][:, child], lengths[own == child].min(axis=0))
            high[node][:, child] = np.maximum(high[node][:, child], lengths[own == child].max(axis=0))

    leaves = gnat.descend(tree, rows, seen)
    anchors = rows[::40]
    lengths = np.sqrt((anchors**2).sum(axis=1)[:, None] + tree.radius**2 - 2 * anchors @ rows.T)
    near, far = np.partition(lengths, 3, axis=1)[:, 3], np.partition(lengths, 12, axis=1)[:, 12]
    alive = gnat.surviving(tree, anchors, near, far)
    inside = (lengths >= near[:, None]) & (lengths <= far[:, None])
    for anchor, row in zip(*np.nonzero(inside)):
        assert alive[anchor, leaves[row]]
    assert alive.mean() < 0.5


@needs_tables
def test_negatives_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    shifted = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in rows]
    assert mined(op11_gnat_negatives(spark, FOLDER)) == brute_negatives(shifted)


def brute_clusters(rows, use):
    kept = [(key, [math.floor(use.scale * float(x)) for x in v]) for key, v in rows if usable(v) and len(v) == use.size]
    hashed = sorted((hashlib.sha256(f"{use.seed}:{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)
    centroids = [v for _, v in hashed[: use.clusters]]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), at) for at, c in enumerate(centroids)) for _, v in kept]

    for _ in range(use.rounds):
        own = assign()
        for at in range(len(centroids)):
            group = [v for (_, v), (_, k) in zip(kept, own) if k == at]
            if group:
                centroids[at] = [sum(column) // len(group) for column in zip(*group)]
    own = assign()
    inertia = sum(d for d, _ in own)
    parts = [sum(d for d, k in own if k == at) for at in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((key, k, d, parts[k], inertia, digests[k]) for (key, _), (d, k) in zip(kept, own)), key=str)


def clustered(result):
    return sorted((tuple(row) for row in result.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    use = Settings(size=6, scale=16, clusters=7, rounds=4, pivots=4)
    rows = [(key, vector) for key, vector, _ in random_vectors(300)]
    rows += [(k, [0.5, -0.25, 1.0, 0.0, 0.75, -1.0]) for k in range(300, 450)]
    rows += [(450, None), (451, [1.0] * 5), (452, [None] + [1.0] * 5), (453, [float("nan")] + [1.0] * 5), rows[0], rows[0], (None, [2.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<FLOAT>").repartition(5)
    clash = frame.withColumns({name: F.lit(1) for name in ("vector", "hash", "cluster", "distance", "label")})
    assert clustered(pivot_clusters(clash, use=use)) == brute_clusters(rows, use)


def test_few_vectors_and_none(spark):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>"
    use = Settings(size=2, clusters=16)
    rows = [(1, [0.5, -0.5]), (2, [0.5, -0.5]), (3, [-0.01, 2.0])]
    assert clustered(pivot_clusters(spark.createDataFrame(rows, schema), use=use)) == brute_clusters(rows, use)
    assert pivot_clusters(spark.createDataFrame([], schema), use=use).collect() == []
    assert pivot_clusters(spark.createDataFrame([(1, None)], schema), use=use).collect() == []


def test_pivots_spare_distances():
    draw = np.random.default_rng(7)
    centres = draw.integers(-300, 300, size=(16, 8))
    rows = np.concatenate([c + draw.integers(-20, 21, size=(60, 8)) for c in centres])
    pivots = choose_pivots(rows[::3], 8)
    best, distances, measured = nearest(rows, lengths_to(rows, pivots), centres, lengths_to(centres, pivots))
    all_of_them = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (best == all_of_them.argmin(axis=1)).all() and (distances == all_of_them.min(axis=1)).all()
    assert measured < 0.3 * all_of_them.size


@needs_tables
def test_clusters_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert clustered(op12_laesa_centroids(spark, FOLDER)) == brute_clusters([tuple(r) for r in rows], Settings())
