"""Hard negatives through a multiway hyperplane tree (GNAT) with exact leaves.

Scores are integer inner products. One more coordinate, sqrt(M^2 - |v|^2) with M the largest norm
of all rows, puts every row on a sphere of radius M, where the distance of an anchor (with 0 there)
to a row falls strictly as their score rises: d^2 = |a|^2 + M^2 - 2 * score. A window of scores is an
annulus of distances.

The tree's split points come from a bounded sample (``SAMPLE_PER_LEAF`` rows per leaf, ``MOST_LEAVES``
leaves); every row goes to the nearest split point at each level. For split point i and sibling
subtree j all rows together give the range of distances from i to the rows under j. An anchor skips
subtree j when for any i no row in that range can lie in its annulus. Rows lie in blocks of at most
about ``BLOCK_ROWS``: a leaf with more, as with many equal vectors, is split by hash. Anchors
search their own block first, which narrows the annulus, then every block of every leaf that is left;
anchors meet blocks in chunks of ``CHUNK_ANCHORS``, so neither side of a task grows with the data.
Within a block all scores are taken exactly. Nothing is approximate: the result is that of brute force.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, map_batches, stored
from arcwise.llm.vectors import integers, packed, unpacked, usable

FANOUT = 16
MOST_LEAVES = 4096
LEAF_ROWS = 4096
SAMPLE_PER_LEAF = 16
BLOCK_ROWS = 32_768
CHUNK_ANCHORS = 8_192
TILE = 1 << 21
"""Scores held at a time: anchors times rows of a block."""
LARGEST_NORM = 1 << 56
"""Squared norms stay below this, so that 100 times a score fits a long."""


@dataclass(frozen=True)
class Asked:
    """What is asked of each anchor: positives, negatives per positive, share of the positive's score."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


@dataclass
class Tree:
    """Split points of all inner nodes (in 64-bit floats with the extra coordinate) and their ranges."""

    radius: float
    points: list[np.ndarray] = field(default_factory=list)
    children: list[np.ndarray] = field(default_factory=list)
    low: list[np.ndarray] = field(default_factory=list)
    high: list[np.ndarray] = field(default_factory=list)
    leaves: int = 0

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        whole = vectors.astype(np.float64)
        rest = np.sqrt(np.maximum(self.radius**2 - (whole**2).sum(axis=1), 0))
        return np.concatenate([whole, rest[:, None]], axis=1)

    @property
    def slack(self) -> float:
        """Above every rounding error of a distance on the sphere."""
        return 1e-6 * (1 + self.radius)


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def split_points(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far apart from each other: each next one has the largest least distance; equal rows count once."""
    chosen = [0]
    least = _lengths(rows, rows[:1])[:, 0]
    while len(chosen) < count and least.max() > 1e-9:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _lengths(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def build_tree(sample: np.ndarray, radius: float, depth: int, fanout: int = FANOUT) -> Tree:
    """The split points from a sample of rows; ranges are filled in from all rows."""
    tree = Tree(radius)

    def grow(rows: np.ndarray, levels: int) -> int:
        """The number of the subtree: inner nodes count from 0, leaf k is -1 - k."""
        if levels == 0 or len(rows) < 2:
            tree.leaves += 1
            return -tree.leaves
        points = split_points(rows, fanout)
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.points)
        tree.points.append(points)
        tree.children.append(np.zeros(len(points), np.int64))
        own = _lengths(rows, points).argmin(axis=1)
        tree.children[node] = np.array([grow(rows[own == at], levels - 1) for at in range(len(points))])
        return node

    lifted = tree.lifted(sample)
    if grow(lifted, depth if len(lifted) else 0) < 0 and not tree.points:
        tree.leaves = 1
    tree.low = [np.full((len(p), len(p)), np.inf) for p in tree.points]
    tree.high = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
    return tree


def descend(tree: Tree, vectors: np.ndarray, seen: Callable[[int, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """The leaf of every row; ``seen`` gets each node's distances and chosen children."""
    lifted = tree.lifted(vectors)
    leaves = np.zeros(len(vectors), np.int64)
    waiting = [(0, np.arange(len(vectors)))] if tree.points else []
    while waiting:
        node, rows = waiting.pop()
        lengths = _lengths(lifted[rows], tree.points[node])
        own = lengths.argmin(axis=1)
        seen(node, lengths, own)
        for at in np.unique(own).tolist():
            child, under = int(tree.children[node][at]), rows[own == at]
            if child < 0:
                leaves[under] = -1 - child
            else:
                waiting.append((child, under))
    return leaves


def surviving(tree: Tree, anchors: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which leaves (columns) may hold a row at a distance from ``near`` to ``far`` of each anchor."""
    alive = np.zeros((len(anchors), tree.leaves), bool)
    if not tree.points:
        return np.ones_like(alive)
    flat = np.concatenate([anchors.astype(np.float64), np.zeros((len(anchors), 1))], axis=1)
    waiting = [(0, np.arange(len(anchors)))]
    while waiting:
        node, rows = waiting.pop()
        lengths = _lengths(flat[rows], tree.points[node])
        low, high = tree.low[node], tree.high[node]
        least = np.maximum(np.max(low[None] - lengths[:, :, None], axis=1), np.max(lengths[:, :, None] - high[None], axis=1))
        most = np.min(lengths[:, :, None] + high[None], axis=1)
        may = (least <= (far[rows] + tree.slack)[:, None]) & (most >= (near[rows] - tree.slack)[:, None])
        for at, child in enumerate(tree.children[node].tolist()):
            under = rows[may[:, at]]
            if child < 0:
                alive[under, -1 - child] = True
            elif len(under):
                waiting.append((child, under))
    return alive


def _products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact scores: floats hold every partial sum where norms multiply to less than 2^53."""
    largest = math.sqrt(float((anchors**2).sum(axis=1).max(initial=0)) * float((rows**2).sum(axis=1).max(initial=0)))
    if largest < 1 << 52:
        return anchors.astype(np.float64) @ rows.astype(np.float64).T
    return anchors @ rows.T


FOUND = "anchor_id LONG, slot INT, vec_id LONG, score LONG"


def _meet(rows: pa.Table, asked: pa.Table, width: int, count: int, same: bool) -> Iterator[list[np.ndarray]]:
    """(anchor, slot, row, score): the first ``count`` rows of each window of each anchor, in one block.

    Windows are inclusive bounds of scores, ``lows`` and ``highs``; ``same`` asks for rows of the
    anchor's label other than itself, else for rows of other labels.
    """
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, labels = ids[order], labels[order]
    matrix = unpacked(rows.column("vector"), width)[order]
    own, own_labels = asked.column("anchor_id").to_numpy(), asked.column("label").to_numpy()
    anchors = unpacked(asked.column("vector"), width)
    lows, highs = (np.array(asked.column(name).to_pylist(), np.int64).reshape(len(own), -1) for name in ("lows", "highs"))
    step = max(1, TILE // len(ids))
    for at in range(0, len(own), step):
        some = slice(at, at + step)
        scores = _products(anchors[some], matrix)
        fits = own_labels[some, None] == labels[None, :]
        fits = fits & (own[some, None] != ids[None, :]) if same else ~fits
        fits &= (scores >= lows[some].min(axis=1)[:, None]) & (scores <= highs[some].max(axis=1)[:, None])
        asking, columns = np.nonzero(fits)
        values = scores[asking, columns].astype(np.int64)
        # Rows lie by id, so that of equal scores the smaller id comes first.
        first = np.lexsort((columns, -values, asking))
        asking, columns, values = asking[first], columns[first], values[first]
        for slot in range(lows.shape[1]):
            inside = np.nonzero((values >= lows[some][asking, slot]) & (values <= highs[some][asking, slot]))[0]
            place = np.arange(len(inside)) - np.searchsorted(asking[inside], asking[inside])
            inside = inside[place < count]
            yield [own[some][asking[inside]], np.full(len(inside), slot, np.int32), ids[columns[inside]], values[inside]]


def _search(rows: DataFrame, asked: DataFrame, width: int, count: int, same: bool) -> DataFrame:
    """(anchor_id, slot, found): the first ``count`` rows per anchor and window among its blocks, in order."""
    schema = T.StructType.fromDDL(FOUND)

    def work(block: pa.Table, anchors: pa.Table) -> pa.Table:
        meet = block.num_rows and anchors.num_rows
        found = list(_meet(block, anchors, width, count, same)) if meet else []
        columns = [np.concatenate(parts) for parts in zip(*found, strict=True)] if found else [[], [], [], []]
        return pa.Table.from_batches([batch_of(schema, columns)])

    # A block is repeated once per chunk of anchors that asks for it.
    place = ["leaf", "block", "chunk"]
    meetings = asked.select(*place).distinct().toDF(*place)
    repeated = rows.toDF(*rows.columns).join(meetings, place[:2])
    met = repeated.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(work, schema)
    by_score = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    first = met.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= count)
    return first.groupBy("anchor_id", "slot").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))


def _ranges(table: DataFrame, tree: Tree, width: int) -> Tree:
    """The tree with the least and largest distance from each split point to each sibling subtree."""
    schema = T.StructType.fromDDL("node INT, point INT, child INT, low DOUBLE, high DOUBLE")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = [x.copy() for x in tree.low], [x.copy() for x in tree.high]

        def seen(node: int, lengths: np.ndarray, own: np.ndarray) -> None:
            for child in np.unique(own):
                under = lengths[own == child]
                low[node][:, child] = np.minimum(low[node][:, child], under.min(axis=0))
                high[node][:, child] = np.maximum(high[node][:, child], under.max(axis=0))

        for batch in batches:
            descend(tree, unpacked(batch.column("vector"), width), seen)
        for node in range(len(low)):
            point, child = np.nonzero(np.isfinite(low[node]))
            values = low[node][point, child], high[node][point, child]
            yield batch_of(schema, [np.full(len(point), node, np.int32), point.astype(np.int32), child.astype(np.int32), *values])

    # At most one row per split point and sibling comes back, whatever the number of rows.
    found = map_batches(table.select("vector"), work, schema).groupBy("node", "point", "child")
    for row in found.agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.low[row["node"]][row["point"], row["child"]] = row["low"]
        tree.high[row["node"]][row["point"], row["child"]] = row["high"]
    return tree


def _routed(table: DataFrame, tree: Tree, width: int) -> DataFrame:
    schema = T.StructType(list(table.schema)).add("leaf", T.IntegerType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = descend(tree, unpacked(batch.column("vector"), width), lambda *_: None)
            yield batch_of(schema, [*batch.columns, leaves.astype(np.int32)])

    return stored(map_batches(table, work, schema), "leaves")


def _sent(asked: DataFrame, tree: Tree, width: int) -> DataFrame:
    """Each anchor once per leaf that may hold one of its rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = unpacked(batch.column("vector"), width)
            lows, highs = (np.array(batch.column(name).to_pylist(), np.float64).reshape(len(anchors), -1) for name in ("lows", "highs"))
            empty = lows > highs
            base = (anchors.astype(np.float64) ** 2).sum(axis=1) + tree.radius**2
            near = np.sqrt(np.maximum(base - 2 * np.where(empty, -np.inf, highs).max(axis=1), 0))
            far = np.sqrt(np.maximum(base - 2 * np.where(empty, np.inf, lows).min(axis=1), 0))
            alive = surviving(tree, anchors, near, far) & ~empty.all(axis=1)[:, None]
            at, leaves = np.nonzero(alive)
            sent = batch.drop_columns(["leaf"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(leaves, pa.int32())], [*sent.schema.names, "leaf"])

    schema = T.StructType([*asked.drop("leaf").schema, T.StructField("leaf", T.IntegerType())])
    return map_batches(asked, work, schema)


def hard_negatives(
    frame: DataFrame,
    is_anchor: Column,
    id_column: str = "vec_id",
    label_column: str = "label",
    vector_column: str = "embedding",
    scale: int = 256,
    use: Asked = Asked(),
    leaf_rows: int = LEAF_ROWS,
    block_rows: int = BLOCK_ROWS,
    chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is an expression of ``vec_id``. Labels are integers. Only the three named columns
    are read. Rows with a null id, label or vector, or with a null or not finite component take no
    part; of rows that share an id the one of the smallest label, then vector does. Shorter vectors
    count as filled up with zeros, and a vector without components scores 0. Anchors without rows of
    their label, and positives without negatives in their window, give no row; so does an empty
    table. A component of 2^27 or a squared norm of 2^56 or more after scaling raises.
    """
    spark = frame.sparkSession
    result = "anchor_id LONG, positive_id LONG, rank INT, negative_id LONG, positive_score LONG, negative_score LONG"
    named = frame.select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).alias("vector")
    )
    kept = named.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    single = kept.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")
    width = max(kept.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    schema = T.StructType.fromDDL("vec_id LONG, label LONG, vector BINARY, norm LONG")

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = np.zeros((batch.num_rows, width), np.int64)
            for row, vector in zip(whole, integers(batch.column("vector"), scale), strict=True):
                row[: len(vector)] = vector
            rough = (whole.astype(np.float64) ** 2).sum(axis=1)
            if len(rough) and rough.max() >= LARGEST_NORM:
                raise ValueError("a squared norm reaches 2^56 after scaling; scores would not fit a long")
            yield batch_of(schema, [batch.column("vec_id"), batch.column("label"), packed(whole), (whole**2).sum(axis=1)])

    table = stored(map_batches(single, converted, schema), "vectors")
    rows, norm = table.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not rows:
        return spark.createDataFrame([], result)

    depth = 1
    while FANOUT ** (depth + 1) <= MOST_LEAVES and FANOUT**depth * leaf_rows < rows:
        depth += 1
    # About this many rows by their hash, whatever the size of the table.
    wanted = SAMPLE_PER_LEAF * FANOUT**depth
    chosen = table.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, rows // wanted))) == 0).select("vec_id", "vector").toArrow()
    sample = unpacked(chosen.sort_by("vec_id").column("vector"), width)
    tree = _ranges(table, build_tree(sample, math.sqrt(norm), depth), width)
    routed = _routed(table, tree, width)
    sizes = routed.groupBy("leaf").count().collect()  # at most MOST_LEAVES rows
    blocks = spark.createDataFrame([(r["leaf"], -(-r["count"] // block_rows)) for r in sizes], "leaf INT, blocks INT")
    placed = routed.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    leaf_table = placed.select("vec_id", "label", "vector", "leaf", "block")
    anchors = leaf_table.filter(is_anchor).withColumnRenamed("vec_id", "anchor_id")
    chunks = max(1, -(-anchors.count() // chunk_anchors))

    def windowed(asked: DataFrame, count: int, same: bool) -> DataFrame:
        """The first rows of each window: the own block narrows the windows, then all leaves left are searched."""
        home = _search(leaf_table, asked.withColumn("chunk", F.lit(0)), width, count, same)
        full = home.filter(F.size("found") == count)
        least = F.map_from_entries(F.collect_list(F.struct("slot", F.element_at("found", -1)["score"])))
        asked = asked.join(full.groupBy("anchor_id").agg(least.alias("least")), "anchor_id", "left")
        narrow = F.transform("lows", lambda low, slot: F.greatest(low, F.try_element_at(F.col("least"), slot)))
        narrowed = asked.drop("block").withColumn("lows", F.when(F.col("least").isNull(), F.col("lows")).otherwise(narrow)).drop("least")
        sent = _sent(narrowed, tree, width).join(F.broadcast(blocks), "leaf")
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        chunk = F.pmod(F.xxhash64("anchor_id"), F.lit(chunks)).cast("int")
        return _search(leaf_table, sent.withColumn("chunk", chunk), width, count, same)

    bound = 1 << 60  # above every score
    open_window = anchors.withColumns({"lows": F.array(F.lit(-bound)), "highs": F.array(F.lit(bound))})
    positives = stored(windowed(open_window, use.positives, True).select("anchor_id", "found"), "positives")
    score = F.col("found.score")
    low = F.transform(score, lambda s: F.ceil(F.lit(use.low).cast("decimal(4,0)") * s / 100).cast("long"))
    high = F.transform(score, lambda s: F.floor(F.lit(use.high).cast("decimal(4,0)") * s / 100).cast("long"))
    asked = anchors.join(positives.select("anchor_id", low.alias("lows"), high.alias("highs")), "anchor_id")
    negatives = windowed(asked, use.negatives, False)
    positive = positives.select("anchor_id", F.posexplode("found").alias("slot", "positive"))
    return positive.join(negatives, ["anchor_id", "slot"]).select(
        "anchor_id", F.col("positive.vec_id").alias("positive_id"), F.col("positive.score").alias("positive_score"), F.explode("found").alias("negative")
    ).select(
        "anchor_id",
        "positive_id",
        F.col("negative.rank").alias("rank"),
        F.col("negative.vec_id").alias("negative_id"),
        "positive_score",
        F.col("negative.score").alias("negative_score"),
    )
