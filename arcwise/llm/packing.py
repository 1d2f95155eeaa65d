"""Best-fit packing with certified bin counts: partitions with a gap exchange documents and pack again.

Pieces are dealt evenly to groups of bounded size. Each group packs best-fit decreasing and compares
its bins with a lower bound from dual feasible functions. A certified group (no gap) gives up at most
its emptiest bin, a group with a gap all bins that have room; what is given up is dealt anew, mixed
across groups, and packed again until the bound of the whole exchange certifies it or no bin is won.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import stored

GROUP_ROWS = 8192
ROUNDS = 4
ROUND_IDS = 1 << 58
GROUP_IDS = 1 << 24
WORK = ("sequence_id", "offset", "row", "given")


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every piece, and the number of bins.

    Open bins are kept by their free room, and a bit per room tells which rooms occur, so the
    tightest bin is the lowest bit at or above a length.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, count = 0, 0
    for piece in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[piece])
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            own, room, count = count, size, count + 1
        bins[piece], offsets[piece] = own, size - room
        room -= length
        if room:
            by_room[room].append(own)
            rooms |= 1 << room
    return bins, offsets, count


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Bins that pieces with ``counts[length]`` pieces of each length need at least.

    The best of the volume bound and two families of dual feasible functions: pieces above
    ``size - e`` count as whole and those under ``e`` as nothing, for every e up to half a bin; and
    lengths rounded down to multiples of a k-th of a bin, k to 24, unless they divide evenly.
    """
    lengths = np.arange(size + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    volume = counts * lengths
    below = np.concatenate([[0], np.cumsum(volume)])
    number = np.concatenate([[0], np.cumsum(counts)])
    best = -(-int(volume.sum()) // size)
    for e in range(1, size // 2 + 1):
        whole = int(number[-1] - number[size - e + 1])
        middle = int(below[size - e + 1] - below[e])
        best = max(best, whole + -(-middle // size))
    for k in range(1, 25):
        scaled = (k + 1) * lengths
        value = np.where(scaled % size == 0, k * lengths, scaled // size * size)
        best = max(best, -(-int((counts * value).sum()) // (k * size)))
    return best


def _packer(schema: T.StructType, size: int, turn: int):
    names = [name for name in schema.names if name not in WORK]

    def work(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        group = table.column("group")[0].as_py()
        bins, offsets, count = best_fit_decreasing(lengths, size)
        fill = np.bincount(bins, lengths, minlength=count).astype(np.int64)
        gap = count - lower_bound(np.bincount(lengths, minlength=size + 1), size)
        given = fill < size
        if gap == 0 and given.any():
            emptiest = int(fill.argmin())
            given[:] = False
            given[emptiest] = True
        ids = turn * ROUND_IDS + group * GROUP_IDS + bins
        added = [ids, offsets, table.column("row"), given[bins]]
        return pa.table([table.column(name) for name in names] + added, names=names + list(WORK))

    return work


def pack(pieces: DataFrame, size: int = 1024, group_rows: int = GROUP_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset, in as few sequences of at most ``size`` as it can.

    ``pieces`` has a long column ``length`` from 1 to ``size``; a length outside raises. All other
    columns stay; ``sequence_id`` and ``offset`` of an earlier packing are replaced. Rows are packed
    one by one, repeated ones too. An empty table gives an empty one. Places in a sequence have no gaps.
    """
    given_names = [name for name in pieces.columns if name not in ("sequence_id", "offset")]
    # Within, a column goes by its place, so that none meets a name of the packing's own.
    inner = {name: "length" if name == "length" else f"c{k}" for k, name in enumerate(given_names)}
    kept = list(inner.values())
    wrong = F.raise_error(F.lit(f"a piece is not of length 1 to {size}"))
    checked = F.when(F.col("length").between(1, size), F.col("length").cast("long")).otherwise(wrong)
    own = [(checked if name == "length" else pieces[f"`{name}`"]).alias(inner[name]) for name in given_names]
    pool = pieces.select(*own, F.monotonically_increasing_id().alias("row"))
    pool = stored(pool, "pieces")
    fields = [pool.schema[name] for name in kept] + [
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("given", T.BooleanType()),
    ]
    schema = T.StructType(fields)
    settled: list[DataFrame] = []
    before: tuple[DataFrame, int] | None = None
    for turn in range(rounds):
        rows = pool.count()
        groups = max(1, -(-rows // group_rows))
        # Dealt by hash: the groups are random, of about ``group_rows`` rows.
        dealt = pool.withColumn("group", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))
        packed = stored(dealt.groupBy("group").applyInArrow(_packer(schema, size, turn), schema), "packed")
        bins = packed.select("sequence_id").distinct().count()
        if before is not None and bins >= before[1]:
            break
        if before is not None:
            before = None
        given = packed.filter("given")
        settled.append(packed.filter("NOT given"))
        counts = np.zeros(size + 1, np.int64)
        for row in given.groupBy("length").count().collect():  # at most ``size`` rows
            counts[row["length"]] = row["count"]
        open_bins = given.select("sequence_id").distinct().count()
        before = (given, open_bins)
        if open_bins <= lower_bound(counts, size):
            break
        pool = given.drop("sequence_id", "offset", "given")
    if before is not None:
        settled.append(before[0])
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    back = [F.col(own).alias(name) for name, own in inner.items()]
    return result.select(*back, "sequence_id", "offset")


def packing_certificate(packed: DataFrame, size: int = 1024) -> DataFrame:
    """One row: the sequences used and the least that any packing needs by the bound."""
    spark = packed.sparkSession
    counts = np.zeros(size + 1, np.int64)
    for row in packed.groupBy("length").count().collect():  # at most ``size`` rows
        counts[row["length"]] = row["count"]
    used = packed.select("sequence_id").distinct().count()
    return spark.createDataFrame([(used, lower_bound(counts, size))], "sequences LONG, bound LONG")
