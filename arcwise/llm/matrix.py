"""Packed id matrices: token ids in fixed-length rows, with segment lengths and position resets.

Every task packs the pieces of its own rows, in blocks of bounded size, so ids never cross the
network. Bins of a block are searched through a segment tree over free room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, map_batches
from arcwise.llm.tokens import TEXTS_AT_ONCE, encoder, piece_bounds

BLOCK_IDS = 2_000_000


class RoomTree:
    """Counts of open bins by free room; finds the smallest room that holds a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, own: int) -> None:
        self.bins[room].append(own)
        self._change(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Room and bin of the tightest open bin, which is then taken out."""
        node = self.leaves + length
        if not self.counts[node]:
            # Climb until a right neighbour has open bins, then go down to its leftmost one.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.bins[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.counts[node] += by
            node >>= 1


def best_fit_rows(lengths: list[int], size: int) -> list[list[int]]:
    """Piece numbers of each row, best-fit decreasing."""
    tree, rows = RoomTree(size), []
    for piece in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = tree.take(lengths[piece])
        if found is None:
            room, own = size, len(rows)
            rows.append([])
        else:
            room, own = found
        rows[own].append(piece)
        if room > lengths[piece]:
            tree.add(room - lengths[piece], own)
    return rows


def row_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("sequence_id", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("ids", T.BinaryType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())),
            T.StructField("position_resets", T.ArrayType(T.IntegerType())),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("pieces", T.ArrayType(T.IntegerType())),
            T.StructField("starts", T.ArrayType(T.LongType())),
        ]
    )


def packed_rows(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 2,
    width: int = 2,
    block_ids: int = BLOCK_IDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per packed sequence of ``size`` places.

    ``ids`` holds exactly ``size`` little-endian ids of ``width`` bytes (2 or 4), padded with
    ``end_id``; ids too large for the width raise. ``cu_seqlens`` are the cumulative segment lengths
    from 0 to ``n_tokens``; positions start again at each of ``position_resets``, the padding
    included; ``doc_ids``, ``pieces`` and ``starts`` name the segments. A text is its ids and then
    ``end_id``, a null text an empty one. Longer texts are cut into pieces and nothing is lost.
    Repeated rows are packed each, other columns not read. An empty table gives no row.
    """
    schema = row_schema(docs.schema[id_column].dataType)
    kind = {2: "<u2", 4: "<u4"}[width]

    def rows_of(block: list, first: int) -> pa.RecordBatch:
        rows = best_fit_rows([len(ids) for _, _, _, ids in block], size)
        columns: list[list] = [[] for _ in schema]
        for number, own in enumerate(rows):
            place = np.full(size, end_id, kind)
            bounds = [0]
            for piece in own:
                ids = block[piece][3]
                place[bounds[-1] : bounds[-1] + len(ids)] = ids
                bounds.append(bounds[-1] + len(ids))
            whole = place.tobytes()
            resets = bounds if bounds[-1] < size else bounds[:-1]
            values = (
                first + number, bounds[-1], whole, zlib.crc32(whole), bounds, resets,
                [block[k][0] for k in own], [block[k][1] for k in own], [block[k][2] for k in own],
            )
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        return batch_of(schema, columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        first = TaskContext.get().partitionId() << 32
        block, held = [], 0
        for batch in batches:
            for key, encoded in _encoded(batch, encode):
                ids = np.append(np.frombuffer(encoded, "<u4"), np.uint32(end_id))
                if width == 2 and int(ids.max()) > 0xFFFF:
                    raise ValueError("a token id does not fit in two bytes; use width=4")
                for piece, (start, length) in enumerate(piece_bounds(len(ids), size)):
                    block.append((key, piece, start, ids[start : start + length].astype(kind)))
                    held += length
                    if held >= block_ids:
                        done = rows_of(block, first)
                        first += done.num_rows
                        yield done
                        block, held = [], 0
        if block:
            yield rows_of(block, first)

    return map_batches(docs.select(F.col(id_column), F.col(text_column)), work, schema)


def _encoded(batch: pa.RecordBatch, encode) -> Iterator[tuple[object, bytes]]:
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        part = batch.slice(at, TEXTS_AT_ONCE)
        texts = [text or "" for text in part.column(1).to_pylist()]
        yield from zip(part.column(0).to_pylist(), encode.many(texts), strict=True)


def unpacked(rows: DataFrame, width: int = 2) -> DataFrame:
    """The segments of packed rows: doc_id, piece, start and ids as bytes, without padding."""
    segment = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.size("pieces")),
            lambda k: F.struct(
                F.get("doc_ids", k - 1).alias("doc_id"),
                F.get("pieces", k - 1).alias("piece"),
                F.get("starts", k - 1).alias("start"),
                F.expr("ids").substr(
                    F.get("cu_seqlens", k - 1) * width + 1,
                    (F.get("cu_seqlens", k) - F.get("cu_seqlens", k - 1)) * width,
                ).alias("ids"),
            ),
        )
    )
    return rows.select(segment.alias("s")).select("s.*")
