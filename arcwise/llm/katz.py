"""Katz backoff language model: Good-Turing discounts, exact backoff weights, tables by hash of the history.

Tokens are words (lower-cased A-Z, split at the six white-space characters) and one end per text. The
model is of order two: P(w | h) is the discounted relative frequency of (h, w) where training has
that pair, else alpha(h) * P(w); P(w) is discounted the same way, and what the discounts take goes to
one unknown word. alpha(h) is the mass left by h's pairs over the mass that P gives to words not seen
after h, so the probabilities of all words after any history sum to one.

How it runs:

* ``token_table``: texts are read once and stored as chunks of word numbers with each chunk's own words.
* Words are counted by one shuffle with sums per chunk before it (table ``words``). The ``FREQUENT``
  commonest get small numbers and are sent to all tasks; all others stay 64-bit hashes.
* Pairs are counted per chunk, then dealt by hash of the history, compressed (table ``grams``). Histories
  with a large share of all tokens are dealt by the following word as well, and their parts summed.
* Scoring deals each chunk's distinct pairs, with the texts they stand in, the same way and meets the
  stored pairs. A pair that is found is scored there; one that is not is scored by its history's alpha and
  handed down to the single word: at once for a frequent word, by a join with ``words`` for a rare one.

Every table grows with the corpus. Only the frequent words (``FREQUENT``), histories split over
buckets (``HOT_PER_BUCKET`` per bucket) and a few counts of counts reach the driver.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, give_back, map_batches, stored

CHUNK_TOKENS = 1 << 19
"""Tokens per chunk; longer texts go on in further chunks."""
BUCKET_TOKENS = 1 << 21
"""Tokens per bucket of pairs: the number of buckets grows with the corpus."""
FREQUENT = 1 << 19
HOT_PER_BUCKET = 4
DISCOUNTED = 5
"""Counts up to this one are discounted by Good-Turing, as Katz does."""

END, START = np.uint64(0), np.uint64(1)
RARE = np.uint64(1 << 63)
FIRST = np.uint64(1 << 62)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
DOCS = 1 << 40


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def word_hash(word: bytes) -> int:
    """63 bits; 0 and 1 stand for the end and the start of a text."""
    found = xxhash.xxh64_intdigest(word) >> 1
    return found if found > 1 else found + 2


# -- chunks of tokens ---------------------------------------------------------------------------


class _Chunk:
    """Pieces of texts as numbers of the chunk's own words; each piece begins with the token before it."""

    def __init__(self, first: int, goes_on: bool) -> None:
        self.first, self.goes_on = first, goes_on
        self.numbers: dict[bytes, int] = {}
        self.hashes = [int(END), int(START)]
        self.ids, self.held, self.lengths, self.tokens, self.size = [], [], [], [], 0

    def number(self, word: bytes) -> int:
        found = self.numbers.get(word)
        if found is None:
            found = self.numbers[word] = len(self.hashes)
            self.hashes.append(word_hash(word))
        return found

    def add(self, key, held: bool, before: bytes | None, words: list[bytes], ends: bool) -> None:
        get = self.numbers.get
        start = 1 if before is None else self.number(before)
        found = [get(word) for word in words]
        if None in found:
            found = [self.number(word) for word in words]
        piece = [start, *found, 0] if ends else [start, *found]
        self.ids.append(key)
        self.held.append(held)
        self.lengths.append(len(piece))
        self.tokens.append(np.array(piece, "<u4"))
        self.size += len(piece)

    def columns(self) -> list:
        packer = zstandard.ZstdCompressor(level=1)
        parts = [
            np.array(self.hashes, "<u8"),
            np.array(self.held, "u1"),
            np.array(self.lengths, "<u4"),
            _planes(np.concatenate(self.tokens)),
        ]
        return [self.first, self.goes_on, self.ids, [packer.compress(part.tobytes()) for part in parts]]


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of equal weight side by side, which compress better."""
    return np.ascontiguousarray(values.view("u1").reshape(len(values), -1).T)


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(width, -1).T).reshape(-1).view(kind)


@dataclass
class Tokens:
    """A chunk read back: word hashes, and per piece its text's number, held-out flag and tokens."""

    first: int
    hashes: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray

    @staticmethod
    def read(batch: pa.RecordBatch) -> Iterator[Tokens]:
        unpack = zstandard.ZstdDecompressor().decompress
        for first, parts in zip(batch.column("first").to_pylist(), batch.column("parts"), strict=True):
            words, held, lengths, tokens = (unpack(part.as_py()) for part in parts.values)
            yield Tokens(
                first,
                np.frombuffer(words, "<u8"),
                np.frombuffer(held, "u1").astype(bool),
                np.frombuffer(lengths, "<u4").astype(np.int64),
                _unplaned(tokens, "<u4").view("<i4"),
            )

    def targets(self) -> tuple[np.ndarray, np.ndarray]:
        """Piece and word number of every token, without the token that each piece begins with."""
        pieces = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        begins = np.zeros(len(self.tokens), bool)
        begins[np.cumsum(self.lengths) - self.lengths] = True
        return pieces[~begins], self.tokens[~begins]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece, history and word of every token."""
        pieces, words = self.targets()
        ends = np.ones(len(self.tokens), bool)
        ends[np.cumsum(self.lengths) - 1] = False
        return pieces, self.tokens[ends], words


def token_table(docs: DataFrame, held_out: Column, id_column: str, text_column: str, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks (first, goes_on, ids, parts), stored. A text's number is its task's and its place there, kept with it."""
    id_type = docs.schema[id_column].dataType
    schema = T.StructType().add("first", T.LongType()).add("goes_on", T.BooleanType())
    schema = schema.add("ids", T.ArrayType(id_type)).add("parts", T.ArrayType(T.BinaryType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * DOCS
        chunk = _Chunk(number, False)
        for batch in batches:
            for key, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, at, before = words_of(text.as_py()), 0, None
                while True:
                    room = max(1, chunk_tokens - chunk.size)
                    some = words[at : at + room]
                    at += len(some)
                    chunk.add(key, held, before, some, at == len(words))
                    if chunk.size >= chunk_tokens:
                        yield batch_of(schema, [[value] for value in chunk.columns()])
                        chunk = _Chunk(number if at < len(words) else number + 1, at < len(words))
                    if at == len(words):
                        break
                    before = some[-1]
                number += 1
        if chunk.ids:
            yield batch_of(schema, [[value] for value in chunk.columns()])

    rows = docs.select(F.col(id_column), F.coalesce(held_out, F.lit(False)), F.col(text_column))
    return stored(map_batches(rows.toDF("key", "held", "text"), work, schema), "tokens")


# -- counts and discounts -----------------------------------------------------------------------


def discounts(counts_of_counts: dict[int, int], most: int = DISCOUNTED) -> np.ndarray:
    """d[r] for r = 0 .. most + 1: Good-Turing factors up to the largest k whose factors all lie in (0, 1).

    d[0] is unused and counts above k are not discounted. Where no k will do, as in small or artificial
    corpora, every count gives up a half (``d[-1]`` is then 0 as a mark, see ``discounted``).
    """
    n = [counts_of_counts.get(r, 0) for r in range(most + 2)]
    for k in range(most, 0, -1):
        if not n[1]:
            break
        cut = (k + 1) * n[k + 1] / n[1]
        if cut >= 1 or any(not n[r] for r in range(1, k + 1)):
            continue
        found = [((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return np.array([1.0, *found, *[1.0] * (most + 1 - k)])
    return np.zeros(most + 2)


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    if not factors[-1]:
        return counts - np.where(counts > 0, 0.5, 0)
    return counts * factors[np.minimum(counts, len(factors) - 1)]


@dataclass
class Vocabulary:
    """What all tasks know: totals, discounts of single words, and the frequent words by hash."""

    hashes: np.ndarray
    ranks: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    factors: np.ndarray
    whole: float
    unknown: float

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of a frequent word, hash with the top bit set of any other one."""
        if not len(self.hashes):
            return np.where(hashes == START, FIRST, hashes | RARE)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.hashes[at] == hashes, self.ranks[at].astype(np.uint64), hashes | RARE)
        return np.where(hashes == START, FIRST, found)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of frequent words by rank."""
        return self.counts[keys.astype(np.int64)]

    def chance(self, counts: np.ndarray) -> np.ndarray:
        """P(w) of words by their training counts; count 0 is the unknown word."""
        return np.where(counts > 0, discounted(counts, self.factors) / self.whole, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, met, count): every word's hash, its tokens in all texts and in training; stored."""
    schema = T.StructType.fromDDL("word LONG, met LONG, count LONG")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in Tokens.read(batch):
                pieces, words = chunk.targets()
                size = len(chunk.hashes)
                met, own = np.bincount(words, minlength=size), np.bincount(words[~chunk.held[pieces]], minlength=size)
                some = np.nonzero(met)[0]
                yield batch_of(schema, [chunk.hashes[some].view(np.int64), met[some], own[some]])

    counted = map_batches(chunks.select("first", "parts"), work, schema).groupBy("word")
    return stored(counted.agg(F.sum("met").alias("met"), F.sum("count").alias("count")), "words")


def vocabulary(words: DataFrame, frequent: int = FREQUENT) -> tuple[Vocabulary, np.ndarray]:
    """Totals from one aggregate; words above a count that at most ``frequent`` words reach, and how often those were met."""
    level = F.floor(F.log2(F.col("met").cast("double")) * 8).cast("int")
    small = F.when(F.col("count") <= DISCOUNTED + 1, F.col("count"))
    rows = words.groupBy(level.alias("level"), small.alias("small")).agg(F.count(F.lit(1)).alias("n"), F.sum("count").alias("count")).collect()
    by_count: dict[int, int] = {}
    by_level: dict[int, int] = {}
    for row in rows:
        by_level[row["level"]] = by_level.get(row["level"], 0) + row["n"]
        if row["small"]:
            by_count[row["small"]] = by_count.get(row["small"], 0) + row["n"]
    tokens = sum(row["count"] for row in rows)
    types = sum(row["n"] for row in rows if row["small"] != 0)
    taken, least = 0, None
    for at in sorted(by_level, reverse=True):
        taken += by_level[at]
        if taken > frequent:
            break
        least = at
    factors = discounts(by_count)
    kept = tokens - 0.5 * types if not factors[-1] else tokens - sum(n * r * (1 - factors[r]) for r, n in by_count.items())
    # Where no mass is left for unknown words, one token's is.
    whole = float(tokens) if kept < tokens else tokens + 1.0
    found = words.filter(level >= least).toArrow() if least is not None else words.limit(0).toArrow()
    hashes = found.column("word").to_numpy().view(np.uint64)
    ranks = np.empty(len(hashes), np.uint32)
    order = np.lexsort((hashes, -found.column("met").to_numpy()))
    ranks[order] = np.arange(len(hashes), dtype=np.uint32)
    by_hash = np.argsort(hashes)
    counts, met = (found.column(name).to_numpy()[order] for name in ("count", "met"))
    return Vocabulary(hashes[by_hash], ranks[by_hash], counts, tokens, types, factors, whole, 1 - kept / whole), met


# -- pairs --------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of keys, to deal them by."""
    x = keys * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def bucket_of(histories: np.ndarray, words: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    mixed = _mixed(histories)
    split = np.isin(histories, hot)
    mixed[split] ^= _mixed(words[split] + np.uint64(7))
    return ((mixed >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)


def pack_pairs(histories: np.ndarray, words: np.ndarray, numbers: list[np.ndarray]) -> bytes:
    """Pairs in order of history and word with further numbers, compressed without loss."""
    begins = np.nonzero(np.r_[True, histories[1:] != histories[:-1]])[0] if len(histories) else np.zeros(0, np.int64)
    rare = words >= FIRST
    parts = [
        _planes(histories[begins].astype("<u8")).tobytes(),
        np.diff(np.r_[begins, len(histories)]).astype("<u4").tobytes(),
        _planes(np.where(rare, np.uint64(0xFFFFFFFF), words).astype("<u4")).tobytes(),
        words[rare].astype("<u8").tobytes(),
        *[_planes(x.astype("<u4")).tobytes() for x in numbers],
    ]
    sizes = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = struct.unpack_from("<q", raw)[0]
    at, parts = 8 + 8 * count, []
    for size in struct.unpack_from(f"<{count}q", raw, 8):
        parts.append(raw[at : at + size])
        at += size
    histories = np.repeat(_unplaned(parts[0], "<u8"), np.frombuffer(parts[1], "<u4"))
    words = _unplaned(parts[2], "<u4").astype(np.uint64)
    words[words == 0xFFFFFFFF] = np.frombuffer(parts[3], "<u8")
    return histories, words, [_unplaned(part, "<u4") for part in parts[4:]]


def _dealt(chunk: Tokens, known: Vocabulary, hot: np.ndarray, buckets: int, training: bool) -> Iterator[tuple[int, bytes]]:
    """(bucket, pairs) of a chunk: with training counts, or with the pieces each pair stands in and how often."""
    pieces, histories, words = chunk.pairs()
    if training:
        some = ~chunk.held[pieces]
        pieces, histories, words = np.zeros(int(some.sum()), np.int32), histories[some], words[some]
    if not len(words):
        return
    keys = known.keys(chunk.hashes)
    # Arrays go as soon as they are used: two tasks of an executor hold a whole chunk each.
    # Piece, history and word share 64 bits where a chunk is of the usual size.
    bits = max(int(len(chunk.hashes)), int(len(chunk.lengths))).bit_length()
    if 3 * bits < 64:
        joint = histories.astype(np.int64)
        for part in (words, pieces):
            joint <<= bits
            joint |= part
        del histories, words, pieces, part
        joint.sort()
        at = np.nonzero(np.r_[True, joint[1:] != joint[:-1]])[0]
        times = np.diff(at, append=len(joint)).astype(np.uint32)
        joint = joint[at]
        low = (1 << bits) - 1
        pieces = (joint & low).astype(np.uint32)
        joint >>= bits
        starts = np.nonzero(np.r_[True, joint[1:] != joint[:-1]])[0]
        joint = joint[starts]
        left, right = keys[joint >> bits], keys[joint & low]
        del at, joint
    else:
        order = np.lexsort((pieces, words, histories))
        pieces, histories, words = pieces[order], histories[order], words[order]
        pair = np.r_[True, (histories[1:] != histories[:-1]) | (words[1:] != words[:-1])]
        at = np.nonzero(pair | np.r_[True, pieces[1:] != pieces[:-1]])[0]
        times = np.diff(at, append=len(words)).astype(np.uint32)
        starts = np.nonzero(pair[at])[0]
        left, right = keys[histories[at[starts]]], keys[words[at[starts]]]
        pieces = pieces[at].astype(np.uint32)
        del order, histories, words, pair, at
    # Now pieces and times have an entry per pair and piece, the others a pair whose entries begin at starts.
    bucket = bucket_of(left, right, hot, buckets).astype(np.int32)
    order = np.lexsort((right, left, bucket))
    left, right, bucket = left[order], right[order], bucket[order]
    per_pair = np.diff(starts, append=len(pieces))[order]
    ends = np.cumsum(per_pair)
    entries = np.repeat((starts[order] - ends + per_pair).astype(np.int32), per_pair) + np.arange(len(pieces), dtype=np.int32)
    del order, starts
    pieces, times = pieces[entries], times[entries]
    del entries
    edges = np.r_[0, np.nonzero(bucket[1:] != bucket[:-1])[0] + 1, len(bucket)]
    cuts = np.r_[0, ends][edges]
    for k in range(len(edges) - 1):
        a, b, c, d = edges[k], edges[k + 1], cuts[k], cuts[k + 1]
        numbers = [times[c:d]] if training else [per_pair[a:b], pieces[c:d], times[c:d]]
        yield int(bucket[a]), pack_pairs(left[a:b], right[a:b], numbers)


def _added(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of several parts in order, and their counts added up; ``parts`` is emptied."""
    histories, words = (np.concatenate([part[k] for part in parts]) for k in range(2))
    times = np.concatenate([part[2][0] for part in parts])
    parts.clear()
    order = np.lexsort((words, histories))
    histories, words, times = histories[order], words[order], times[order].astype(np.int64)
    del order
    begins = np.nonzero(np.r_[True, (histories[1:] != histories[:-1]) | (words[1:] != words[:-1])])[0]
    return histories[begins], words[begins], np.add.reduceat(times, begins)


@dataclass
class _Pairs:
    """The stored pairs of a bucket, to be looked up; ``of`` empties its list."""

    histories: np.ndarray
    words: np.ndarray
    joint: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(parts: list[tuple]) -> _Pairs:
        if len(parts) == 1:
            histories, words, (counts,) = parts[0]
        else:
            empty = np.zeros(0, np.uint64)
            histories, words = (np.concatenate([part[k] for part in parts] + [empty]) for k in range(2))
            counts = np.concatenate([part[2][0] for part in parts] + [np.zeros(0, np.uint32)])
        parts.clear()
        left, right = np.unique(histories), np.unique(words)
        joint = np.searchsorted(left, histories)
        del histories
        joint *= len(right)
        joint += np.searchsorted(right, words)
        # A bucket's pairs are stored in order.
        if (joint[1:] < joint[:-1]).any():
            order = np.argsort(joint, kind="stable")
            joint, counts = joint[order], counts[order]
        return _Pairs(left, right, joint, counts)

    def counts_of(self, histories: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Counts of pairs, 0 for those not stored."""
        found = np.zeros(len(words), np.int64)
        if len(self.joint):
            left = np.minimum(np.searchsorted(self.histories, histories), len(self.histories) - 1)
            right = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            joint = left * len(self.words) + right
            at = np.minimum(np.searchsorted(self.joint, joint), len(self.joint) - 1)
            there = (self.histories[left] == histories) & (self.words[right] == words) & (self.joint[at] == joint)
            found[there] = self.counts[at[there]]
        return found


@dataclass
class Model:
    """A fitted model and its stored tables.

    ``words`` (word, met, count), ``grams`` (bucket, pairs), ``contexts`` (bucket, history, whole, weight): the
    denominator of a history's discounted counts and its backoff weight. ``hot`` has the keys of histories that lie in
    several buckets, ``hot_contexts`` their (whole, weight).
    """

    known: Vocabulary
    words: DataFrame
    grams: DataFrame
    contexts: DataFrame
    factors: np.ndarray
    hot: np.ndarray
    hot_contexts: np.ndarray
    buckets: int


PARTS = "kind STRING, bucket INT, history LONG, word LONG, n LONG, kept DOUBLE, seen DOUBLE, pairs BINARY"


def _counted_pairs(chunks: DataFrame, known: Vocabulary, hot: np.ndarray, buckets: int) -> DataFrame:
    """Rows of four kinds, stored by kind: pairs of a bucket, counts of counts, histories, pairs whose word is rare.

    Counts of a history's pairs up to ``DISCOUNTED + 1`` are summed one by one (kind ``history``, ``word`` holds the
    count), as the discounts are known only when all pairs are counted.
    """
    dealt_schema = T.StructType.fromDDL("bucket INT, pairs BINARY")
    schema = T.StructType.fromDDL(PARTS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in Tokens.read(batch):
                found = list(_dealt(chunk, known, hot, buckets, training=True))
                if found:
                    yield batch_of(dealt_schema, [list(column) for column in zip(*found, strict=True)])

    def rows(kind: str, bucket: int, **columns) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        values = {"kind": [kind] * size, "bucket": [bucket] * size, **columns}
        return batch_of(schema, [values.get(field.name, pa.nulls(size)) if field.name in values else [None] * size for field in schema])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        histories, words, counts = _added([unpack_pairs(blob.as_py()) for blob in table.column("pairs")])
        small = np.minimum(counts, DISCOUNTED + 2)
        values, n = np.unique(small, return_counts=True)
        rare = words >= FIRST
        chances = np.zeros(len(words))
        chances[~rare] = known.chance(known.count(words[~rare]))
        # By history and size of the count: pairs, and the sums that the backoff weight needs.
        first = np.r_[True, histories[1:] != histories[:-1]]
        own = np.cumsum(first) - 1
        cell = own * (DISCOUNTED + 3) + small
        cells, at = np.unique(cell, return_inverse=True)
        met = histories[np.nonzero(first)[0]][cells // (DISCOUNTED + 3)]
        out = [
            rows("pairs", bucket, pairs=[pack_pairs(histories, words, [counts])]),
            rows("counts", bucket, word=values, n=n),
            rows(
                "history",
                bucket,
                history=met.view(np.int64),
                word=cells % (DISCOUNTED + 3),
                n=np.bincount(at),
                kept=np.bincount(at, counts),
                seen=np.bincount(at, chances),
            ),
            rows("rare", bucket, history=histories[rare].view(np.int64), word=(words[rare] & ~RARE).view(np.int64)),
        ]
        del histories, words, counts, small, rare, chances, first, own, cell, cells, at, met
        give_back()
        return pa.Table.from_batches(out)

    dealt = map_batches(chunks.select("first", "parts"), deal, dealt_schema)
    return dealt.groupBy("bucket").applyInArrow(count, schema)


def _mass(column_count: Column, n: Column, raw: Column, factors: np.ndarray) -> Column:
    """Discounted count of ``n`` entries of one count, whose plain counts add up to ``raw``."""
    if not factors[-1]:
        return raw - n * F.lit(0.5)
    table = F.array(*[F.lit(float(d)) for d in factors])
    return F.when(column_count < len(factors), raw * F.get(table, column_count.cast("int"))).otherwise(raw.cast("double"))


def _chance(count: Column, known: Vocabulary) -> Column:
    """``Vocabulary.chance`` as an expression."""
    seen = _mass(count, F.lit(1), count.cast("double"), known.factors) / F.lit(known.whole)
    return F.when(count > 0, seen).otherwise(F.lit(known.unknown))


def fit_chunks(chunks: DataFrame, bucket_tokens: int = BUCKET_TOKENS, frequent: int = FREQUENT) -> Model:
    """The model of the chunks' training texts."""
    spark = chunks.sparkSession
    words = word_counts(chunks)
    known, met = vocabulary(words, frequent)
    total, texts = words.agg(F.sum("met"), F.max(F.when(F.col("word") == int(END), F.col("met")))).first()
    buckets = max(1, -(-(total or 0) // bucket_tokens))
    limit = bucket_tokens // HOT_PER_BUCKET
    hot = np.nonzero(met > limit)[0].astype(np.uint64)
    if (texts or 0) > limit:
        hot = np.r_[hot, FIRST]
    parts = stored(_counted_pairs(chunks, known, hot, buckets), "grams")
    counts = parts.filter("kind = 'counts'").groupBy("word").agg(F.sum("n").alias("n")).collect()
    factors = discounts({row["word"]: row["n"] for row in counts})

    mass = _mass(F.col("word"), F.col("n"), F.col("kept"), factors)
    plain = parts.filter("kind = 'history'").select("bucket", "history", "kept", mass.alias("mass"), "seen")
    counted = words.select("word", "count")
    rare = parts.filter("kind = 'rare'").select("bucket", "history", "word").join(counted, "word")
    unlisted = rare.select("bucket", "history", F.lit(0.0).alias("kept"), F.lit(0.0).alias("mass"), _chance(F.col("count"), known).alias("seen"))
    sums = plain.unionByName(unlisted).groupBy("history").agg(
        F.max("bucket").alias("bucket"), F.sum("kept").alias("kept"), F.sum("mass").alias("mass"), F.sum("seen").alias("seen")
    )
    # Where no mass is left for words not seen after a history, one token's is.
    whole = F.col("kept") + F.when(F.col("mass") < F.col("kept"), 0.0).otherwise(1.0)
    contexts = stored(
        sums.withColumn("whole", whole).select(
            "bucket", "history", "whole", ((1 - F.col("mass") / F.col("whole")) / (1 - F.col("seen"))).alias("weight")
        ),
        "contexts",
    )
    # At most HOT_PER_BUCKET histories per bucket and one more.
    listed = spark.createDataFrame([(int(key),) for key in hot], "history LONG")
    spread = {row["history"]: (row["whole"], row["weight"]) for row in contexts.join(F.broadcast(listed), "history").collect()}
    hot_contexts = np.array([spread.get(int(key), (1.0, 1.0)) for key in hot]).reshape(-1, 2)
    return Model(known, words, parts.filter("kind = 'pairs'").select("bucket", "pairs"), contexts, factors, hot, hot_contexts, buckets)


# -- scoring ------------------------------------------------------------------------------------

GRAMS, CONTEXTS, ASKED = range(3)
PARTIAL = "text LONG, word LONG, held BOOLEAN, tokens LONG, known LONG, back LONG, base DOUBLE, sums BINARY"
"""A row per text; per text and rare word; or, with ``sums``, the scores of all texts of a chunk in one bucket."""


def _base_rows(chunks: DataFrame, known: Vocabulary) -> DataFrame:
    """Per text and chunk what frequent words give; a row per text and rare word for the others."""
    schema = T.StructType.fromDDL(PARTIAL)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in Tokens.read(batch):
                pieces, words = chunk.targets()
                size, keys = len(chunk.lengths), known.keys(chunk.hashes)
                common = keys[words] < FIRST
                counts = np.zeros(len(keys), np.int64)
                counts[keys < FIRST] = known.count(keys[keys < FIRST])
                bases = known.base(counts)
                at, own = pieces[common], words[common]
                texts = chunk.first + np.arange(size)
                none, zero = [None] * size, np.zeros(size, np.int64)
                whole = [
                    texts, none, pa.array(chunk.held), np.bincount(pieces, minlength=size),
                    np.bincount(at, counts[own] > 0, minlength=size).astype(np.int64), zero,
                    np.bincount(at, bases[own], minlength=size), none,
                ]
                yield batch_of(schema, whole)
                rare, times = np.unique(pieces[~common].astype(np.int64) << 32 | words[~common], return_counts=True)
                if len(rare):
                    none, zero = [None] * len(rare), np.zeros(len(rare), np.int64)
                    hashes = chunk.hashes[rare & 0xFFFFFFFF].view(np.int64)
                    yield batch_of(schema, [chunk.first + (rare >> 32), hashes, none, times, zero, zero, np.zeros(len(rare)), none])

    return map_batches(chunks.select("first", "parts"), work, schema)


def _pair_rows(chunks: DataFrame, model: Model) -> DataFrame:
    """Per chunk and bucket the scores of its texts' pairs; a row per text and rare word for those handed down."""
    asked_schema = T.StructType.fromDDL("bucket INT, kind INT, first LONG, pairs BINARY")
    schema = T.StructType.fromDDL(PARTIAL)
    known, factors, hot, hot_contexts, buckets = model.known, model.factors, model.hot, model.hot_contexts, model.buckets

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in Tokens.read(batch):
                for bucket, pairs in _dealt(chunk, known, hot, buckets, training=False):
                    yield batch_of(asked_schema, [[bucket], [ASKED], [chunk.first], [pairs]])

    def context_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("bucket").to_numpy()
            order = np.argsort(own, kind="stable")
            values = [batch.column(name).to_numpy()[order] for name in ("history", "whole", "weight")]
            met, begins = np.unique(own[order], return_index=True)
            for bucket, a, b in zip(met.tolist(), begins, [*begins[1:], len(own)], strict=True):
                blob = zstandard.ZstdCompressor(level=1).compress(b"".join(x[a:b].tobytes() for x in values))
                yield batch_of(asked_schema, [[bucket], [CONTEXTS], [0], [blob]])

    def score(table: pa.Table) -> pa.Table:
        kinds, firsts, blobs = table.column("kind").to_pylist(), table.column("first").to_pylist(), table.column("pairs")
        grams = [unpack_pairs(blob.as_py()) for kind, blob in zip(kinds, blobs, strict=True) if kind == GRAMS]
        asked = [(first, blob) for kind, first, blob in zip(kinds, firsts, blobs, strict=True) if kind == ASKED]
        empty = pa.Table.from_batches([batch_of(schema, [[]] * 8)])
        if not asked:
            return empty
        raw = [zstandard.ZstdDecompressor().decompress(blob.as_py()) for kind, blob in zip(kinds, blobs, strict=True) if kind == CONTEXTS]
        thirds = [(blob[: len(blob) // 3], blob[len(blob) // 3 : len(blob) // 3 * 2], blob[len(blob) // 3 * 2 :]) for blob in raw]
        context = np.concatenate([np.frombuffer(part[0], np.uint64) for part in thirds] + [np.zeros(0, np.uint64)])
        facts = np.array([np.concatenate([np.frombuffer(part[k], np.float64) for part in thirds] + [np.zeros(0)]) for k in (1, 2)]).T
        context, facts = np.r_[context, hot], np.r_[facts, hot_contexts]
        # A hot history comes with the broadcast and in one bucket's contexts; both say the same.
        context, first = np.unique(context, return_index=True)
        facts = facts[first]
        del raw, thirds

        pairs = _Pairs.of(grams)
        chunks, packs, out = [], [], []
        for first, blob in asked:
            histories, words, (per_pair, pieces, times) = unpack_pairs(blob.as_py())
            counts = pairs.counts_of(histories, words)
            whole, weight = np.ones(len(words)), np.ones(len(words))
            if len(context):
                at = np.minimum(np.searchsorted(context, histories), len(context) - 1)
                met = context[at] == histories
                whole[met], weight[met] = facts[at[met], 0], facts[at[met], 1]
            seen, rare = counts > 0, words >= FIRST
            logs = np.log10(np.where(seen, discounted(counts, factors) / whole, weight))
            down = ~seen & ~rare
            logs[down] += np.log10(known.chance(known.count(words[down])))
            sums = np.bincount(pieces, np.repeat(logs, per_pair) * times)
            met = np.unique(pieces).astype(np.int64)
            chunks.append(first)
            packs.append(met.astype("<u4").tobytes() + sums[met].astype("<f8").tobytes())
            asks = np.repeat(~seen & rare, per_pair)
            if asks.any():
                hashes = (np.repeat(words, per_pair)[asks] & ~RARE).view(np.int64)
                out.append((first + pieces[asks].astype(np.int64), hashes, times[asks].astype(np.int64)))

        def rows(texts, words, back, sums) -> pa.RecordBatch:
            none, zero = [None] * len(texts), np.zeros(len(texts), np.int64)
            return batch_of(schema, [texts, none if words is None else words, none, zero, zero, back if sums is None else zero, zero.astype(float), none if sums is None else sums])

        handed = [rows(*(np.concatenate(column) for column in zip(*out, strict=True)), None)] if out else []
        del pairs, context, facts, out
        give_back()
        return pa.Table.from_batches([rows(chunks, None, None, packs), *handed])

    stored_pairs = model.grams.select("bucket", F.lit(GRAMS).alias("kind"), F.lit(0).cast("long").alias("first"), "pairs")
    weights = map_batches(model.contexts, context_blobs, asked_schema)
    dealt = map_batches(chunks.select("first", "parts"), deal, asked_schema)
    return dealt.unionByName(stored_pairs).unionByName(weights).groupBy("bucket").applyInArrow(score, schema)


def _summed(parts: DataFrame) -> DataFrame:
    """(text, score) from the packed sums of all buckets of a chunk; a chunk's sums are fewer than its tokens."""
    schema = T.StructType.fromDDL("text LONG, score DOUBLE")

    def add(key: tuple, table: pa.Table) -> pa.Table:
        packs = table.column("sums").to_pylist()
        pieces = np.concatenate([np.frombuffer(pack, "<u4", len(pack) // 12) for pack in packs])
        sums = np.concatenate([np.frombuffer(pack, "<f8", len(pack) // 12, len(pack) // 12 * 4) for pack in packs])
        met = np.unique(pieces)
        return pa.Table.from_batches([batch_of(schema, [key[0].as_py() + met.astype(np.int64), np.bincount(pieces, sums)[met]])])

    return parts.groupBy("text").applyInArrow(add, schema)


def score_chunks(chunks: DataFrame, model: Model, id_column: str) -> DataFrame:
    """One row per text of the chunks: (id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    known = model.known
    rows = _base_rows(chunks, known).unionByName(_pair_rows(chunks, model))
    rows = stored(rows, "scores")
    counted = model.words.filter("count > 0").select("word", "count")
    count = F.coalesce(F.col("count"), F.lit(0))
    # A word below the frequent ones comes in a bounded number of texts, and its rows are joined by a shuffle.
    rare = rows.filter("word IS NOT NULL").join(counted, "word", "left").select(
        "text",
        F.lit(None).cast("boolean").alias("held"),
        F.lit(0).cast("long").alias("tokens"),
        F.when(count > 0, F.col("tokens")).otherwise(0).alias("known"),
        (F.col("tokens") * F.log10((count + 1) / F.lit(float(known.tokens + known.types + 1)))).alias("base"),
        F.when(F.col("back") > 0, F.col("back") * F.log10(_chance(count, known))).otherwise(0.0).alias("score"),
    )
    ids = chunks.select("first", "goes_on", F.posexplode("ids").alias("place", "id")).filter("place > 0 OR NOT goes_on")
    named = ids.select((F.col("first") + F.col("place")).alias("text"), "id")
    plain = rows.filter("word IS NULL AND sums IS NULL").select("text", "held", "tokens", "known", "base")
    summed = _summed(rows.filter("sums IS NOT NULL").select("text", "sums"))
    sums = rare.unionByName(plain, True).unionByName(summed, True).unionByName(named, True)
    total = sums.groupBy("text").agg(
        F.max("id").alias(id_column),
        F.max("held").alias("held_out"),
        F.sum("tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    )
    return total.drop("text")


def language_scores(
    docs: DataFrame,
    held_out: Column,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_tokens: int = CHUNK_TOKENS,
    bucket_tokens: int = BUCKET_TOKENS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    The model learns from the rows where ``held_out`` is not true. A null text is empty (one token, the
    end); only the named columns are read; repeated rows count each, and a null id is kept. Texts of any
    length go on in further chunks. An empty table gives an empty result; without training rows every
    word is the unknown one, of probability 1. ``base_score`` adds one to every count; ``score`` is the model's.
    """
    chunks = token_table(docs, held_out, id_column, text_column, chunk_tokens)
    model = fit_chunks(chunks, bucket_tokens, frequent)
    return score_chunks(chunks, model, id_column)
