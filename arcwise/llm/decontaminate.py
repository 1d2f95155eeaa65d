"""Benchmark decontamination: CGK walks turn edit distance into Hamming distance, bit-sampling finds pairs.

A CGK walk reads a word sequence step by step; a random bit of (step, word) tells whether it moves on.
Two sequences of small edit distance give outputs that mostly agree place by place. Items are cut into
segments of 15 to 29 words (shorter ones are one segment), as walks drift apart over many edits; if an item
is within its distance, one of its segments is within its share of it. Each table samples a few places
of a walk over every segment-sized window; equal samples are candidates, and the whole item around each
candidate is verified by exact edit distance. Only windows near a run of words that a segment within its
distance must share are walked: with e edits in n words, n div (e + 1) successive words stay untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, free_name, map_batches, stored
from arcwise.llm.words import WORD, words_of

EDIT_SHARE = 5  # one edit per so many words is allowed
SEGMENT_WORDS = 15  # at least so many words to a segment of a longer item
WALKS, TABLES, PLACES = 4, 10, 4
BLOCK_WORDS = 400_000  # words of benchmark items that are searched for in one pass
CLASS_STEP = 1.35
GRAM_BITS, KEY_BITS = 22, 18
SLICE_STARTS = 200_000
SEARCHED_TEXTS = 256
MIX = 0x9E3779B97F4A7C15


class Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return 0


def edits_of(n: int) -> int:
    return n // EDIT_SHARE


def segments_of(n: int) -> list[tuple[int, int]]:
    """First and end word of the segments of an item of ``n`` words."""
    count = max(1, n // SEGMENT_WORDS)
    return [(n * k // count, n * (k + 1) // count) for k in range(count)]


def edit_ends(pattern: list[int], text: list[int]) -> list[int]:
    """Least edits between the pattern and a stretch of the text that ends at each place (bit-parallel)."""
    n = len(pattern)
    at: dict[int, int] = defaultdict(int)
    for k, word in enumerate(pattern):
        at[word] |= 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, ends = full, 0, n, []
    for word in text:
        equal = at.get(word, 0) if word else 0
        x = equal | down
        d0 = (((x & up) + up) ^ up) | x
        h_up, h_down = down | (full & ~(d0 | up)), up & d0
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up, down = h_down | (full & ~(d0 | h_up)), h_up & d0
        ends.append(score)
    return ends


def occurrences(pattern: list[int], text: list[int], edits: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the best stretch in each run of places within ``edits``."""
    ends = edit_ends(pattern, text)
    close = [k for k, distance in enumerate(ends) if distance <= edits]
    runs: list[list[int]] = []
    for k in close:
        if runs and k - runs[-1][-1] <= max(1, len(pattern) // 2):
            runs[-1].append(k)
        else:
            runs.append([k])
    found = []
    for run in runs:
        end = min(run, key=lambda k: (ends[k], k))
        back = edit_ends(pattern[::-1], text[max(0, end - len(pattern) - edits) : end + 1][::-1])
        length = min(range(len(back)), key=lambda k: (back[k], k)) + 1
        found.append((end + 1 - length, end + 1, ends[end]))
    return found


class Index:
    """The LSH tables of a bounded block of items."""

    def __init__(self, items: list[tuple[object, str]], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.vocabulary = Vocabulary()
        self.items: list[tuple[object, list[int]]] = []
        for key, text in items:
            words = words_of(text or "")
            for word in words:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
            if words:
                self.items.append((key, [self.vocabulary[word] for word in words]))
        # Segments: item, first word, words, and edits that one of the item's segments stays within.
        self.segments: list[tuple[int, int, list[int], int]] = []
        for number, (_, words) in enumerate(self.items):
            cuts = segments_of(len(words))
            edits = edits_of(len(words)) // len(cuts)
            self.segments += [(number, low, words[low:high], edits) for low, high in cuts]
        sizes = [len(words) for _, _, words, _ in self.segments] or [1]
        # The runs of words of all segments by length q, each once and in order; tables below are as long as these.
        # One byte per value of a run's hash tells first whether there is any such run.
        own: dict[int, list[np.ndarray]] = {}
        for _, _, words, edits in self.segments:
            q = self._run_of(len(words), edits)
            own.setdefault(q, []).append(self._grams(np.array(words, np.int64), q))
        self.known = {q: np.unique(np.concatenate(parts)) for q, parts in own.items()}
        self.any = {q: np.zeros(1 << GRAM_BITS, bool) for q in own}
        for q, known in self.known.items():
            self.any[q][known] = True
        # For each run of words: how far before it a window of its segments may start, at least and at most.
        self.grams = {q: (np.full(len(k), 1 << 30, np.int32), np.full(len(k), -(1 << 30), np.int32)) for q, k in self.known.items()}
        for _, _, words, edits in self.segments:
            q = self._run_of(len(words), edits)
            ranks = np.searchsorted(self.known[q], self._grams(np.array(words, np.int64), q))
            places = np.arange(len(ranks), dtype=np.int32)
            np.minimum.at(self.grams[q][0], ranks, places - edits)
            np.maximum.at(self.grams[q][1], ranks, places + edits)
        classes, size = [], min(sizes)
        while size <= max(sizes):
            classes.append(size)
            size = max(size + 1, int(size * CLASS_STEP))
        self.classes = [c for k, c in enumerate(classes) if any(self._class(n, classes) == k for n in sizes)]
        # Places of a class lie within the first 3/2 of its words, where a walk is mostly still inside the segment;
        # segments without edits are sampled where it surely is.
        self.steps = max(2, int(1.5 * max(self.classes)))
        self.bits = rng.integers(0, 2, (WALKS, self.steps, 1 << 10), dtype=np.int8)
        steps_of = {c: c if c < EDIT_SHARE else int(1.5 * c) for c in self.classes}
        self.places = [
            [[sorted(rng.choice(steps_of[c], PLACES, c < 4).tolist()) for _ in range(TABLES)] for c in self.classes]
            for _ in range(WALKS)
        ]
        self.tables: dict[tuple, dict[int, list[int]]] = {}
        self.marks: dict[tuple, np.ndarray] = {}
        for number, (_, _, words, _) in enumerate(self.segments):
            own = self._class(len(words), self.classes)
            ids = np.concatenate([np.array(words, np.int64), np.zeros(self.steps + 1, np.int64)])
            for walk in range(WALKS):
                for (c, table), keys in self._walk(ids, np.zeros(1, np.int64), walk, own):
                    self.tables.setdefault((walk, c, table), {}).setdefault(int(keys[0]), []).append(number)
        for place, table in self.tables.items():
            mark = np.zeros(1 << KEY_BITS, bool)
            mark[(np.array(list(table), np.uint64) >> np.uint64(64 - KEY_BITS)).astype(np.int64)] = True
            self.marks[place] = mark

    @staticmethod
    def _class(n: int, classes: list[int]) -> int:
        return max(k for k, c in enumerate(classes) if c <= n)

    @staticmethod
    def _grams(ids: np.ndarray, q: int) -> np.ndarray:
        if len(ids) < q:
            return np.zeros(0, np.int64)
        h = np.zeros(len(ids) - q + 1, np.uint64)
        for k in range(q):
            h = (h + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
        return (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)

    @staticmethod
    def _run_of(n: int, edits: int) -> int:
        return min(3, n // (edits + 1))

    def _met(self, ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's runs that some segment has, and their ranks among the segments' runs."""
        grams = self._grams(ids, q)
        places = np.flatnonzero(self.any[q][grams] & (ids[: len(grams)] > 0))
        return places, np.searchsorted(self.known[q], grams[places])

    def _walk(self, ids: np.ndarray, starts: np.ndarray, walk: int, only: int | None = None):
        """((class, table), key per start) of one walk from every start."""
        classes = range(len(self.classes)) if only is None else [only]
        wanted = [(c, t) for c in classes for t in range(TABLES)]
        by_step = defaultdict(list)
        for c, t in wanted:
            for place in self.places[walk][c][t]:
                by_step[place].append((c, t))
        keys = {one: np.zeros(len(starts), np.uint64) for one in wanted}
        at = starts.copy()
        for step in range(max(by_step) + 1):
            words = ids[at]
            for one in by_step.get(step, ()):
                keys[one] = (keys[one] + words.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
                keys[one] ^= keys[one] >> np.uint64(29)
            at += self.bits[walk, step][words & 1023]
        for one in wanted:
            yield one, keys[one] * np.uint64(MIX)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Starts of the windows that may hold a segment."""
        change = np.zeros(len(ids) + 1, np.int64)
        for q, (least, most) in self.grams.items():
            hit, own = self._met(ids, q)
            np.add.at(change, np.clip(hit - most[own], 0, len(ids)), 1)
            np.add.at(change, np.clip(hit - least[own] + 1, 0, len(ids)), -1)
        return np.flatnonzero(np.cumsum(change[:-1]) > 0)

    def search(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, distance) of every item found in the word ids."""
        padded = np.concatenate([ids, np.zeros(self.steps + 1, np.int64)])
        near: dict[int, list[int]] = defaultdict(list)
        every = self.starts(ids)
        for cut in range(0, len(every), SLICE_STARTS):
            starts = every[cut : cut + SLICE_STARTS]
            for walk in range(WALKS):
                for (c, t), keys in self._walk(padded, starts, walk):
                    table = self.tables.get((walk, c, t))
                    if table is None:
                        continue
                    marked = self.marks[walk, c, t][(keys >> np.uint64(64 - KEY_BITS)).astype(np.int64)]
                    for k in np.flatnonzero(marked).tolist():
                        for segment in table.get(int(keys[k]), ()):
                            item, first = self.segments[segment][:2]
                            near[item].append(int(starts[k]) - first)
        found = []
        for item, own in near.items():
            words = self.items[item][1]
            edits, last = edits_of(len(words)), -1
            for start, end in merged(own, len(words) + 2 * edits):
                low, end = max(0, start - edits, last), max(0, end)
                for a, b, distance in occurrences(words, ids[low : end + len(words) + edits].tolist(), edits):
                    found.append((item, low + a, low + b, distance))
                    last = low + b
        return found


def word_places(text: str) -> list[tuple[int, int]]:
    """First and end character of each word, in the text as it is given."""
    low = text.lower()
    if len(low) == len(text):
        return [found.span() for found in WORD.finditer(low)]
    # Some letters grow longer in lower case: each lower-case character goes back to the one it came from.
    origin = [at for at, letter in enumerate(text) for _ in letter.lower()]
    return [(origin[found.start()], origin[found.end() - 1] + 1) for found in WORD.finditer(low)]


def merged(starts: list[int], gap: int) -> list[tuple[int, int]]:
    """First and last of the runs of starts that lie at most ``gap`` apart."""
    runs: list[list[int]] = []
    for start in sorted(set(starts)):
        if runs and start - runs[-1][1] <= gap:
            runs[-1][1] = start
        else:
            runs.append([start, start])
    return [(a, b) for a, b in runs]


def contaminations(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per occurrence of a benchmark item in a document.

    Columns: the document's id, item_id, start, end (words, the end exclusive), char_start, char_end,
    distance (word edits, at most one per ``EDIT_SHARE`` words of the item) and similarity. Words are
    lower-case runs of letters, digits and underscores; characters are counted in the text as it is given. Null and
    wordless texts and items match nothing, empty tables give an empty one. Texts of any length are searched whole.
    Repeated rows and items are found each; of overlapping places of an item the closest is given, of equally close
    ones the first. Columns besides the named ones are not read. Distinct items are searched in blocks of about
    ``block_words`` words at most (or one item), one pass over the documents per block.
    """
    spark = docs.sparkSession
    digest = free_name(docs.select(id_column), "item_digest")
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField(digest, T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
            T.StructField("distance", T.IntegerType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    # Equal items are searched for once, so a block has a bound however often one is repeated.
    own = items.filter(F.col(item_text).isNotNull()).select(
        F.col(item_column).alias("item_id"), F.col(item_text).alias("text"), F.sha2(item_text, 256).alias(digest)
    )
    own = stored(own, "items")
    distinct = own.select(digest, "text").distinct()
    total = distinct.agg(F.sum(F.size(F.split("text", r"\W+")))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1
    if blocks > 1:
        distinct = stored(distinct.withColumn("block", F.pmod(F.xxhash64(digest), F.lit(blocks))), "blocks")
    parts = []
    for block in range(blocks):
        rows = (distinct.filter(F.col("block") == block) if blocks > 1 else distinct).collect()  # of bounded size
        rows = sorted((row[digest], row["text"]) for row in rows)
        index = spark.sparkContext.broadcast(Index(rows))
        part = map_batches(docs.select(id_column, text_column), _searcher(index, schema), schema)
        parts.append(part if blocks == 1 else stored(part, "found"))
        if blocks > 1:
            index.unpersist()
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    keys = own.select("item_id", F.col(digest).alias("digest_"))
    found = result.withColumnRenamed(id_column, "row_").join(keys, F.col(digest) == F.col("digest_"))
    rest = ("start", "end", "char_start", "char_end", "distance", "similarity")
    return found.select(F.col("row_").alias(id_column), "item_id", *rest)


def _searcher(shared, schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        get = index.vocabulary.__getitem__
        for batch in batches:
            rows, columns = [], [[] for _ in range(7)]
            texts = batch.column(1).to_pylist() if index.items else []
            for low in range(0, len(texts), SEARCHED_TEXTS):
                # Texts are searched together, apart by more unknown words than a walk has steps.
                own = texts[low : low + SEARCHED_TEXTS]
                sizes, parts = [], []
                for text in own:
                    words = words_of(text) if text else []
                    parts += [np.fromiter(map(get, words), np.int64, len(words)), np.zeros(index.steps + 1, np.int64)]
                    sizes.append(len(words))
                begins = np.cumsum([0] + [size + index.steps + 1 for size in sizes])
                places: dict[int, list] = {}
                for item, start, end, distance in index.search(np.concatenate(parts)):
                    at = int(np.searchsorted(begins, start, side="right")) - 1
                    start, end = start - int(begins[at]), min(end - int(begins[at]), sizes[at])
                    text = own[at]
                    if at not in places:
                        places[at] = word_places(text)
                    key, pattern = index.items[item]
                    spans = places[at][start][0], places[at][end - 1][1]
                    rows.append(low + at)
                    values = (key, start, end, *spans, distance, 1 - distance / len(pattern))
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
            yield batch_of(schema, [batch.column(0).take(pa.array(rows, pa.int64())), *columns])

    return work
