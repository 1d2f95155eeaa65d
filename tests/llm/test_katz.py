"""The language model against a plain one, word by word."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise.llm import katz
from arcwise.llm.catalog import op13_katz_scores
from tests.llm.common import DOCS, FOLDER, docs_of, needs_tables



def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


LOWER = {code: code + 32 for code in range(65, 91)}


def is_held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


class Plain:
    """P(w | h) from dictionaries of the training texts."""

    def __init__(self, rows):
        texts = [self.tokens(text) for key, text in rows if not is_held(key)]
        self.uni = Counter(w for t in texts for w in t)
        pairs = Counter(p for t in texts for p in zip([None, *t], t))
        self.n, self.types = sum(self.uni.values()), len(self.uni)
        self.factors = katz.discounts(Counter(self.uni.values())), katz.discounts(Counter(pairs.values()))
        kept = sum(self.less(c, 0) for c in self.uni.values())
        self.whole = self.n if kept < self.n - 1e-9 else self.n + 1
        self.unknown = 1 - kept / self.whole
        self.after = defaultdict(dict)
        for (h, w), c in pairs.items():
            self.after[h][w] = c
        self.facts = {}
        for h, own in self.after.items():
            raw, kept = sum(own.values()), sum(self.less(c, 1) for c in own.values())
            whole = raw if kept < raw - 1e-9 else raw + 1
            self.facts[h] = whole, (1 - kept / whole) / (1 - sum(map(self.single, own)))

    @staticmethod
    def tokens(text):
        return [w.translate(LOWER) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + ["</s>"]

    def less(self, count, level):
        return float(katz.discounted(np.array([count]), self.factors[level])[0])

    def single(self, w):
        return self.less(self.uni[w], 0) / self.whole if self.uni[w] else self.unknown

    def chance(self, h, w):
        if h not in self.facts:
            return self.single(w)
        whole, weight = self.facts[h]
        return self.less(self.after[h][w], 1) / whole if w in self.after[h] else weight * self.single(w)

    def row(self, key, text):
        own = self.tokens(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.n + self.types + 1)) for w in own)
        score = sum(math.log10(self.chance(h, w)) for h, w in zip([None, *own], own))
        return key, is_held(key), len(own), sum(self.uni[w] > 0 for w in own), self.n, base, score


def check(result, rows):
    plain = Plain(rows)
    found = sorted((tuple(r) for r in result.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    expected = sorted((plain.row(*row) for row in rows), key=str)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    assert [x for f in found for x in f[5:]] == pytest.approx([x for e in expected for x in e[5:]], rel=1e-9, abs=1e-9)
    return plain


def test_probabilities_after_any_history_sum_to_one():
    rows = [(k, " ".join(f"w{(k * j * j + j) % (5 + k)}" for j in range(k % 9))) for k in range(120)]
    plain = Plain(rows)
    for history in [*plain.facts, "never met"]:
        total = sum(plain.chance(history, w) for w in plain.uni) + plain.chance(history, "unknown word")
        assert total == pytest.approx(1, abs=1e-12)


@needs_tables
def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    plain = check(op13_katz_scores(spark, FOLDER), rows)
    unseen = [plain.row(*row) for row in rows if is_held(row[0])]
    # On texts it has not seen the model does better than single words with one added.
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)


@needs_tables
def test_small_chunks_buckets_and_few_frequent_words(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for limits in ({"chunk_tokens": 60, "bucket_tokens": 3000, "frequent": 50}, {"chunk_tokens": 1, "bucket_tokens": 9000, "frequent": 0}):
        some = [r for r in rows if len(r[1] or "") < 3000] if limits["frequent"] == 0 else rows
        frame = spark.createDataFrame(some, "doc_id LONG, text STRING")
        check(katz.language_scores(frame, held(), **limits), some)


def test_odd_rows(spark, tmp_path):
    text = "One two\tTHREE\x0btwo\xa0x é ÉA one two"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, "one two"), (None, None), (4, " \n "), (9, "never seen " * 5), (16, "b " * 3000)]
    rows += [(k, "same text again and again") for k in range(20, 60)]
    full = [(*row, None, None, 1) for row in rows]
    frame = docs_of(spark, tmp_path, full, DOCS).withColumns({n: F.lit("x") for n in ("word", "key", "held", "bucket", "first", "score")})
    check(katz.language_scores(frame, held(), chunk_tokens=50), rows)


def test_no_rows_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id LONG, text STRING")
    assert katz.language_scores(empty, held()).collect() == []
    key = next(k for k in range(100) if is_held(k))
    row = katz.language_scores(spark.createDataFrame([(key, "a b")], "doc_id LONG, text STRING"), held()).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0, 0)


def test_pairs_survive_packing():
    draw = np.random.default_rng(1)
    histories = np.sort(draw.integers(0, 50, 1000).astype(np.uint64) * np.uint64(1 << 57))
    words = np.where(draw.random(1000) < 0.3, draw.integers(1 << 62, 1 << 63, 1000).astype(np.uint64) | katz.RARE, draw.integers(0, 1 << 19, 1000).astype(np.uint64))
    counts = draw.integers(0, 1 << 31, 1000)
    back = katz.unpack_pairs(katz.pack_pairs(histories, words, [counts]))
    assert (back[0] == histories).all() and (back[1] == words).all() and (back[2][0] == counts).all()


def test_good_turing_factors():
    # r* = (r + 1) n[r + 1] / n[r]; with n = 100, 40, 22 and k = 1 the factor is (0.8 - 0.8) / (1 - 0.8) = 0 and will not do.
    assert katz.discounts({1: 100, 2: 40, 3: 22}, most=1)[-1] == 0
    found = katz.discounts({1: 100, 2: 30, 3: 15}, most=2)
    cut = 3 * 15 / 100
    assert found[1:3] == pytest.approx([(0.6 - cut) / (1 - cut), (0.75 - cut) / (1 - cut)])
    assert katz.discounts({}, most=5)[-1] == 0


@pytest.mark.parametrize("training", [True, False])
def test_dealing_a_chunk_needs_few_copies_of_it(training):
    rng = np.random.default_rng(3)
    size, types, texts = 200_000, 20_000, 400
    tokens = np.where(np.arange(size) % (size // texts) == 0, 1, rng.integers(2, types, size)).astype(np.int32)
    hashes = np.r_[0, 1, rng.integers(1 << 30, 1 << 60, types - 2)].astype(np.uint64)
    known = katz.Vocabulary(np.sort(hashes[2:]), np.arange(types - 2, dtype=np.uint32), np.ones(types), 1, 1, np.ones(7), 1.0, 0.1)
    chunk = katz.Tokens(0, hashes, np.zeros(texts, bool), np.full(texts, size // texts), tokens)
    tracemalloc.start()
    found = list(katz._dealt(chunk, known, np.zeros(0, np.uint64), 16, training))
    packed, (_, most) = sum(len(blob) for _, blob in found), tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most - packed <= 100 * size
    pairs = Counter(zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True))
    pairs = Counter({pair: n for pair, n in pairs.items() if pair[1] != 1})
    keys = known.keys(hashes)
    met = Counter()
    for bucket, blob in found:
        histories, words, numbers = katz.unpack_pairs(blob)
        assert set(katz.bucket_of(histories, words, np.zeros(0, np.uint64), 16)) == {bucket}
        owner = np.arange(len(words)) if training else np.repeat(np.arange(len(words)), numbers[0])
        for h, w, n in zip(histories[owner].tolist(), words[owner].tolist(), numbers[-1].tolist(), strict=True):
            met[h, w] += n
    assert met == Counter({(int(keys[h]), int(keys[w])): n for (h, w), n in pairs.items()})
