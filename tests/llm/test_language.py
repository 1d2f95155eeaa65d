import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from arcwise.llm.catalog import op3_language_backoff
from arcwise.llm.language import fit, grams_of, predict, words_of
from tests.llm.common import FOLDER, docs_of, needs_tables


class Plain:
    """The model over plain dictionaries of (text, lang) rows."""

    def __init__(self, rows):
        rows = [(text, lang) for text, lang in rows if text is not None and lang is not None]
        self.languages = sorted({lang for _, lang in rows})
        self.counts = [defaultdict(Counter) for _ in range(5)]  # words, then n-grams by length
        for text, lang in rows:
            for word in words_of(text):
                self.counts[0][word][lang] += 1
                for n in range(1, 5):
                    for gram in grams_of(word, n):
                        self.counts[n][gram][lang] += 1
        self.totals = [Counter() for _ in range(5)]
        for table, totals in zip(self.counts, self.totals, strict=True):
            for own in table.values():
                totals.update(own)

    def vector(self, term, n):
        price = (5 - n if n else 0) * math.log(0.4)
        size = 0.5 * (len(self.counts[n]) + 1)
        own = self.counts[n][term]
        return np.array([math.log((own[lang] + 0.5) / (self.totals[n][lang] + 1 + size)) + price for lang in self.languages])

    def predict(self, text):
        words = words_of(text) if text else []
        if not words or not self.languages:
            return "und", 0.0
        total = np.zeros(len(self.languages))
        for word in words:
            if word in self.counts[0]:
                total += self.vector(word, 0)
                continue
            for n in (4, 3, 2, 1):
                known = [gram for gram in grams_of(word, n) if gram in self.counts[n]]
                if known:
                    total += sum(self.vector(gram, n) for gram in known) / len(known)
                    break
        best = int(np.round(total, 9).argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def compare(docs, train, **sent):
    rows = docs.collect()
    plain = Plain([(row.text, row.lang) for row in train.collect()])
    got = defaultdict(list)
    for row in predict(docs, fit(train), **sent).collect():
        got[row.doc_id].append((row.lang_pred, row.score))
    assert sum(map(len, got.values())) == len(rows)
    wanted = defaultdict(list)
    for row in rows:
        wanted[row.doc_id].append(plain.predict(row.text))
    for key, own in wanted.items():
        for (lang, score), (other, near) in zip(sorted(own), sorted(got[key]), strict=True):
            assert lang == other and abs(score - near) < 1e-6, (key, lang, score, other, near)


def is_held_out(key):
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


@needs_tables
def test_whole_table_against_plain_dictionaries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    result = op3_language_backoff(spark, FOLDER)
    assert result.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows, got = docs.collect(), {row.doc_id: row for row in result.collect()}
    plain = Plain([(row.text, row.lang) for row in rows if not is_held_out(row.doc_id)])
    assert len(got) == len(rows)
    for row in rows:
        lang, score = plain.predict(row.text)
        own = got[row.doc_id]
        assert own.held_out == is_held_out(row.doc_id)
        assert own.lang_pred == lang and abs(own.score - score) < 1e-6
    held = [row for row in rows if is_held_out(row.doc_id) and row.lang is not None and words_of(row.text or "")]
    assert sum(row.lang == got[row.doc_id].lang_pred for row in held) >= 0.95 * len(held)


@needs_tables
def test_few_terms_sent_give_the_same(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id < 40")
    train = docs.filter("doc_id % 2 = 0")
    for sent in ({"words_sent": 0}, {"words_sent": 50, "grams_sent": 100}, {"words_sent": 0, "grams_sent": 0}):
        compare(docs, train, **sent)


def test_counts_are_whole(spark, tmp_path):
    rows = [(k, "once the cat sat", "en") for k in range(4)] + [(9, "der hund", "de"), (10, "the", "de"), (11, "rare", "en")]
    model = fit(docs_of(spark, tmp_path, rows))
    plain = Plain([row[1:] for row in rows])
    assert model.languages == ["de", "en"]
    for n, table in ((0, model.words), (1, model.grams)):
        got = {(row.term, model.languages[row.lang]): row.n for row in table.collect()}
        tables = plain.counts[:1] if n == 0 else plain.counts[1:]
        assert got == {(term, lang): k for own in tables for term, by in own.items() for lang, k in by.items()}
        assert table.filter("lead").count() == sum(map(len, tables)) == table.select("term").distinct().count()


def test_only_letters_are_words():
    assert words_of("½ ² Ⅳ 12 _ +") == []
    assert words_of("Ab1c हिन्दी x½y É") == ["ab", "c", "हिन्दी", "x", "y", "é"]


def test_edges(spark, tmp_path):
    schema = "doc_id LONG, text STRING, lang STRING, row LONG, id STRING, sums STRING, rare STRING, term STRING, n INT"
    extra = (7, "x", "y", "z", "t", 1)
    rows = [(1, None, "en"), (None, "a b", "en"), (3, "wort " * 50_000 + "½", "de"), (3, "x", None), (3, "x", None), (4, "½ ²", "en"), (5, "", None), (6, "qqq", None)]
    docs = docs_of(spark, tmp_path, [row + extra for row in rows], schema)
    compare(docs, docs)
    compare(docs, docs, words_sent=0, grams_sent=1)
    got = {row.doc_id: row for row in predict(docs, fit(docs)).collect()}
    assert [(got[key].lang_pred, got[key].score) for key in (1, 4, 5)] == [("und", 0.0)] * 3
    empty = docs_of(spark, tmp_path, [])
    assert predict(empty, fit(empty)).count() == 0
    one = docs_of(spark, tmp_path, [(1, "a", None)])
    assert predict(one, fit(one)).collect() == [(1, "und", 0.0)]


def test_ties_go_to_the_first_language(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [(1, "same words", "bb"), (2, "same words", "aa"), (3, "words same", None), (4, "ββ", None)])
    got = {row.doc_id: (row.lang_pred, row.score) for row in predict(docs, fit(docs)).collect()}
    assert got[3] == got[4] == ("aa", 0.5)


def test_rare_language_beside_a_dominant_one(spark, tmp_path):
    large = [(k, " ".join(f"{a}{b}{c}" for c in "abcdefghijklmnopqrst" for b in ("ka", "ko", "ki") for a in own) + " ", "aa") for k, own in
             enumerate(["".join(chr(97 + (k // 26**i) % 26) for i in range(3)) for k in range(at, at + 20)] for at in range(0, 1200, 20))]
    small = [(900 + k, "abakax cadakox", "bb") for k in range(3)]
    docs = docs_of(spark, tmp_path, [(a, b, c, None, None) for a, b, c in large + small])
    wanted = {k: lang for k, _, lang in large + small}
    for sent in ({}, {"words_sent": 1000}):
        assert {row.doc_id: row.lang_pred for row in predict(docs, fit(docs), **sent).collect()} == wanted
