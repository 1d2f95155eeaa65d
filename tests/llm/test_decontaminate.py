import random

import numpy as np
from pyspark.sql import functions as F

from arcwise.llm.catalog import op2_cgk_decontamination
from arcwise.llm.decontaminate import SEGMENT_WORDS, Index, contaminations, edit_ends, edits_of, occurrences, segments_of, word_places
from arcwise.llm.words import words_of
from tests.llm.common import FOLDER, docs_of, needs_tables


def plain_ends(pattern, text):
    before, ends = list(range(len(pattern) + 1)), []
    for word in text:
        now = [0]
        for k, own in enumerate(pattern):
            now.append(min(now[k] + 1, before[k + 1] + 1, before[k] + (own != word or word == 0)))
        before = now
        ends.append(now[-1])
    return ends


def test_bit_parallel_distance():
    rng = random.Random(4)
    for _ in range(300):
        pattern = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 80))]
        text = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 120))]
        assert edit_ends(pattern, text) == plain_ends(pattern, text)
    assert occurrences([1, 2, 3, 4, 5], [9, 1, 2, 7, 4, 5, 9, 1, 2, 3, 4, 5], 1) == [(1, 6, 1), (7, 12, 0)]


@needs_tables
def test_whole_table_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    wanted = set()
    for doc in docs:
        words = words_of(doc.text or "")
        for item in items:
            own = words_of(item.text or "")
            if own and len(set(own) & set(words)) * 2 >= len(set(own)) and min(edit_ends(own, words), default=99) <= edits_of(len(own)):
                wanted.add((doc.doc_id, item.item_id))
    found = {(row.doc_id, row.item_id) for row in op2_cgk_decontamination(spark, FOLDER).collect()}
    assert found == wanted


def test_recall_under_edits_and_blocks(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(15, 70)))) for k in range(40)]
    docs, planted = [], set()
    for key in range(200):
        words = [rng.choice(vocabulary) for _ in range(200)]
        if key % 2:
            item = rng.randrange(40)
            own = items[item][1].split()
            for _ in range(len(own) // 12):  # about a twelfth of the words edited
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["new"], [own[at], "more"]])
            words[50:50] = own
            planted.add((key, item))
        docs.append((key, " ".join(words).title()))
    docs = docs_of(spark, tmp_path, docs)
    benchmark = spark.createDataFrame(items + [(90, None), (91, "!")], "item_id LONG, text STRING")
    found = {(row.doc_id, row.item_id) for row in contaminations(docs, benchmark).collect()}
    assert found <= planted and len(found) >= 0.95 * len(planted)
    again = {(row.doc_id, row.item_id) for row in contaminations(docs, benchmark, block_words=300).collect()}
    assert again <= planted and len(again) >= 0.95 * len(planted)


def test_edges(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [(1, None), (2, ""), (None, "a b c d e f"), (4, "x " * 60_000 + "a b c d e f"), (4, "q")])
    items = spark.createDataFrame([(1, "A, b; c D e f"), (1, "A, b; c D e f"), (2, "lone"), (None, "")], "item_id LONG, text STRING")
    rows = contaminations(docs, items).collect()
    assert sorted((str(row.doc_id), row.start, row.end) for row in rows) == [("4", 60_000, 60_006)] * 2 + [("None", 0, 6)] * 2
    none = spark.createDataFrame([], "item_id LONG, text STRING")
    assert contaminations(docs, none).count() == 0
    assert contaminations(docs_of(spark, tmp_path, []), items).count() == 0


def planted_texts(size, share, seed, count=60):
    """An index of random items, a text that holds each once with edits, and where."""
    rng = random.Random(seed)
    items = [(k, [f"w{rng.randrange(2000)}" for _ in range(size)]) for k in range(count)]
    index = Index([(k, " ".join(words)) for k, words in items])
    ids, planted = [0] * 60, []
    for key, words in items:
        own = list(words)
        for _ in range(size // share):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[], ["new"], [own[at], "more"]])
            own = own or ["new"]
        ids += [index.vocabulary[f"w{rng.randrange(2000)}"] for _ in range(50)]
        planted.append((key, len(ids), len(ids) + len(own)))
        ids += [index.vocabulary[word] for word in own] + [0] * 60
    return index, np.array(ids, np.int64), planted


def test_tables_reach_the_target_recall():
    for size in (5, 7, 10, 15, 29, 30, 60, 100, 200, 300):
        for share in (5, 6, 8, 12):
            index, ids, planted = planted_texts(size, share, size * 100 + share)
            found = index.search(ids)
            hits = sum(any(i == k and s < end and e > start for i, s, e, _ in found) for k, start, end in planted)
            assert hits >= 0.95 * len(planted), (size, share, hits)
    for size in (1, 2, 3, 4, 5, 40):  # copies without an edit
        index, ids, planted = planted_texts(size, 1000, size)
        assert {(i, s, e) for i, s, e, distance in index.search(ids) if distance == 0} >= set(planted)


def test_nothing_is_found_without_the_tables():
    index, ids, _ = planted_texts(30, 6, 1)
    assert index.search(ids)
    index.tables.clear()
    assert index.search(ids) == []


def test_segments_cover_an_item():
    for n in range(1, 400):
        cuts = segments_of(n)
        assert [low for low, _ in cuts] == [0, *[high for _, high in cuts[:-1]]] and cuts[-1][1] == n
        assert all(min(n, SEGMENT_WORDS) <= high - low < 2 * SEGMENT_WORDS for low, high in cuts)


def test_character_places_and_repeated_items(spark, tmp_path):
    text = "İx Ones Twos, ſome İ words Σας end"
    assert [text[a:b] for a, b in word_places(text)][-2:] == ["Σας", "end"]
    docs = docs_of(spark, tmp_path, [(1, text), (2, "none of it")]).withColumn("item_digest", F.lit("x"))
    items = spark.createDataFrame([(k, "ones twos ſome") for k in range(50)], "item_id LONG, text STRING")
    rows = contaminations(docs, items.withColumn("start", F.lit(7))).collect()
    assert sorted(row.item_id for row in rows) == list(range(50))
    assert {(row.doc_id, text[row.char_start : row.char_end], row.distance) for row in rows} == {(1, "Ones Twos, ſome", 0)}
