import random

import numpy as np
from pyspark.sql import functions as F

from arcwise.llm import grading
from arcwise.llm.catalog import op5_ordinal_quality
from arcwise.llm.grading import fit, fit_rows, graded, label_grade, selected, terms_bins
from tests.llm.common import FOLDER, docs_of, needs_tables

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def made(n, seed=0):
    rng, rows = random.Random(seed), []
    for k in range(n):
        grade = k % 3
        words = [rng.choice(WORDS) for _ in range(30)]
        words += {0: ["spam", "buy"], 1: ["rude"], 2: []}[grade]
        rng.shuffle(words)
        rows.append((k, " ".join(words), grade))
    return rows


def test_held_out_grades(spark, tmp_path):
    rows = made(900)
    docs = docs_of(spark, tmp_path, [(key, text) for key, text, _ in rows])
    ratings = spark.createDataFrame([(key, grade) for key, _, grade in rows[:600]] + [(1, None), (None, 2), (5, 9)], "doc_id LONG, grade INT")
    grader = fit(docs, ratings, F.col("grade"), 3)
    assert list(grader.thresholds) == sorted(grader.thresholds)
    found = {row.doc_id: row for row in graded(docs, grader).collect()}
    right = sum(round(found[key].expected_grade) == grade for key, _, grade in rows[600:])
    assert right >= 0.95 * 300
    assert all(row.tails[0] >= row.tails[1] for row in found.values())
    kept = {row.doc_id for row in selected(docs, grader, 1, 0.5).collect()}
    assert kept == {key for key, row in found.items() if row.tails[1] >= 0.5}


@needs_tables
def test_whole_table(spark):
    result = op5_ordinal_quality(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = result.join(spark.read.parquet(f"{FOLDER}/labels.parquet").withColumn("grade", label_grade()), "doc_id").collect()
    assert result.count() == docs.count()
    junk = [row.kept for row in rows if row.grade < 2]
    good = [row.kept for row in rows if row.grade == 2]
    assert sum(junk) <= 0.2 * len(junk) and sum(good) >= 0.7 * len(good)


def test_edges(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [(1, None), (None, ""), (3, "w " * 60_000), (3, "a")])
    nothing = spark.createDataFrame([], "doc_id LONG, grade INT")
    assert {row.expected_grade for row in graded(docs, fit(docs, nothing, F.col("grade"), 3)).collect()} != set()
    one = spark.createDataFrame([(3, 2)], "doc_id LONG, grade INT")
    assert graded(docs, fit(docs, one, F.col("grade"), 3)).count() == 4
    empty = docs_of(spark, tmp_path, [])
    assert graded(empty, fit(empty, nothing, F.col("grade"), 3)).count() == 0
    assert fit_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 2).thresholds.shape == (1,)
    assert terms_bins(None) == terms_bins("")
    # The end of a text counts like its start, and compounds share the bin of their stem.
    assert terms_bins("a" + "b" * 9000) != terms_bins("a" + "b" * 4500 + "B" * 4500)
    assert len(set(terms_bins("lowercase")) & set(terms_bins("lowermost"))) > len(set(terms_bins("lowercase")) & set(terms_bins("uppermost")))


def test_label_grades_count_merits(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (0, 0), (0, 1), (1, None), (None, 0), (5, 0)], "quality INT, toxic INT")
    assert [row[0] for row in labels.select(label_grade()).collect()] == [2, 1, 1, 0, 2, None, None]


def test_only_telling_bins_reach_the_driver(spark, tmp_path, monkeypatch):
    rows = made(300)
    docs = docs_of(spark, tmp_path, [(key, f"{text} own{key}") for key, text, _ in rows])
    ratings = spark.createDataFrame([(key, grade) for key, _, grade in rows], "doc_id LONG, grade INT")
    seen = []
    plain = grading.fit_rows

    def kept(own, sizes, grade, grades):
        seen.append((own, sizes))
        return plain(own, sizes, grade, grades)

    monkeypatch.setattr(grading, "fit_rows", kept)
    grader = fit(docs, ratings, F.col("grade"), 3)
    # The same choice, made over all rows at once.
    bins, grade = [terms_bins(f"{text} own{key}") for key, text, _ in rows], np.array([row[2] for row in rows])
    telling = set()
    for k in range(2):
        above = (grade > k) - (grade > k).mean()
        for one in {x for row in bins for x in row}:
            there = np.array([one in row for row in bins])
            if there.sum() >= 4 and abs(above[there].sum()) / np.sqrt(there.sum() * above.var()) >= np.sqrt(2 * np.log(300)):
                telling.add(one)
    (own, sizes), = seen
    assert telling and set(own.tolist()) == telling and set(np.nonzero(grader.weights)[0]) <= telling
    assert len(sizes) == 300 and len(own) == sum(len(telling & set(row)) for row in bins)
