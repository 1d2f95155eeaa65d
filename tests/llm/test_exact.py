import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcwise.llm.catalog import op4_exact_dedup
from arcwise.llm.exact import FuseFilter, exact_groups
from tests.llm.common import FOLDER, docs_of, needs_tables


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), key is None, key or 0, key))
    found = []
    for bare, own in groups.items():
        keep = min(own, key=lambda one: one[:3])[3]
        digest = hashlib.sha256(bare.encode()).hexdigest()
        found += [(one[3], keep, len(own), digest) for one in own]
    return sorted(found, key=str)


def rows_of(result):
    return sorted(((r[0], r.keep_id, r.group_size, r.text_sha256) for r in result.collect()), key=str)


@needs_tables
def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    result = op4_exact_dedup(spark, FOLDER)
    assert rows_of(result) == brute([tuple(row) for row in docs])
    assert all(row.kept == (row.doc_id == row.keep_id) for row in result.collect())


EDGES = [
    (1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \n"), (7, "x" * 200_000), (8, "x" * 200_000),
    (9, "é"), (9, "é"), (None, "ab  "), (None, None), (12, " ab"), (13, "ab\x0b\x0c"),
]


@pytest.mark.parametrize("old", ["doc_id % 2 = 0", "true", "false", "doc_id > 5"])
def test_edges_do_not_depend_on_the_snapshot(spark, tmp_path, old):
    docs = docs_of(spark, tmp_path, EDGES)
    result = exact_groups(docs, F.expr(old))
    assert rows_of(result) == brute(EDGES)
    kept = [row for row in result.collect() if row.kept]
    assert len(kept) == len({row.text_sha256 for row in kept}) == len({t for *_, t in brute(EDGES)})


def test_empty_and_clashing_columns(spark, tmp_path):
    docs = docs_of(spark, tmp_path, [], "doc_id LONG, text STRING")
    assert exact_groups(docs, F.lit(True)).count() == 0
    docs = docs_of(spark, tmp_path, [(1, "a", "x", 0), (2, "a ", "y", 1)], "doc_id LONG, text STRING, digest STRING, old INT")
    assert [tuple(row)[:3] for row in exact_groups(docs, F.col("old") == 1).orderBy("doc_id").collect()] == [(1, 2, 2), (2, 2, 2)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    filters = FuseFilter.unpack(FuseFilter.build(keys).pack())
    assert filters.holds(keys).all()
    other = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert filters.holds(other).mean() < 0.001
