import random
import re

import numpy as np
import xxhash

from arcwise.llm.catalog import op9_simhash
from arcwise.llm.components import components
from arcwise.llm.simhash import fingerprint, fingerprint_links, near_duplicates
from tests.llm.common import FOLDER, docs_of, needs_tables


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    return [root(k) for k in range(len(fps))]


def expected(rows):
    fps = [plain_fingerprint(text) for _, text in rows]
    roots = brute_components(fps)
    lowest = {}
    for (key, _), at in zip(rows, roots, strict=True):
        if key is not None:
            lowest[at] = min(lowest.get(at, key), key)
    return sorted(((key, f"{fp:016x}", lowest.get(at)) for (key, _), fp, at in zip(rows, fps, roots, strict=True)), key=str)


def rows_of(result):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in result.collect()), key=str)


@needs_tables
def test_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(op9_simhash(spark, FOLDER)) == expected([tuple(row) for row in docs])


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A"), (5, "a"), (6, "É é ß x"), (6, "É é ß x"), (None, "a"), (8, "w " * 40_000),
            (9, "one two three"), (10, "one two three four"), (11, "İ K   b c d")]
    docs = docs_of(spark, tmp_path, rows)
    result = near_duplicates(docs)
    assert rows_of(result) == expected(rows)
    groups = {row.component_id for row in result.collect()}
    assert sum(row.kept for row in result.collect()) == len(groups)
    assert near_duplicates(docs_of(spark, tmp_path, [])).count() == 0


def test_links_join_all_pairs_sparse_and_dense(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            value = base
            for bit in rng.sample(range(64), rng.randrange(0, 6)):
                value ^= 1 << bit
            fps.add(value)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(value,) for value in signed], "fp LONG")
    roots = brute_components(fps)
    wanted = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if roots[a] == roots[b]}
    place = {value: k for k, value in enumerate(signed)}
    for paired in (256, 2):
        links = fingerprint_links(frame, paired)
        for row in links.collect():
            assert (fps[place[row.a]] ^ fps[place[row.b]]).bit_count() <= 4
        found = {row.node: row.component for row in components(links).collect()}
        label = [found.get(value, value) for value in signed]
        assert {(a, b) for a in range(len(fps)) for b in range(len(fps)) if label[a] == label[b]} == wanted


def near_ones(base, count):
    """``count`` fingerprints within four bits of each other."""
    two = [value for a in range(64) for b in range(a) if (value := base ^ 1 << a ^ 1 << b)]
    return np.array(two[:count], np.uint64).view(np.int64).tolist()


def test_dense_fingerprints_are_never_broadcast(spark):
    frame = spark.createDataFrame([(value,) for value in near_ones(random.Random(8).getrandbits(64), 300)], "fp LONG")
    links = fingerprint_links(frame, 2)
    assert {row.component for row in components(links).collect()} == {min(value for row in links.collect() for value in row)}
    # A ball has 2,081 values per fingerprint, which Spark's sizes do not count; a broadcast goes through the driver.
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_dense_texts_need_no_large_broadcast(spark, tmp_path):
    rng = random.Random(10)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(key, f"other {key} text {key}") for key in range(600, 630)]
    for key in range(600):
        at = rng.randrange(200)
        rows.append((key, " ".join([*base[:at], f"e{key}", *base[at + 1 :]])))
    docs = docs_of(spark, tmp_path, rows)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "24m")
    try:
        assert rows_of(near_duplicates(docs, paired=2)) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    found = {row.node: row.component for row in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert {found[k] for k in range(301)} == {0} and {found[k] for k in range(1000, 1400)} == {1000}
    assert found[5000] == 5000


def test_fingerprint_of_long_text():
    text = " ".join(f"w{k % 977}" for k in range(70_000))
    assert fingerprint(text) == plain_fingerprint(text)
