import corpus_pipeline
from arcwise.llm import decontaminate
from arcwise.llm.words import words_of
from tests.llm.common import FOLDER, needs_tables
from tests.llm.test_exact import brute
from tests.llm.test_packing import check_packing
from tests.llm.test_simhash import brute_components, plain_fingerprint


@needs_tables
def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = [{row.doc_id: row.text for row in docs.collect()}]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(number))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        if number < 4:
            assert docs.columns == columns
            kept.append({row.doc_id: row.text for row in docs.collect()})
            assert len(kept[-1]) == docs.count()
    before, graded, unique, distinct, clean = kept
    assert graded.items() <= before.items() and 0.5 * len(before) < len(graded) < len(before)
    assert set(unique) == {keep for _, keep, _, _ in brute(graded.items())}
    ids = sorted(unique)
    roots = brute_components([plain_fingerprint(unique[key]) for key in ids])
    first = {}
    for key, root in zip(ids, roots, strict=True):
        first.setdefault(root, key)
    assert set(distinct) == set(first.values())
    items = [words_of(row.text) for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def leaks(text):
        words = words_of(text)
        return any(min(decontaminate.edit_ends(own, words), default=99) <= decontaminate.edits_of(len(own)) for own in items if set(own) & set(words))

    assert set(clean) == {key for key, text in distinct.items() if not leaks(text)}
    check_packing(docs.collect(), list(clean.items()), 1024)


def test_stages_take_empty_and_odd_tables(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "a", None, None, 1), (1, "a", None, None, 1)]
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
    spark.createDataFrame([], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id LONG, quality INT, toxic INT").write.parquet(str(tmp_path / "labels.parquet"))
    for name, own in (("odd", rows), ("empty", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(own, schema).write.parquet(path)
        docs = spark.read.parquet(path)
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}{number}")
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)

