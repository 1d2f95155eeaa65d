"""Shared fixtures of the text operator tests."""

from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables not present")

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def docs_of(spark, tmp_path, rows, schema=DOCS):
    """A stored documents table of (doc_id, text) or full rows."""
    full = [tuple(row) + (None,) * (5 - len(row)) if schema == DOCS else row for row in rows]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(full, schema).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
