"""From raw documents to packed sequences: quality, exact and near duplicates, leaks, packing.

Every stage takes (spark, docs, sf_dir), where ``docs`` is a stored table, works on all of it, and
returns the documents it keeps with their columns, extra ones of any name too; the last one returns the
packed pieces. A null or empty text is a document like any other, repeated rows are judged each (of equal or
near texts one row stays, ties to the smallest id), texts are taken whole, and an empty table gives an empty one.
Rows are known by file and place, so a lost or added executor changes no decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm import catalog, decontaminate, exact, grading, packing, simhash, tokens
from arcwise.llm.frames import free_name, numbered, stored, table, with_keys

ROW = "_row"


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a stored table whose number is not in ``dropped`` (one column); any column stays as it was."""
    row = free_name(docs, ROW)
    keys = stored(dropped.toDF(row).distinct(), "dropped")
    return with_keys(numbered(docs, row), keys, row, keep=False).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are good and not toxic go on."""
    grader = grading.fit(docs, table(spark, sf_dir, "labels"), grading.label_grade(), grades=3)
    return grading.selected(docs, grader, 1, catalog.KEEP_CHANCE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest, then smallest id stays."""
    return _without(docs, exact.exact_groups(docs, F.col("doc_id") % 2 == 0).filter("NOT kept").select("row_id"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the smallest id stays."""
    return _without(docs, simhash.near_duplicates(docs).filter("NOT kept").select("row_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    texts = numbered(docs.select("text"), ROW)
    leaks = decontaminate.contaminations(texts, table(spark, sf_dir, "benchmark"), id_column=ROW)
    return _without(docs, leaks.select(ROW))


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.pack(tokens.cut_documents(docs, catalog.BYTE_BPE))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", bestfit_packing),
]

ORACLE_SQL = None  # fitting, CGK search, linking and packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
