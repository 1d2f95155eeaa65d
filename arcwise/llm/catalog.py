"""The text operators as queries over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwise.llm import (
    centroids,
    conversations,
    decontaminate,
    exact,
    gnat,
    grading,
    katz,
    language,
    matrix,
    packing,
    passages,
    secrets,
    simhash,
    tokens,
)
from arcwise.llm.frames import table
from arcwise.llm.oracles import LLM_ORACLES

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


KEEP_CHANCE = 0.5
"""Least probability of the highest grade (good and not toxic) with which a document is kept."""


def op1_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def op2_cgk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op3_language_backoff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.filter(~language.held_out(F.col("doc_id"))))
    predicted = language.predict(docs, model)
    return predicted.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Even ids stand for the snapshot, odd and null ids for what comes in."""
    docs = table(spark, folder, "documents")
    return exact.exact_groups(docs, F.col("doc_id") % 2 == 0).drop("row_id")


def quality_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades of all documents by a model fitted on the labelled ones: 2 good, 1 poor or toxic, 0 both."""
    grader = grading.fit(docs, labels, grading.label_grade(), grades=3)
    return grading.graded(docs, grader).withColumn("kept", F.get("tails", F.lit(1)) >= KEEP_CHANCE)


def op5_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    graded = quality_grades(table(spark, folder, "documents"), table(spark, folder, "labels"))
    tails = [F.get("tails", F.lit(k)).alias(f"p_grade_above_{k}") for k in range(2)]
    return graded.select("doc_id", "expected_grade", *tails, "kept")


def op6_secret_lexer(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, "base_sha256", F.col("joined").alias("spans"))


def op7_bestfit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(tokens.cut_documents(table(spark, folder, "documents"), BYTE_BPE))


def op8_packed_matrices(spark: SparkSession, folder: str) -> DataFrame:
    return matrix.packed_rows(table(spark, folder, "documents"), BYTE_BPE)


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("row_id")


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.chat_pages(table(spark, folder, "conversations"))


def op11_gnat_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ids divisible by 50 are the anchors; labels of ids divisible by 7 are shifted by one."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", shifted)
    return gnat.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_laesa_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.pivot_clusters(table(spark, folder, "embeddings"))


def op13_katz_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz.language_scores(table(spark, folder, "documents"), held_out)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chained_passages": op1_chained_passages,
    "op2_cgk_decontamination": op2_cgk_decontamination,
    "op3_language_backoff": op3_language_backoff,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_secret_lexer": op6_secret_lexer,
    "op7_bestfit_packing": op7_bestfit_packing,
    "op8_packed_matrices": op8_packed_matrices,
    "op9_simhash": op9_simhash,
    "op10_chat_format": op10_chat_format,
    "op11_gnat_negatives": op11_gnat_negatives,
    "op12_laesa_centroids": op12_laesa_centroids,
    "op13_katz_scores": op13_katz_scores,
}

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]
