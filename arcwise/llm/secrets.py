"""Secret scans: plain patterns, and an assignment-aware lexer for source and configuration text.

The lexer (``lexer``) reads name-literal pairs, follows names that stand for other names or for joined
strings, and scores the literals that reach a sensitive target name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, map_batches
from arcwise.llm.lexer import lexed_spans

KINDS = ("assign", "access", "hex", "lexed")
# Base patterns; the letters of the assignment pattern match in either case.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST_ASSIGN]
    spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= LEAST_ACCESS]
    return spans + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``spans``, an array of (kind, start, end, value).

    Spans are in code points, the end exclusive. ``assign``, ``access`` and ``hex`` are the matches of
    the base patterns, ``lexed`` the literals found by the lexer that no base span of the kind
    ``assign`` already covers. A null or empty text has none; repeated rows are scanned each, other
    columns not read. Spans that start alike are ordered by kind, then by end. Texts of any length are read
    once, whole. An empty table gives an empty one.
    """
    span = T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("value", T.StringType()),
        ]
    )
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("spans", T.ArrayType(span)),
            T.StructField("base_sha256", T.StringType()),
            T.StructField("joined", T.StringType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, digests, lines = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                taken = [(start, end) for start, end, kind in base if kind == "assign"]
                # The base spans do not overlap, so only the last one before a literal can cover it.
                begins = [start for start, _ in taken]
                extra = []
                for start, end in lexed_spans(text):
                    at = bisect_right(begins, start) - 1
                    if at < 0 or end > taken[at][1]:
                        extra.append((start, end, "lexed"))
                every = sorted(base + extra, key=lambda one: (one[0], KINDS.index(one[2]), one[1]))
                spans.append([{"kind": k, "start": a, "end": b, "value": text[a:b]} for a, b, k in every])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                lines.append(joined(every))
            yield batch_of(schema, [batch.column(0), spans, digests, lines])

    return map_batches(docs.select(id_column, text_column), work, schema)
