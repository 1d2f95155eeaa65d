"""Quality by ordinal regression: graded ratings, one weight vector, ordered thresholds.

P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ...: all grades share the hashed-text weights.
The weights are fitted with an L1 penalty on a bounded sample of labelled rows; every document is
then scored by its expected grade and its tail probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, give_back, map_batches, numbered, stored

BINS = 1 << 20
GRADED_TEXTS = 512
SAMPLE_ROWS = 20_000
LEAST_SEEN = 4
STEPS, RATE, PENALTY = 400, 0.3, 2e-4
STEM = 5  # letters of the stem terms
EDGE = re.compile(r"^\W+|\W+$")


def shape_terms(text: str, words: list[str], distinct: int) -> list[str]:
    """Terms for the make-up of a text: repetition, letter case, marks, digits, each in coarse steps."""
    n = max(1, len(words))
    size = max(1, len(text))
    chars = Counter(text)
    upper = sum(count for char, count in chars.items() if char.isupper())
    lower = sum(count for char, count in chars.items() if char.islower())
    marks = chars["!"] + chars["|"] + chars["#"]
    digits = sum(chars[digit] for digit in "0123456789")
    return [
        f"\x00same{int(10 * distinct / n)}:{min(6, n.bit_length() // 2)}",
        f"\x00upper{int(10 * upper / max(1, upper + lower))}",
        f"\x00marks{min(10, int(200 * marks / size))}",
        f"\x00digits{min(10, int(40 * digits / size))}",
        f"\x00long{min(10, size // n)}",
        f"\x00count{n.bit_length()}",
    ]


def terms_bins(text: str | None) -> list[int]:
    """Distinct hash bins of a text's words without outer marks, of their stems, and of its shape.

    A stem, the first ``STEM`` letters of a longer word, stands for compounds and endings not seen before.
    """
    text = text or ""
    words = text.lower().split()
    bare = set(words)
    terms = {EDGE.sub("", word) or word for word in bare}
    terms.update([f"\x00stem{word[:STEM]}" for word in terms if len(word) > STEM])
    terms.update(shape_terms(text, words, len(bare)))
    return sorted({zlib.crc32(term.encode()) % BINS for term in terms})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Grader:
    """Weights and thresholds of a cumulative-link model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for every text and every k below the highest grade."""
        scores = np.array([self.weights[terms_bins(text)].sum() for text in texts])
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def telling_bins(sample: DataFrame, grades: int) -> DataFrame:
    """The bins (``bin``) of a table of (bins, grade) that get a weight.

    Only bins seen in ``LEAST_SEEN`` rows do, and only those whose share above some grade is
    apart from the average by as many standard deviations as chance alone may give among n rows,
    the root of 2 ln n. So rare words are not learned by heart.
    """
    rows = [F.count(F.when(F.col("grade") > k, 1)) for k in range(-1, grades - 1)]
    n, *above = sample.agg(*rows).first()
    least = math.sqrt(2 * math.log(max(1, n)))
    seen, *higher = (column.alias(f"over{k}") for k, column in enumerate(rows))
    counted = sample.select(F.explode("bins").alias("bin"), "grade").groupBy("bin").agg(seen, *higher)
    seen, strong = F.col("over0"), F.lit(False)
    for k, total in enumerate(above, 1):
        share = total / max(1, n)
        apart = F.abs(F.col(f"over{k}") - F.lit(share) * seen) / F.sqrt(seen * F.lit(max(share * (1 - share), 1e-9)))
        strong = strong | (apart >= F.lit(least))
    return counted.filter((seen >= LEAST_SEEN) & strong).select("bin")


def fit_rows(own: np.ndarray, sizes: np.ndarray, grade: np.ndarray, grades: int) -> Grader:
    """Proximal AdaGrad on the ordinal likelihood, all rows in every step.

    ``own`` are the telling bins of all rows in turn, ``sizes`` how many each row has. A row
    counts by the inverse root of its grade's share. Without rows all weights are 0.
    """
    n = len(grade)
    if not n:
        return Grader(np.zeros(BINS), np.arange(grades - 1.0))
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    used, inverse = np.unique(own, return_inverse=True)
    weights = np.zeros(BINS)
    counts = np.bincount(grade, minlength=grades)
    share = 1 / np.sqrt(counts[grade])
    share /= share.sum()
    w, squares = np.zeros(len(used)), np.full(len(used), 1e-8)
    start, steps = 0.0, np.zeros(grades - 2)  # thresholds are start + cumulated exp(steps)
    s_start, s_steps = 1e-8, np.full(grades - 2, 1e-8)
    for _ in range(STEPS):
        thresholds = start + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
        z = np.bincount(owner, w[inverse], minlength=n)[:, None] - thresholds[None, :]
        s = _sigmoid(z)
        # Likelihood of grade k: s_(k-1) - s_k, with s_(-1) = 1 and s_last = 0.
        full = np.hstack([np.ones((n, 1)), s, np.zeros((n, 1))])
        chance = np.maximum(np.take_along_axis(full, grade[:, None], 1) - np.take_along_axis(full, grade[:, None] + 1, 1), 1e-9)
        slope = s * (1 - s)
        sign = np.zeros_like(s)
        at = np.arange(n)
        has_low, has_high = grade > 0, grade < grades - 1
        sign[at[has_low], grade[has_low] - 1] = 1
        sign[at[has_high], grade[has_high]] -= 1
        by_z = -share[:, None] * sign * slope / chance
        g = np.bincount(inverse, by_z.sum(axis=1)[owner], minlength=len(used))
        squares += g * g
        size = RATE / np.sqrt(squares)
        w = w - size * g
        w = np.sign(w) * np.maximum(np.abs(w) - size * PENALTY, 0)
        by_t = -by_z.sum(axis=0)
        s_start += by_t.sum() ** 2
        start -= RATE * by_t.sum() / np.sqrt(s_start)
        if grades > 2:
            g_steps = np.cumsum(by_t[::-1])[::-1][1:] * np.exp(steps)
            s_steps += g_steps**2
            steps = np.clip(steps - RATE * g_steps / np.sqrt(s_steps), -5, 5)
    weights[used] = w
    return Grader(weights, start + np.concatenate([[0.0], np.cumsum(np.exp(steps))]))


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    grade: Column,
    grades: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    sample_rows: int = SAMPLE_ROWS,
) -> Grader:
    """Fits on at most ``sample_rows`` rated documents, those with the smallest hashes of their id.

    ``grade`` is an expression over ``ratings`` from 0 to ``grades - 1``; rows with another or a null
    grade, or a null id, teach nothing. A document with several ratings counts by its lowest one.
    """
    rated = ratings.select(F.col(id_column), grade.cast("int").alias("_grade"))
    rated = rated.filter(F.col("_grade").between(0, grades - 1) & F.col(id_column).isNotNull())
    rated = rated.groupBy(id_column).agg(F.min("_grade").alias("_grade"))
    # Chosen before the texts are joined: few ids against the whole table.
    ids = docs.select(id_column).distinct().join(rated, id_column).orderBy(F.xxhash64(id_column), id_column).limit(sample_rows)
    # Repeated ids teach once: each text is taken from one of its rows.
    texts = docs.select(id_column, text_column).join(F.broadcast(ids), id_column).dropDuplicates([id_column])
    schema = T.StructType(
        [T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("grade", T.IntegerType())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [terms_bins(text) for text in batch.column(0).to_pylist()]
            yield batch_of(schema, [bins, batch.column(1)])

    sample = stored(map_batches(texts.select(text_column, "_grade"), work, schema), "rated")
    telling = np.sort(telling_bins(sample, grades).toArrow().column(0).to_numpy())  # fewer than ``BINS``

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [own[np.isin(own, telling)] for own in (np.asarray(row, np.int32) for row in batch.column(0).to_pylist())]
            yield batch_of(schema, [bins, batch.column(1)])

    rows = map_batches(sample, told, schema).toArrow()  # at most ``sample_rows`` rows, of telling bins alone
    bins = rows.column(0).combine_chunks()
    sizes = np.diff(bins.offsets.to_numpy())
    grader = fit_rows(bins.flatten().to_numpy(), sizes, rows.column(1).to_numpy(), grades)
    del rows, bins
    give_back()
    return grader


def graded(docs: DataFrame, grader: Grader, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, row_id, expected_grade and ``tails``, P(grade > k) for each k.

    A null text is an empty one. Repeated rows are graded each, other columns not read; ``row_id`` is
    the number of ``frames.numbered`` over ``docs``. An empty table gives an empty one.
    """
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("row_id", T.LongType()),
            T.StructField("expected_grade", T.DoubleType()),
            T.StructField("tails", T.ArrayType(T.DoubleType())),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tails = shared.value.tails(batch.column(2).to_pylist())
                yield batch_of(schema, [batch.column(0), batch.column(1), tails.sum(axis=1), tails.tolist()])

    rows = numbered(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), "row_id")
    return map_batches(rows.select("id", "row_id", "text"), work, schema)


def label_grade() -> Column:
    """Grade of a label row, its number of merits: one for quality, one for not being toxic.

    A null toxic counts as 0; a quality other than 0 and 1 gives no grade.
    """
    clean = (F.coalesce(F.col("toxic"), F.lit(0)) == 0).cast("int")
    return F.when(F.col("quality").isin(0, 1), F.col("quality") + clean)


def selected(docs: DataFrame, grader: Grader, above: int, least: float, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose P(grade > ``above``) is at least ``least``.

    Only texts go to Python and only probabilities come back. A null text is an empty one; repeated rows
    are judged each, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grader)

    @F.arrow_udf("double")
    def tail(texts: pa.Array) -> pa.Array:
        slices = [texts.slice(at, GRADED_TEXTS).to_pylist() for at in range(0, len(texts), GRADED_TEXTS)]
        found = [shared.value.tails(part)[:, above] for part in slices]
        del slices
        give_back()
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return docs.filter(tail(F.col(text_column)) >= least)
