"""Language identification, word first: known words by their log frequency per language, unseen words
by progressively shorter character n-grams.

All training words and all their n-grams count; the counts stay in stored tables, one row per term and
language. The commonest words and n-grams are sent to all tasks, where most of a text is scored as it is read.
Its other words meet the rest of the word table in one shuffle, whatever their number, and what is unseen there
backs off to n-grams. Only where the n-grams are too many to be sent whole do unseen words with an n-gram not
sent take a further shuffle to the n-gram table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcwise.llm.frames import batch_of, map_batches, stored

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
ASCII_WORD = regex.compile(r"[a-z]+")
WORDS_SENT, GRAMS_SENT = 200_000, 400_000  # most terms sent to the tasks,
ENTRIES_SENT = 8_000_000  # and most terms times languages
LONGEST = 4
MOST_LANGUAGES = 400
BACK_OFF = 0.4
HELD_TERMS = 300_000  # terms a task counts before it hands them on
LEVELS = 64  # steps of the counts' binary logarithm in which the commonest terms are told apart
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters with their marks; digits, fractions and numerals are none."""
    lower = text.lower()
    return (ASCII_WORD if lower.isascii() else WORD).findall(lower)


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word between marks; a word shorter than n - 2 has none."""
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


COUNTS = T.StructType(
    [T.StructField("term", T.StringType()), T.StructField("lang", T.IntegerType()), T.StructField("n", T.LongType())]
)


def _hand_on(counts: dict[int, Counter]) -> pa.RecordBatch:
    terms, langs, numbers = [], [], []
    for lang, own in counts.items():
        terms += own.keys()
        langs += [lang] * len(own)
        numbers += own.values()
    return batch_of(COUNTS, [terms, langs, numbers])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counts.values())) > HELD_TERMS:
                yield _hand_on(counts)
                counts = {}
    yield _hand_on(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {}
    for batch in batches:
        for word, lang, number in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            own = counts.setdefault(lang, Counter())
            for n in range(1, LONGEST + 1):
                for gram in grams_of(word, n):
                    own[gram] += number
        if sum(map(len, counts.values())) > HELD_TERMS:
            yield _hand_on(counts)
            counts = {}
    yield _hand_on(counts)


def _summed(partial: DataFrame) -> DataFrame:
    """term, lang, n, level (of the term's count over all languages), lead (its first row); one shuffle, by term."""
    by_lang = partial.repartition("term").groupBy("term", "lang").agg(F.sum("n").alias("n"))
    rows = by_lang.groupBy("term").agg(F.collect_list(F.struct("lang", "n")).alias("rows"), F.sum("n").alias("total"))
    level = F.floor(F.log2("total") * LEVELS).cast("int").alias("level")
    flat = rows.select("term", level, F.posexplode("rows").alias("at", "row"))
    return flat.select("term", "row.lang", "row.n", "level", (F.col("at") == 0).alias("lead"))


class Model:
    """Counts of all training words and n-grams per language, in stored tables.

    ``totals[n][k]`` counts the n-grams (words for n = 0) of language k, ``sizes[n]`` the distinct ones.
    """

    def __init__(self, languages: list[str], words: DataFrame, grams: DataFrame):
        self.languages, self.words, self.grams = languages, words, grams
        self.totals, self.sizes = np.zeros((LONGEST + 1, len(languages))), np.zeros(LONGEST + 1)
        self.levels: list[Counter] = [Counter(), Counter()]  # distinct words and n-grams per level
        sized = words.withColumn("size", F.lit(0)).union(grams.withColumn("size", F.length("term")))
        lead = F.count_if("lead").alias("terms")
        for size, lang, level, n, terms in sized.groupBy("size", "lang", "level").agg(F.sum("n"), lead).collect():
            self.totals[size, lang] += n
            self.sizes[size] += terms
            self.levels[size > 0][level] += terms

    def shares(self, size: int) -> np.ndarray:
        """What is taken from a term's log counts: log of the totals, and the price of each step back."""
        steps = LONGEST - size + 1 if size else 0
        return np.log(self.totals[size] + 1 + 0.5 * (self.sizes[size] + 1)) - steps * np.log(BACK_OFF)

    def least_level(self, grams: bool, most: int) -> int:
        """The lowest level from which on there are at most ``most`` terms."""
        least = max(self.levels[grams], default=0) + 1
        for level in sorted(self.levels[grams], reverse=True):
            most -= self.levels[grams][level]
            if most < 0:
                break
            least = level
        return least

    def vectors(self, table: DataFrame, grams: bool) -> tuple[dict[str, int], np.ndarray]:
        """Places and log frequencies of the terms of a small part of a table: half a count where there is none."""
        rows = table.select("term", "lang", "n").toArrow()  # at most ``ENTRIES_SENT`` counts
        places: dict[str, int] = {}
        at = np.array([places.setdefault(term, len(places)) for term in rows.column(0).to_pylist()], np.int64)
        counts = np.full((len(places), len(self.languages)), 0.5)
        counts[at, rows.column(1).to_numpy()] += rows.column(2).to_numpy()
        shares = np.array([self.shares(len(term) if grams else 0) for term in places]).reshape(counts.shape)
        return places, np.log(counts) - shares


def fit(texts: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Learns from all rows with a non-null text and language, every word and n-gram of 1 to 4 letters.

    More than ``MOST_LANGUAGES`` languages raise. A table without such rows gives a model of no language.
    """
    used = texts.select(F.col(text_column).alias("text"), F.col(lang_column).cast("string").alias("lang")).dropna()
    languages = [row[0] for row in used.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    number = F.array_position(F.array(*map(F.lit, languages)).cast("array<string>"), F.col("lang")) - 1
    numbered = used.select("text", number.cast("int").alias("lang"))
    words = stored(_summed(map_batches(numbered, _count_words, COUNTS)), "words")
    grams = stored(_summed(map_batches(words.select("term", "lang", "n"), _count_grams, COUNTS)), "grams")
    return Model(languages, words, grams)


LONG, TEXT, SUMS = T.LongType(), T.StringType(), T.ArrayType(T.DoubleType())
RARE = T.ArrayType(T.StructType().add("term", TEXT).add("times", LONG))


def predict(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    words_sent: int = WORDS_SENT,
    grams_sent: int = GRAMS_SENT,
) -> DataFrame:
    """One row per row of ``docs``: the id, lang_pred and score.

    ``score`` is the posterior of the language under equal priors. A null text, or one without a
    letter, is ``und`` with score 0, as is every text if nothing was learned. Ties go to the first
    language by name. Repeated rows are predicted each; other columns, of any name, are not read. Very long
    texts are scored whole, their rare words spread over the tasks. An empty table gives an empty one.
    Documents are read once. A word outside the training texts may stand in any share of the rows: it has no
    partner in the word table, and its side of the join may be split.
    """
    languages, spark = model.languages, docs.sparkSession
    if not languages:
        return docs.select(id_column, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    entries = ENTRIES_SENT // len(languages)
    word_level = model.least_level(False, min(words_sent, entries))
    gram_level = model.least_level(True, min(grams_sent, entries))
    whole = gram_level <= min(model.levels[1], default=0)
    sent_words = model.vectors(model.words.filter(F.col("level") >= word_level), False)
    sent_grams = model.vectors(model.grams.filter(F.col("level") >= gram_level), True)
    words, grams = spark.sparkContext.broadcast(sent_words), spark.sparkContext.broadcast(sent_grams)

    # A number per row is needed only until its sums are added up; this one scan gives it and all that carries it.
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = docs.schema[id_column].dataType
    schema = T.StructType().add("row", LONG).add("id", id_type).add("sums", SUMS).add("rare", RARE)
    scored = stored(map_batches(texts, _common_words(words, schema), schema), "scored")

    rare = scored.select("row", F.inline("rare"))
    known = model.words.filter(F.col("level") < word_level).select("term", "lang", "n", "lead")
    met = rare.join(known.hint("merge"), "term", "left").select("row", "term", "times", "lang", "n", "lead")
    late = T.StructType().add("row", LONG).add("sums", SUMS).add("left", RARE)
    sums = map_batches(met, _rare_words(grams, late, model.shares(0), whole), late)
    if not whole:
        sums = stored(sums, "rare_sums")
        open_words = sums.select("row", F.inline("left"))
        distinct = stored(open_words.select("term").distinct(), "open_words")
        vectors = _vectors_by_shuffle(distinct, model)
        scaled = F.transform("vector", lambda x: x * F.col("times"))
        found = open_words.join(vectors.hint("merge"), "term").select("row", scaled.alias("sums"))
        sums = sums.select("row", "sums").union(found)
    union = scored.select("row", "id", "sums").union(sums.select("row", F.lit(None).cast(id_type), "sums"))
    added = F.array(*[F.sum(F.get("sums", F.lit(k))) for k in range(len(languages))]).alias("sums")
    by_row = union.groupBy("row").agg(F.first("id", ignorenulls=True).alias("id"), added)
    result = T.StructType().add(id_column, id_type).add("lang_pred", TEXT).add("score", T.DoubleType())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for own in batch.column(1).to_pylist():
                total = None if own[0] is None else np.round(own, 9)
                best = -1 if total is None else int(total.argmax())
                names.append(UNKNOWN if best < 0 else languages[best])
                scores.append(0.0 if best < 0 else float(1 / np.exp(total - total[best]).sum()))
            yield batch_of(result, [batch.column(0), names, scores])

    return map_batches(by_row.select("id", "sums"), decide, result)


def _common_words(shared, schema):
    """The sum over a text's words that were sent, and its other words; no sum for a text without words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, vectors = shared.value
        for batch in batches:
            sums, rare = [], []
            for text in batch.column(2).to_pylist():
                own = Counter(words_of(text)) if text else {}
                at, times, others = [], [], []
                for word, count in own.items():
                    place = places.get(word)
                    if place is None:
                        others.append((word, count))
                    else:
                        at.append(place)
                        times.append(count)
                sums.append((np.array(times, float) @ vectors[np.array(at, np.int64)]).tolist() if own else None)
                rare.append(others)
            yield batch_of(schema, [batch.column(0), batch.column(1), sums, rare])

    return work


def _unseen(word: str, places: dict[str, int], whole: bool) -> list[int] | None:
    """Places of the word's longest n-grams that are known; None where the n-grams sent do not decide."""
    for n in range(LONGEST, 0, -1):
        own = [places.get(gram) for gram in grams_of(word, n)]
        if not whole and None in own:
            return None
        found = [place for place in own if place is not None]
        if found:
            return found
    return []


def _rare_words(shared, schema, shares: np.ndarray, whole: bool):
    """Sums per row of a batch over words that were not sent; unseen ones count by the mean of their n-grams."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, vectors = shared.value
        last, mean = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, terms, times, langs, counts, lead = batch.columns
            times, seen = times.to_numpy(), langs.is_valid().to_numpy(zero_copy_only=False)
            values = np.zeros((batch.num_rows, len(shares)))
            first = lead.fill_null(False).to_numpy(zero_copy_only=False)
            values[first] = times[first, None] * (np.log(0.5) - shares)
            at = np.flatnonzero(seen)
            own = np.log(2 * counts.fill_null(0).to_numpy()[at] + 1)  # log((n + 0.5) / 0.5)
            values[at, langs.fill_null(0).to_numpy()[at]] += times[at] * own
            left: dict[int, list] = {}
            for k in np.flatnonzero(~seen).tolist():
                word = terms[k].as_py()
                if word != last:  # rows come sorted by term
                    found = _unseen(word, places, whole)
                    last = word
                    mean = None if found is None else vectors[found].mean(axis=0) if found else np.zeros(len(shares))
                if mean is None:
                    left.setdefault(rows[k].as_py(), []).append((word, int(times[k])))
                else:
                    values[k] = times[k] * mean
            keys, back = np.unique(rows.to_numpy(), return_inverse=True)
            sums = np.zeros((len(keys), len(shares)))
            np.add.at(sums, back, values)
            yield batch_of(schema, [keys.tolist(), sums.tolist(), [left.get(key, []) for key in keys.tolist()]])

    return work


PIECES = T.StructType().add("word", TEXT).add("term", TEXT).add("times", LONG)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, grams, times = [], [], []
        for word in batch.column(0).to_pylist():
            own = Counter(gram for n in range(1, LONGEST + 1) for gram in grams_of(word, n))
            words += [word] * len(own)
            grams += own.keys()
            times += own.values()
        yield batch_of(PIECES, [words, grams, times])


def _vectors_by_shuffle(words: DataFrame, model: Model) -> DataFrame:
    """term, vector of distinct words by the whole n-gram table: the mean of their longest known n-grams."""
    size = F.length("term")
    pieces = map_batches(words, _pieces, PIECES).join(model.grams.hint("merge"), "term")
    per = [F.sum(F.when(F.col("lang") == k, F.col("times") * F.log(2 * F.col("n") + 1))) for k in range(len(model.languages))]
    by_size = pieces.groupBy("word", size.alias("size")).agg(
        F.sum(F.when(F.col("lead"), F.col("times"))).alias("times"), F.array(*[F.coalesce(x, F.lit(0.0)) for x in per]).alias("gains")
    )
    longest = by_size.groupBy("word").agg(F.max_by(F.struct("times", "gains", "size"), "size").alias("best"))
    base = F.array(*[F.lit((np.log(0.5) - model.shares(n)).tolist()) for n in range(1, LONGEST + 1)])
    own = F.get(base, F.col("best.size") - 1)
    vector = F.zip_with("best.gains", own, lambda gain, floor: gain / F.col("best.times") + floor)
    return longest.select(F.col("word").alias("term"), vector.alias("vector"))


def held_out(key: Column) -> Column:
    """A null id is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
