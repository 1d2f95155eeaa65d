import random

import pytest

from arcwise.llm.catalog import op10_chat_format
from arcwise.llm.conversations import chat_pages
from tests.llm.common import FOLDER, needs_tables

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, page STRING"


def brute(rows):
    own = {}
    for key, turn, role, text in {tuple(row)[:4] for row in rows}:
        own.setdefault(key, []).append((turn is not None, turn or 0, role or "unknown", text or "", turn))
    whole = {key: tuple(t[2:4] for t in sorted(set(turns), key=lambda t: t[:4])) for key, turns in own.items()}
    found = []
    for key, turns in whole.items():
        if any(len(other) > len(turns) and other[: len(turns)] == turns for other in whole.values()):
            continue
        same = [k for k, other in whole.items() if other == turns]
        if key == min(same, key=lambda k: (k is None, k or 0)):
            text = "".join(f"<|im_start|>{role}\n{line}<|im_end|>\n" for role, line in turns)
            found.append((key, len(turns), len(same), text))
    return sorted(found, key=str)


def rows_of(result):
    pages = {}
    for row in result.orderBy("page").collect():
        pages.setdefault((row.conv_id, row.n_turns, row.copies), []).append(row.rendered)
    return sorted(((*key, "".join(texts)) for key, texts in pages.items()), key=str)


@needs_tables
def test_whole_table(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(op10_chat_format(spark, FOLDER)) == brute(rows)


@pytest.mark.parametrize("seed", range(2))
def test_random_prefixes(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in range(60):
        for turn in range(rng.randrange(1, 5)):
            rows.append((key, turn, rng.choice(["user", "bot"]), rng.choice("ab"), None))
    assert rows_of(chat_pages(spark.createDataFrame(rows, SCHEMA).repartition(4))) == brute(rows)


def test_edges(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, None, None, "x"), (2, 0, "unknown", "", "y"), (2, 1, "user", "q", None), (3, 7, "user", "b", None),
            (3, 7, "user", "a", None), (None, None, "user", "z", None), (None, 1, "user", "y", None), (4, None, "user", "z", None)]
    rows += [(9, k, "user", f"t{k}", None) for k in range(700)] + [(10, k, "user", f"t{k}", None) for k in range(300)]
    result = chat_pages(spark.createDataFrame(rows, SCHEMA))
    assert rows_of(result) == brute([(a, b, c or "unknown", d or "", e) for a, b, c, d, e in rows])
    assert result.filter("conv_id = 9").count() == 3
    assert chat_pages(spark.createDataFrame([], SCHEMA)).count() == 0
