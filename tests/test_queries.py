"""Every query against its SQL twin on DuckDB, over the given tables."""

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from arcwise.plans.catalog import QUERIES
from arcwise.plans.oracles import ORACLES
from tools.compare import KINDS, open_duckdb, rows_of

FOLDER = os.environ.get("ARCWISE_TEST_TABLES", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(FOLDER)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(queries()) >= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    result = queries()[name](spark, FOLDER)
    mine = result.collect()
    cursor = duck.execute(oracle_sql()[name])
    theirs = {column[0]: str(column[1]) for column in cursor.description}
    rows = cursor.fetchall()
    assert {n: KINDS.get(k, k.upper()) for n, k in result.dtypes} == theirs
    assert rows_of(result.columns, mine) == rows_of(list(theirs), rows)


def test_entry_gives_rows(spark):
    assert entry(spark).count() > 0
