"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from voxrank.plans.check_sql import CHECKS
from voxrank.plans.registry import QUERIES

TABLES = Path("/root/testdata/sf0.001")
WITHOUT_SQL = {"kmeans_word_topics", "kmeans_embedding_topics", "density_embedding_topics"}

pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="generated tables not present")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def plain(row):
    return tuple(None if isinstance(v, float) and math.isnan(v) else v for v in row)


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(CHECKS) == WITHOUT_SQL
    assert set(QUERIES) <= set(contract.queries()) and set(CHECKS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, str(TABLES))
    columns = sorted(frame.columns)
    answer = database.execute(contract.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    expected = sorted(repr(plain([row[names.index(c)] for c in columns])) for row in answer.fetchall())
    assert sorted(repr(plain([row[c] for c in columns])) for row in frame.collect()) == expected


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql(spark, name):
    rows = contract.queries()[name](spark, str(TABLES)).collect()
    assert rows
    if name == "density_embedding_topics":
        assert {r.method for r in rows} == {"Embeddings + density topics"} and len(rows) > 2 and -1 in {r.topic_id for r in rows}


def test_entry(spark):
    assert [r.impact_rank for r in contract.entry(spark).orderBy("impact_rank").collect()] == list(range(1, 21))
