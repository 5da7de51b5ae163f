"""Every registered query with a SQL twin agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def text(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, FOLDER)
    rel = duck.sql(contract.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: SQL_TYPES.get(t, t) for c, t in df.dtypes} == types
    actual = sorted(tuple(map(text, row)) for row in df.select(*[f"`{c}`" for c in cols]).collect())
    wanted = rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    assert actual == sorted(tuple(map(text, row)) for row in wanted)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_rows_only(spark, name):
    assert contract.queries()[name](spark, FOLDER).count() > 0


def test_entry_is_the_curated_entity_table(spark):
    rows = contract.entry(spark).groupBy("source_type").count().collect()
    assert {r["source_type"]: r["count"] for r in rows} == {"mixed": 61, "A_only": 76, "B_only": 78, "Unknown": 28}
