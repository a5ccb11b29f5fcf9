"""Every registered catalogue query against its SQL in DuckDB."""

import math

import duckdb
import pytest

from starloom.plans import catalogue_queries, catalogue_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue_queries(), catalogue_sql()
WITHOUT_SQL = {"o4_rouge_stemmed", "n6_vector_cache", "l4_l7_spectra"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows(found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_all_but_some_have_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(SQL[name]).columns)
    expected = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({SQL[name]})").fetchall()
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(expected)
