import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import pivot_search


def brute(rows, k=20, every=20):
    own = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(own):
        if i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(own) if other != at)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def search(df, **more):
    return sorted(tuple(r) for r in pivot_search.top_inner_products(df, F.col("vec_id") % 20 == 0, **more).collect())


def test_against_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}'")
    expected = sorted(duckdb.sql(pivot_search.SQL).fetchall())
    assert search(spark.read.parquet(path)) == expected


def test_edges(spark):
    draw = np.random.default_rng(5)
    rows = [(int(i), draw.normal(size=6).tolist()) for i in range(150)]
    rows += [(i + 200, [0.5, 0.25, 0.0, 0.0, 0.0, -1.0]) for i in range(90)]
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (None, [1.0] * 6), (420, []), (440, [2.0, -3.0]), (460, [float("inf")] * 6), (0, [0.1] * 6), (20, [0.0] * 6), rows[20], rows[20], rows[3]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    assert search(df) == brute(rows)
    assert search(df.limit(0)) == []
    assert search(spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")) == []
    few = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (21, [0.0, 1e9])]
    assert search(spark.createDataFrame(few, "vec_id long, embedding array<double>")) == brute(few)


@pytest.mark.parametrize("first", [1, 4096])
def test_small_blocks(spark, monkeypatch, first):
    for name, value in (("BLOCK", 7), ("QUERIES", 3), ("FIRST", first), ("REMEMBERED", 2), ("SAMPLE", 8), ("PIVOTS", 5), ("GROWTH", 3), ("PART", 1)):
        monkeypatch.setattr(pivot_search, name, value)
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(8, 5)) * 3
    rows = [(int(i), (centres[i % 8] + draw.normal(size=5) * 0.1).tolist()) for i in range(400)]
    assert search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4) == brute(rows, 4)


def test_many_equal_vectors(spark, monkeypatch):
    from starloom.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)
    draw = np.random.default_rng(7)
    rows = [(i, [1.0, 0.5, -2.0]) for i in range(300)] + [(i, draw.normal(size=3).tolist()) for i in range(300, 500)]
    rows += rows[:40]
    assert search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=5) == brute(rows, 5)
