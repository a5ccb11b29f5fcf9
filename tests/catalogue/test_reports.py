import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import blocks as B
from starloom.operators import metrics as M
from starloom.operators import reports as P
from starloom.operators import retrieval as R
from starloom.operators import texts as T
from starloom.sources import arrays, readers, resilient, sinks
from starloom.sources.scratch import fresh


def test_attempts_wait_twice_as_long_each_time(spark):
    waits, calls = [], []

    def scan():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("away")
        return spark.range(3)

    assert resilient.attempted(scan, sleep=waits.append).count() == 3 and waits == [15, 30, 60]
    del calls[:], waits[:]
    assert resilient.attempted(scan, tries=3, wait=1, sleep=waits.append) is None and waits == [1, 2]
    assert resilient.scanned(lambda: spark.read.parquet("/nowhere"), "a part") is None
    assert resilient.first_that_works(lambda: 1 / 0, lambda: 1 / 0, sleep=waits.append) is None


def test_categories_take_in_turn(spark):
    # one star fits kg_enanas and, being at its edge, af_sp: what the first has no room for is offered to the next
    rows = [(i, 10.0 + i, 6500.0, 4.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "source_id long, phot_g_mean_mag double, teff_gspphot double, logg_gspphot double, mh_gspphot double")
    df = df.withColumns({"parallax": F.lit(1.0), "has_rvs": F.lit(True), "has_xp": F.lit(True)})
    got = {r.source_id: r.chosen for r in B.balanced(df, 10).collect()}
    goal = B.targets(10)
    assert goal["kg_enanas"] == 4 and goal["af_sp"] == 2
    assert got == {0: "kg_enanas", 1: "kg_enanas", 2: "kg_enanas", 3: "kg_enanas", 4: "af_sp", 5: "af_sp"}


def test_physical_errors(spark):
    rows = [("G", 5900, "V", 5950.0, 4.0, 2), ("K", 4500, "III", 4400.0, None, 0), ("M", 3000, "I", None, 1.0, 5), ("B", 500, "IV", 11000.0, 3.5, 1)]
    df = spark.createDataFrame(rows, "letter string, teff_k int, luminosity_class string, true_teff double, true_logg double, n_measurements int")
    r = M.physical_errors(df).first()
    # middles 5900 and 4500; weights 2 and 1; gravity 0.3 x 2 and 0.2 x 1 over the same weights
    assert tuple(r) == (2, round((50 * 2 + 100) / 3, 1), 2, round((0.3 * 2 + 0.2) / 3, 4))
    assert tuple(M.physical_errors(df.limit(0)).first()) == (0, None, 0, None)


def test_bootstrap_is_the_same_for_any_split(spark):
    df = spark.range(5000).select("id", (F.col("id") % 4 == 0).cast("double").alias("hit"))
    one, many = M.bootstrap(df.coalesce(1), "id", "hit").first(), M.bootstrap(df.repartition(7), "id", "hit").first()
    assert one.low == pytest.approx(many.low) and one.high == pytest.approx(many.high)
    assert one.low < 0.25 < one.high and 0.015 < one.high - one.low < 0.035  # 2 x 1.96 x sqrt(.25 x .75 / 5000) = 0.024


def test_longest_common_subsequence(spark):
    draw = random.Random(4)
    pairs = [([draw.choice("abcd") for _ in range(draw.randint(0, 12))], [draw.choice("abcd") for _ in range(draw.randint(0, 12))]) for _ in range(200)] + [(["x"] * 3000, ["x"] * 2500), (None, ["a"])]

    def brute(a, b):
        last = [0] * (len(b) + 1)
        for w in a:
            now = [0]
            for j, x in enumerate(b):
                now.append(last[j] + 1 if w == x else max(last[j + 1], now[j]))
            last = now
        return last[-1]

    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r.i: r.n for r in df.select("i", T.common_subsequence("a", "b").alias("n")).collect()}
    assert [got[i] for i in range(200)] == [brute(a, b) for a, b in pairs[:200]] and got[200] == 2500 and got[201] == 0


@pytest.mark.parametrize("size", [3, 1000])
def test_cosine_blocks(spark, size):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.normal(size=4).round(2).tolist()) for i in range(40)] + [(50, [0.0] * 4), (51, None)]
    df = spark.createDataFrame(vectors, "b long, vector array<double>").repartition(3)
    got = [(r.q, r["rank"], r.b) for r in R.cosine_top(df.withColumnRenamed("b", "q"), df, 3, "q", "b", size=size).collect()]
    rows = vectors[:40]
    want = [(q, k + 1, b) for q, x in rows for k, (_, b) in enumerate(sorted(((-np.dot(x, y), b) for b, y in rows), key=lambda t: (round(t[0], 9), -t[1]))[:3])]
    assert sorted(got) == sorted(want)
    assert R.cosine_top(df.withColumnRenamed("b", "q"), df.limit(0), 3, "q", "b").count() == 0


def test_files(spark):
    path = fresh(spark, "arrays")
    rows = spark.createDataFrame([(1, float("nan")), (2, 2.5), (3, None)], "a int, b double")
    sinks.json_arrays(rows.coalesce(2), path)
    assert sorted(map(tuple, readers.json_array(spark, path, "a int, b double").collect()), key=str) == [(1, None), (2, 2.5), (3, None)]
    sinks.json_arrays(rows.limit(0), path + "-none")
    assert readers.json_array(spark, path + "-none", "a int, b double").count() == 0
    flux = spark.createDataFrame([(k, [float(k), None, 1.0] if k % 4 else None) for k in range(30)], "source_id long, flux array<float>")
    arrays.write_matrix(flux, path + "-matrix", rows=7)
    got = {r.source_id: r.flux for r in arrays.gathered(spark, path + "-matrix", spark.createDataFrame([(k,) for k in (1, 4, 9, 9, 99)], "source_id long")).collect()}
    assert got == {1: [1.0, None, 1.0], 9: [9.0, None, 1.0]}
    assert readers.without(spark.createDataFrame([(1, 2, 3)], "`a.b` int, c_x int, pastel int"), "_x", "pastel").columns == ["a.b"]


def test_lines(spark):
    report = P.assembled({"one": spark.createDataFrame([(1, None)], "n int, kappa double")})
    assert [r.line.split() for r in P.lines(report).orderBy("measure").collect()] == [["one", "kappa", "N/A"], ["one", "n", "1.0000"]]
