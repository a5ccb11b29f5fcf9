import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from starloom.operators import metrics as M
from starloom.operators import retrieval as R
from starloom.sources import claims as C
from starloom.sources import readers
from starloom.sources import vectors as V


def test_writers_at_once_get_numbers_of_their_own(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    with ThreadPoolExecutor(8) as pool:
        found = list(pool.map(lambda _: C.claimed_folder(spark, root), range(24)))
    numbers = sorted(int(f.rsplit("/DB-")[1].split("-")[0]) for f in found)
    assert numbers == list(range(1, 25)) and all(C.there(spark, f) for f in found)
    assert "/DB-24-" in readers.latest(spark, root)


def test_pointers_change_at_once(spark, tmp_path):
    path = f"file://{tmp_path}/p/now"
    assert C.pointed(spark, path) is None
    for text in ("one", "two, longer", "ü"):
        C.point(spark, path, text)
        assert C.pointed(spark, path) == text
    assert [n for n in readers.listed(spark, f"file://{tmp_path}/p") if not n.startswith(".")] == ["now"]


def test_vectors_are_made_anew_only_where_they_must(spark, tmp_path):
    folder = f"file://{tmp_path}/vectors"
    texts = spark.createDataFrame([(k, f"word{k} star" if k % 4 else "") for k in range(1, 21)] + [(99, None)], "source_id long, query string")
    calls = spark.sparkContext.accumulator(0)

    def encoder(size):
        encode = R.counting_encoder(size)

        def run(own):
            calls.add(len(own))
            return encode(own)

        return run

    def had(rows, size=16, name="md5"):
        before = calls.value
        found, why = V.versioned_vectors(rows, folder, name, size, encoder(size))
        held = {r.source_id: r.vector for r in found.collect()}
        expected = R.counting_encoder(size)([r.query or "" for r in rows.orderBy("source_id").collect()])
        assert [held[k] for k in sorted(held)] == [e.tolist() for e in expected]
        return why, calls.value - before

    assert had(texts) == ("missing", 21)
    assert had(texts.repartition(5)) == ("cached", 0)
    changed = texts.selectExpr("source_id", "if(source_id = 5, 'other words', query) AS query").where("source_id <> 6")
    assert had(changed) == ("stale", 1)
    assert had(changed, 8) == ("dimension", 20)
    assert had(changed, 8, "other") == ("encoder", 20)
    held = json.loads(C.pointed(spark, f"{folder}/{V.MANIFEST}"))
    assert (held["rows"], held["dimensions"], held["encoder"]) == (20, 8, "other")
    assert sum(n.startswith("v-") for n in readers.listed(spark, folder)) == 2  # the one in force and the one before
    C.removed(spark, f"{folder}/{held['version']}")
    assert had(changed, 8, "other") == ("missing", 20)


def test_draws_are_poisson_and_pairs_share_them(spark):
    w = M.draws(np.arange(20_000), np.arange(50), 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    rows = [(k, float(k % 2), float(k % 2) if k % 10 else 1.0) for k in range(2000)]
    r = M.paired_bootstrap(spark.createDataFrame(rows, "id long, a double, b double"), "id", "a", "b", rounds=400).first()
    assert (r.n, r.a_mean, r.b_mean, round(r.delta_mean, 9)) == (2000, 0.5, 0.6, -0.1)
    assert r.a_low < 0.5 < r.a_high and r.delta_low < -0.1 < r.delta_high and r.not_ahead == 1.0
    assert r.delta_high - r.delta_low < 0.8 * (r.a_high - r.a_low)  # what both share falls out
    same = M.paired_bootstrap(spark.createDataFrame([(str(k), 1.0, None if k % 2 else 1.0) for k in range(50)], "id string, a double, b double"), "id", "a", "b", rounds=20).first()
    assert (same.n, same.delta_low, same.delta_high) == (25, 0.0, 0.0)
