"""Published values, worked rows, and operators that SQL doesn't express."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.functions.porter import stem
from starloom.functions import scalar as S
from starloom.operators import anchor as A
from starloom.operators import inference as I
from starloom.operators import metrics as M
from starloom.operators import ordering as O
from starloom.operators import retrieval as R
from starloom.operators import rules as L
from starloom.operators import sampling
from starloom.operators import spectra as P
from starloom.operators import texts as T
from starloom.sources import readers, sinks
from starloom.sources.scratch import fresh

ORDER = list("OBAFGKM")
MATRIX = ["0 0 0 0 0 0 1", "0 55 33 0 0 0 0", "0 33 53 5 0 0 0", "0 0 0 85 10 0 0", "0 0 0 1 67 14 0", "0 0 0 0 3 76 0", "0 0 0 0 0 0 52"]


def test_published_agreement(spark):
    cells = [(ORDER[i], ORDER[j], int(n)) for i, row in enumerate(MATRIX) for j, n in enumerate(row.split())]
    r = M.agreement(spark.createDataFrame(cells, "truth_label string, predicted_label string, n long"), ORDER).first()
    assert r.n == 488 and [round(x, 4) for x in (r.accuracy, r.macro_f1, r.weighted_f1, r.kappa, r.mean_distance, r.near_miss)] == [0.7951, 0.6936, 0.7924, 0.7529, 0.2152, 0.9980]
    names = ["Halo", "Thick Disk", "Thin Disk"]
    cells = [(names[i], names[j], n) for i, row in enumerate([[1, 0, 0], [3, 4, 36], [7, 35, 90]]) for j, n in enumerate(row)]
    r = M.agreement(spark.createDataFrame(cells, "truth_label string, predicted_label string, n long")).first()
    assert round(r.accuracy, 4) == 0.5398 and round(r.kappa, 4) == -0.1264


#: id, parallax, error, pmra, pmdec, ruwe, G, E, teff, logg, mh, width, flag, rv error, transits, solution
STARS = [
    (0, 12.45, 0.02, -15.3, 4.2, 1.02, 10.2, 0.05, 5700.0, 4.44, 0.01, 2.5, 0, 1.2, 12.0, None),
    (1, -0.15, 0.5, 2.1, -1.1, 2.80, 18.5, None, 3200.0, 4.8, None, None, None, None, None, None),
    (2, 4.2, 0.05, 12.0, 8.5, 1.10, 12.1, 0.12, 6100.0, 4.2, -0.5, 1.2, 0, 8.5, 25.0, "Orbital"),
    (3, 2.1, 0.1, 80.0, -60.0, 1.05, 13.8, 0.02, 5200.0, 4.3, -1.85, 1.8, 0, 2.1, 18.0, None),
    (4, 3.5, 0.08, -5.0, 2.0, 1.15, 9.5, 0.08, 22000.0, 3.8, -0.1, -12.5, 0, 15.0, 8.0, None),
]
COLUMNS = "source_id long, parallax double, parallax_error double, pmra double, pmdec double, ruwe double, phot_g_mean_mag double, ebpminrp_gspphot double, teff_gspphot double, logg_gspphot double, mh_gspphot double, ew_espels_halpha double, ew_espels_halpha_flag int, radial_velocity_error double, rv_nb_transits double, nss_solution_type string"


def stars(spark, rows=STARS):
    df = spark.createDataFrame(rows, COLUMNS)
    more = {"bprp_status": F.lit("success"), "bprp_high_snr": F.lit(True), "rvs_status": F.lit("success"), "rvs_stable": F.lit(True), "rvs_high_snr": F.lit(True), "emission_core": F.lit(False), "fem_gspspec": F.lit(None).cast("double"), "alphafe_gspspec": F.lit(None).cast("double")}
    return df.withColumns(more)


def test_worked_rows(spark):
    r = {x.source_id: x for x in L.judged(stars(spark)).collect()}
    assert r[0].is_reliable_parallax and not (r[0].is_giant or r[0].has_emission or r[0].is_binary_candidate)
    assert r[1].astrometry_status == "partial" and not r[1].is_reliable_parallax and r[1].is_binary_candidate and r[1].quality_score == 0
    assert r[2].is_binary_candidate and r[2].binary_nss
    assert r[3].is_metal_poor and r[3].is_high_velocity and r[3].v_tan == 225.7143 and not r[3].is_binary_candidate
    assert r[4].has_emission and r[4].has_emission_source == "catalog" and not r[4].is_giant and r[4].is_binary_candidate
    assert r[0].quality_score == 1.0
    contract = L.contracts(L.judged(stars(spark))).where("source_id = 3").first()
    assert contract.physical_vector.v_tan == 225.7143 and contract.logical_flags.is_metal_poor and contract.astrometry_status == "success"


def test_zero_error_and_nothing(spark):
    odd = [(9, 1.0, 0.0, *STARS[0][3:]), (10, None, None, *[None] * 13)]
    r = {x.source_id: x for x in L.judged(stars(spark, odd)).collect()}
    assert r[9].astrometry_status == "failed" and r[9].extinction_ag is None
    assert r[10].astrometry_status == "success" and r[10].abs_mag is None and not r[10].is_binary_candidate


@pytest.mark.parametrize("b, r, reliable, score", [((True, True), ("success", False, False), True, 0.85), ((True, True), ("success", True, True), True, 1.0), ((False, False), ("failed", False, False), True, 0.21), ((True, True), ("success", True, True), False, 0.0)])
def test_quality_scores(spark, b, r, reliable, score):
    row = [("success" if b[0] else "failed", b[1], *r, reliable)]
    df = spark.createDataFrame(row, "bprp_status string, bprp_high_snr boolean, rvs_status string, rvs_stable boolean, rvs_high_snr boolean, is_reliable_parallax boolean")
    assert L.quality(df).first().quality_score == score


def test_hot_correction(spark):
    rows = [(10000, 3.936), (10004, 3.998), (10071, 4.044), (10075, 4.170), (10055, 4.116), (10008, 4.033), (10009, 3.999), (10075, 4.112), (10100, 4.2), (10050, 3.79), (9800, 4.2)]
    df = spark.createDataFrame(rows, "teff_k int, logg double").withColumn("mk_letter", A.letter(F.col("teff_k")))
    got = [(x.mk_letter, x.ab_boundary_logg_corrected) for x in A.hot_correction(df).collect()]
    assert got == [("A", True)] * 8 + [("B", False), ("B", False), ("A", False)]


def test_luminosity_parsers(spark):
    df = spark.createDataFrame([("K2III",), ("F7IV-V",), ("G2 III",), ("A0 V",), (None,)], "t string")
    got = df.select(S.luminosity_numeral(F.col("t")).alias("a"), S.luminosity_numeral(F.col("t"), legacy=False).alias("b")).collect()
    assert [tuple(r) for r in got] == [(None, "III"), ("V", "IV"), ("I", "III"), ("V", "V"), (None, None)]


def test_chunks_and_fallback(spark):
    words = "word " * 45
    docs = spark.createDataFrame([("a", f"short\n## One\n{words}\n## Two\nfew"), ("b", words), ("c", "few"), ("d", "")], "source string, text string")
    got = [(r.source, r.chunk_no, r.title) for r in R.chunks(docs).collect()]
    assert got == [("a", 0, "One"), ("b", 0, words.strip())]


def test_cosine_ties_and_zero(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id int, vector array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "base_id int, vector array<double>")
    assert [tuple(r) for r in R.cosine_top(q, b, 2, "query_id", "base_id").collect()] == [(1, 1, 2, 1.0), (1, 2, 1, 1.0)]
    # a base of any size is scored, block by block
    assert [tuple(r) for r in R.cosine_top(q, b, 2, "query_id", "base_id", size=1).collect()] == [(1, 1, 2, 1.0), (1, 2, 1, 1.0)]


def test_stems():
    pairs = "caresses caress ponies poni cats cat agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat rational ration digitizer digit operator oper feudalism feudal hopefulness hope formality formal triplicate triplic electrical electr goodness good revival reviv adjustment adjust adoption adopt effective effect probate probat rate rate controlling control roll roll".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_against_table(spark):
    pairs = [("a b c a d", "a c d e"), ("", "a"), ("x", "x"), ("the cat sat on the mat", "the mat on the cat"), (None, None), ("q w e r", "z")]
    got = T.rouge(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string"), "a", "b", stems=False).orderBy("i").collect()
    for r, (a, b) in zip(got, pairs):
        a, b = (a or "").split(), (b or "").split()
        n = lcs(a, b)
        assert math.isclose(r.rougel_r, n / len(a) if a else 0) and math.isclose(r.rougel_p, n / len(b) if b else 0)


def test_continuum_and_line():
    x = np.arange(336.0, 1021.0, 2.0)
    y = np.exp((x - 336) / 300)
    y[:5] *= 0.1
    y[-5:] *= 0.1
    assert P.measured(x, y)[0] == "success"
    assert P.measured(x, np.full(len(x), np.nan))[0] == "no_data"
    grid = np.linspace(852.0, 856.5, 200)
    flux = 1 - P.voigt(grid, 854.209, 0.5, 0.1, 0.2)
    centre, width, fwhm, status, good, broad, core = P.fit_line(grid, flux, 854.209)
    assert status == "success" and good and not broad and not core
    assert math.isclose(fwhm, 0.5346 * 0.1 + math.sqrt(0.2166 * 0.01 + 0.04), rel_tol=0.02)
    true = (1 - flux)[1:].sum() * np.diff(grid)[0] * 10
    assert math.isclose(width, true, rel_tol=0.1)


def test_doppler(spark):
    df = spark.createDataFrame([(-312.0,), (None,), (float("nan"),)], "v double")
    assert [r.c for r in df.select(P.shifted(F.lit(656.281), F.col("v")).alias("c")).collect()] == [656.281 * (1 - 312 / 299792.458), 656.281, 656.281]


def test_retries_and_validation(spark):
    rows = spark.createDataFrame([(k,) for k in range(6)], "source_id long")

    def generate(todo: pd.DataFrame) -> list[str]:
        if (todo["source_id"] == 0).any():
            return ["nothing" if k < 3 else json.dumps({"source_id": str(k)}) for k in todo["source_id"]]
        return ["x" * 600 for _ in todo["source_id"]]

    got = {r.source_id: r for r in I.generated(rows.coalesce(1), generate).collect()}
    assert got[5].attempts == 1 and got[5].error is None and got[0].attempts == 3 and got[0].raw is None
    bad = {r.source_id: r for r in I.validated(I.parsed(I.generated(rows.coalesce(1), generate))).collect()}
    assert not bad[5].is_valid and "no result" in bad[0].errors and "source_id differs" not in bad[5].errors

    def broken(todo):
        raise RuntimeError("down")

    assert all("down" in r.error for r in I.generated(rows, broken).collect())


def test_running_totals_and_ranks(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(2).alias("v"))
    got = O.running_total(df, ["k"], "v", "t").collect()
    assert all(r.t == 2 * (r.k + 1) for r in got)
    assert O.running_total(df.limit(0), ["k"], "v", "t").count() == 0


def test_stratified_minimum(spark):
    df = spark.range(1000).withColumn("s", F.when(F.col("id") < 3, "rare").otherwise("many"))
    got = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", 100).groupBy("s").count().collect()}
    assert got == {"rare": 1, "many": 99}


def test_bootstrap_brackets_mean(spark):
    df = spark.range(2000).withColumn("hit", (F.col("id") % 4 == 0).cast("double"))
    r = M.bootstrap(df, "id", "hit", rounds=300).first()
    assert r.low < 0.25 < r.high and r.high - r.low < 0.06


def test_p_values():
    assert math.isclose(M.p_value(0.5, 20), 0.0248, abs_tol=2e-4) and math.isclose(M.p_value(-0.1, 100), 0.3222, abs_tol=2e-4)


def test_array_files_and_folders(spark, tmp_path):
    np.savez(tmp_path / "123.npz", wavelength=np.arange(3.0), flux=np.ones(3), flux_error=np.zeros(3))
    np.savez(tmp_path / "77.npz", wavelength=np.arange(2.0), flux=np.array([np.nan, np.nan]))
    np.savez(tmp_path / "8.npz", other=np.ones(1))
    got = {r.source_id: r for r in readers.array_files(spark, str(tmp_path)).collect()}
    assert set(got) == {123, 77} and got[77].flux_error is None and got[123].wavelength == [0.0, 1.0, 2.0]
    assert [r.source_id for r in readers.spectra_present(readers.array_files(spark, str(tmp_path))).collect()] == [123]
    folder = fresh(spark, "runs")
    assert readers.latest(spark, folder) is None
    first = sinks.numbered_folder(spark, folder)
    spark.range(1).write.parquet(first)
    assert readers.latest(spark, folder) == first and "/DB-2-" in sinks.numbered_folder(spark, folder)
