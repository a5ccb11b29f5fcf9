"""Block queries, sampling, ordering, categories."""

from pyspark.sql import functions as F

from starloom.operators import anchor as A
from starloom.operators import blocks as B
from starloom.operators import ordering as O
from starloom.operators import sampling as S
from starloom.plans.registry import query
from starloom.sources.bindings import catalogue, read

_FLOOR = "parallax_over_error > 5 AND flux_over_error > 50 AND teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND ruwe IS NOT NULL"
_BLOCKS = {
    "main_sequence": (f"{_FLOOR} AND logg_gspphot >= 4.0e0 AND ruwe < 1.4e0 AND ebpminrp_gspphot < 0.3e0 AND teff_gspphot BETWEEN 3000 AND 40000", "source_id", 1500),
    "giants": (f"{_FLOOR} AND logg_gspphot > 0 AND logg_gspphot < 4.0e0 AND ruwe < 1.4e0 AND teff_gspphot BETWEEN 3500 AND 8000", "source_id", 800),
    "emission_hot": ("teff_gspphot > 7500 AND ew_espels_halpha > 0.1e0 AND ew_espels_halpha_flag = 0", "ew_espels_halpha DESC, source_id", 250),
    "high_ruwe": (f"{_FLOOR} AND ruwe > 1.4e0 AND teff_gspphot BETWEEN 4000 AND 8000", "ruwe DESC, source_id", 250),
    "metal_poor": (f"{_FLOOR} AND mh_gspphot < -1 AND phot_g_mean_mag < 16 AND ruwe < 1.4e0", "source_id", 250),
    "active_cool": ("teff_gspphot < 4000 AND ew_espels_halpha < -0.05e0 AND ew_espels_halpha_flag = 0", "teff_gspphot, source_id", 250),
    "extinction": (f"{_FLOOR} AND ebpminrp_gspphot > 0.5e0 AND abs(b) > 5 AND ruwe < 1.4e0 AND teff_gspphot BETWEEN 4000 AND 15000", "ebpminrp_gspphot DESC, source_id", 500),
}


def _blocks(sign: int = -1) -> list:
    """The blocks with widths in the range that the bound catalogue has."""
    return B.blocks(sign, hot_width=0.1, cool_width=0.05)


def _block(name: str, where: str, order: str, most: int):
    def run(spark, d):
        block = next(b for b in _blocks() if b.name == name)
        return B.top(catalogue(spark, d), block.where, block.order, block.most).select("source_id", "teff_gspphot", "ruwe")

    run.__name__ = f"d_block_{name}"
    query(f"SELECT source_id, teff_gspphot, ruwe FROM cat WHERE {where} ORDER BY {order} LIMIT {most}")(run)


for _name, (_where, _order, _most) in _BLOCKS.items():
    _block(_name, _where, _order, _most)


@query("SELECT source_id FROM cat WHERE " + _FLOOR)
def d1_quality_floor(spark, d):
    return catalogue(spark, d).where(B.floor()).select("source_id")


@query("SELECT source_id, bloque FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY block_no) AS n FROM (" + " UNION ALL ".join(f"(SELECT source_id, '{name}' AS bloque, {k} AS block_no FROM cat WHERE {w} ORDER BY {o} LIMIT {m})" for k, (name, (w, o, m)) in enumerate(_BLOCKS.items())) + ")) WHERE n = 1")
def i1_i2_combined_blocks(spark, d):
    return B.combined(catalogue(spark, d), _blocks()).select("source_id", "bloque")


@query("SELECT source_id FROM cat WHERE teff_gspphot < 4000 AND ew_espels_halpha > 0.05e0 AND ew_espels_halpha_flag = 0 ORDER BY teff_gspphot, source_id LIMIT 250")
def d7_active_cool_positive(spark, d):
    block = next(b for b in _blocks(1) if b.name == "active_cool")
    return B.top(catalogue(spark, d), block.where, block.order, block.most).select("source_id")


_RANGES = [("O", 30000.0, 60000.0, 60), ("B", 10000.0, 30000.0, 200), ("A", 7500.0, 10000.0, 300), ("F", 6000.0, 7500.0, 340), ("G", 5200.0, 6000.0, 300), ("K", 3700.0, 5200.0, 300)]
_RANGE_VALUES = ", ".join(f"('{n}', {int(a)}, {int(b)}, {k})" for n, a, b, k in _RANGES)


@query(f"SELECT source_id, bloque FROM (SELECT source_id, v.name AS bloque, v.most, row_number() OVER (PARTITION BY v.name ORDER BY source_id) AS n FROM cat JOIN (VALUES {_RANGE_VALUES}) AS v(name, lo, hi, most) ON teff_gspphot >= v.lo AND teff_gspphot < v.hi WHERE {_FLOOR} AND logg_gspphot >= 4.0e0) WHERE n <= most")
def d10_fine_blocks_by_teff(spark, d):
    return B.ranged(catalogue(spark, d), F.col("teff_gspphot"), _RANGES, B.floor() & (F.col("logg_gspphot") >= 4.0)).select("source_id", "bloque")


@query(f"SELECT source_id, bloque FROM (SELECT source_id, CASE WHEN logg_gspphot < 3.5e0 THEN 'giants' ELSE 'subgiants' END AS bloque, row_number() OVER (PARTITION BY logg_gspphot < 3.5e0 ORDER BY source_id) AS n FROM cat WHERE {_FLOOR} AND logg_gspphot >= 0 AND logg_gspphot < 4.0e0) WHERE n <= CASE bloque WHEN 'giants' THEN 550 ELSE 250 END")
def d11_fine_blocks_by_luminosity(spark, d):
    return B.ranged(catalogue(spark, d), F.col("logg_gspphot"), [("giants", 0.0, 3.5, 550), ("subgiants", 3.5, 4.0, 250)], B.floor()).select("source_id", "bloque")


@query("SELECT source_id FROM cat WHERE source_id IN (SELECT l_partkey FROM lineitem) AND teff_gspphot IS NOT NULL")
def d9_ground_truth_block(spark, d):
    ids = read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"))
    return B.among(catalogue(spark, d, "source_id", "teff_gspphot"), ids).where("teff_gspphot is not null").select("source_id")


@query("SELECT source_id FROM cat WHERE source_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_partkey IS NOT NULL)")
def d15_exclusion(spark, d):
    return B.excluding(catalogue(spark, d, "source_id"), read(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id")))


_CATEGORY = """CASE WHEN mh_gspphot < -1.0e0 THEN 'halo' WHEN teff_gspphot < 4000 THEN 'm_frias' WHEN teff_gspphot >= 4000 AND teff_gspphot < 6500 AND logg_gspphot < 3.5e0 THEN 'kg_gigantes'
WHEN teff_gspphot >= 4000 AND teff_gspphot < 6500 AND logg_gspphot >= 3.5e0 THEN 'kg_enanas' WHEN teff_gspphot >= 6500 AND teff_gspphot < 10000 AND logg_gspphot >= 3.5e0 THEN 'af_sp' WHEN teff_gspphot >= 10000 THEN 'b_calientes' ELSE 'otro' END"""


@query(f"SELECT source_id, {_CATEGORY} AS category FROM cat")
def j6_category(spark, d):
    return catalogue(spark, d).select("source_id", B.category().alias("category"))


_BASE = "has_rvs AND has_xp AND parallax IS NOT NULL AND teff_gspphot IS NOT NULL AND logg_gspphot IS NOT NULL AND mh_gspphot IS NOT NULL AND phot_g_mean_mag IS NOT NULL"
_FILTER = {
    "kg_enanas": "teff_gspphot BETWEEN 4000 AND 6500 AND logg_gspphot >= 3.5e0 AND mh_gspphot >= -1.0e0", "af_sp": "teff_gspphot BETWEEN 6500 AND 10000 AND logg_gspphot >= 3.5e0",
    "kg_gigantes": "teff_gspphot BETWEEN 4000 AND 6500 AND logg_gspphot < 3.5e0 AND mh_gspphot >= -1.0e0", "b_calientes": "teff_gspphot > 10000", "m_frias": "teff_gspphot < 4000", "halo": "mh_gspphot < -1.0e0",
}
_TARGETS = {"kg_enanas": 151, "af_sp": 100, "kg_gigantes": 80, "b_calientes": 60, "m_frias": 60, "halo": 50}


def _taken() -> str:
    """Each category takes its brightest of those that none before it has taken."""
    parts, before = [], []
    for name, n in _TARGETS.items():
        rest = "".join(f" AND source_id NOT IN (SELECT source_id FROM {x})" for x in before)
        parts.append(f"{name} AS (SELECT source_id, '{name}' AS chosen FROM cat WHERE {_BASE} AND {_FILTER[name]}{rest} ORDER BY phot_g_mean_mag, source_id LIMIT {n})")
        before.append(name)
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM {x}" for x in before)


@query(_taken())
def g2_balanced_catalogue(spark, d):
    return B.balanced(catalogue(spark, d), 501).select("source_id", "chosen")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n})" for k, n in _TARGETS.items()) + ") AS t(category, target)")
def j4_apportion(spark, d):
    return spark.createDataFrame(list(B.targets(501).items()), "category string, target int")


@query("SELECT source_id FROM cat WHERE has_xp AND has_rvs ORDER BY source_id LIMIT 300")
def d17_availability(spark, d):
    return B.available(catalogue(spark, d, "source_id", "has_xp", "has_rvs"), bprp=True, rvs=True, most=300).select("source_id")


@query("SELECT count(*) AS n_all, count(*) FILTER (WHERE flux_over_error > 50) AS n_flux, count(*) FILTER (WHERE flux_over_error > 50 AND fem_gspspec IS NOT NULL) AS n_chemistry FROM cat")
def d14_filter_chain(spark, d):
    one, two = F.col("flux_over_error") > 50, F.col("fem_gspspec").isNotNull()
    return catalogue(spark, d).agg(F.count("*").alias("n_all"), F.count_if(one).alias("n_flux"), F.count_if(one & two).alias("n_chemistry"))


@query("SELECT source_id, CASE WHEN teff_gspphot BETWEEN 2000 AND 100000 THEN teff_gspphot END AS teff, CASE WHEN logg_gspphot BETWEEN -2 AND 4.5e0 THEN logg_gspphot END AS logg FROM cat")
def d16_outliers(spark, d):
    t, g = F.col("teff_gspphot"), F.col("logg_gspphot")
    return catalogue(spark, d).select("source_id", F.when(t.between(2000, 100000), t).alias("teff"), F.when(g.between(-2, 4.5), g).alias("logg"))


@query("SELECT source_id, CASE WHEN teff_gspphot <= 0 OR teff_gspphot > 100000 THEN NULL WHEN teff_gspphot <= 3700 THEN 'M' WHEN teff_gspphot <= 5200 THEN 'K' WHEN teff_gspphot <= 6000 THEN 'G' WHEN teff_gspphot <= 7500 THEN 'F' WHEN teff_gspphot <= 10000 THEN 'A' WHEN teff_gspphot IS NOT NULL THEN 'OB' END AS bin FROM cat")
def j1_right_closed_bins(spark, d):
    return catalogue(spark, d, "source_id", "teff_gspphot").select("source_id", A.bin_right_closed(F.col("teff_gspphot")).alias("bin"))


_STRATA = "WITH s AS (SELECT source_id, CASE WHEN teff_gspphot <= 3700 THEN 'M' WHEN teff_gspphot <= 5200 THEN 'K' WHEN teff_gspphot <= 6000 THEN 'G' WHEN teff_gspphot <= 7500 THEN 'F' WHEN teff_gspphot <= 10000 THEN 'A' ELSE 'OB' END AS bin FROM cat WHERE teff_gspphot IS NOT NULL), q AS (SELECT bin, least(count(*), greatest(1, floor(count(*) * 1500 / (SELECT count(*) FROM s)))) AS quota FROM s GROUP BY bin), r AS (SELECT source_id, bin, row_number() OVER (PARTITION BY bin ORDER BY (source_id * 2654435761) % 4294967296, source_id) AS n FROM s), t AS (SELECT source_id, bin FROM r JOIN q USING (bin) WHERE n <= quota)"


def _strata(spark, d):
    return catalogue(spark, d, "source_id", "teff_gspphot").select("source_id", A.bin_right_closed(F.col("teff_gspphot")).alias("bin")).where("bin is not null")


@query(_STRATA + " SELECT source_id, bin FROM t")
def j2_stratified_sample(spark, d):
    return S.stratified(_strata(spark, d), "bin", "source_id", 1500).select("source_id", "bin")


@query(_STRATA + ", u AS (SELECT source_id, bin FROM s WHERE source_id NOT IN (SELECT source_id FROM t) ORDER BY (source_id * 2654435761) % 4294967296, source_id LIMIT (SELECT greatest(0, 1600 - count(*)) FROM t)) SELECT * FROM t UNION ALL SELECT * FROM u")
def j3_top_up(spark, d):
    rows = _strata(spark, d)
    return S.topped_up(S.stratified(rows, "bin", "source_id", 1500).select("source_id", "bin"), rows, "source_id", 1600)


@query("SELECT source_id, phot_g_mean_mag FROM cat ORDER BY phot_g_mean_mag, source_id LIMIT 500")
def d13_h1_brightest(spark, d):
    return catalogue(spark, d, "source_id", "phot_g_mean_mag").orderBy("phot_g_mean_mag", "source_id").limit(500)


@query("SELECT source_id FROM cat ORDER BY source_id LIMIT 100 OFFSET 250")
def h3_page(spark, d):
    return O.page(catalogue(spark, d, "source_id"), ["source_id"], 250, 100)


@query("SELECT source_id, (row_number() OVER (ORDER BY source_id) - 1) // 50 AS batch FROM cat")
def h5_batches(spark, d):
    return O.batched(catalogue(spark, d, "source_id"), ["source_id"], 50)


@query("SELECT source_id, rank() OVER (ORDER BY phot_g_mean_mag) + (count(*) OVER (PARTITION BY phot_g_mean_mag) - 1) / 2.0e0 AS r FROM cat")
def g4_average_ranks(spark, d):
    return O.average_ranks(catalogue(spark, d, "source_id", "phot_g_mean_mag"), "phot_g_mean_mag", "r").select("source_id", "r")
