"""Aggregates and reports."""

from pyspark.sql import functions as F

from starloom.operators import aggregates as G
from starloom.operators import blocks as B
from starloom.plans.blocks import _CATEGORY
from starloom.plans.registry import query
from starloom.plans.stars import anchored, corrected, judged
from starloom.sources.bindings import catalogue, read
from starloom.sources.sinks import manifest


@query(f"SELECT {_CATEGORY} AS category, count(*) AS n FROM cat GROUP BY 1")
def f2_distribution(spark, d):
    return G.distribution(catalogue(spark, d).withColumn("category", B.category()), "category")


@query("SELECT is_giant, is_metal_poor, is_binary_candidate, has_emission, count(*) AS n FROM hc GROUP BY ALL")
def f3_flag_groups(spark, d):
    return G.distribution(judged(spark, d), "is_giant", "is_metal_poor", "is_binary_candidate", "has_emission")


_FLAGS = ["is_reliable_parallax", "is_giant", "is_metal_poor", "is_binary_candidate", "is_high_velocity", "has_emission"]


@query(" UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS n_set, count(*) FILTER (WHERE {f}) * 100.0e0 / count(*) AS percent FROM hc" for f in _FLAGS))
def f4_flag_shares(spark, d):
    return G.flag_shares(judged(spark, d), _FLAGS)


@query("SELECT count(*) FILTER (WHERE quality_score >= 0.95e0) AS excellent, count(*) FILTER (WHERE quality_score >= 0.7e0 AND quality_score < 0.95e0) AS good, count(*) FILTER (WHERE quality_score >= 0.4e0 AND quality_score < 0.7e0) AS fair, count(*) FILTER (WHERE quality_score < 0.4e0) AS poor, avg(quality_score) AS mean_score, median(quality_score) AS median_score FROM hc")
def f5_quality_bands(spark, d):
    return G.quality_bands(judged(spark, d))


@query("SELECT i AS line_index, count(*) AS attempted, count(*) FILTER (WHERE i < cat_fitted) AS fitted, count(*) FILTER (WHERE i + 1 < cat_fitted) AS high_quality, count(*) FILTER (WHERE i < cat_fitted) / count(*) AS fitted_rate, count(*) FILTER (WHERE i + 1 < cat_fitted) / count(*) AS high_rate FROM cat, (VALUES (0), (1), (2)) AS v(i) GROUP BY i")
def f6_line_statistics(spark, d):
    line = lambda i: F.struct(F.when(F.col("cat_fitted") > i, "success").otherwise("failed").alias("status"), (F.col("cat_fitted") > i + 1).alias("high_quality_fit"))
    return G.line_statistics(catalogue(spark, d, "source_id", "cat_fitted").withColumn("cat_triplet", F.array(line(0), line(1), line(2))))


@query("SELECT count(DISTINCT l_orderkey) AS n_distinct, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_repeated FROM lineitem")
def f7_duplicates(spark, d):
    return G.duplicates(read(spark, d, "lineitem"), "l_orderkey")


_SPARSE = ["teff_gspphot", "logg_gspphot", "mh_gspphot", "fem_gspspec", "alphafe_gspspec", "ebpminrp_gspphot", "radial_velocity_error", "nss_solution_type", "ew_espels_halpha"]


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0e0 END) * 100e0 AS null_percent FROM cat" for c in _SPARSE) + ") WHERE null_percent > 0")
def f8_null_shares(spark, d):
    return G.null_shares(catalogue(spark, d, *_SPARSE))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(CASE WHEN {c} IS NULL THEN 0e0 ELSE 1e0 END) * 100e0 AS present_percent FROM cat" for c in _SPARSE))
def f19_completeness(spark, d):
    return G.completeness(catalogue(spark, d, *_SPARSE), *_SPARSE)


@query("SELECT count(*) AS n_rows, count(teff_gspphot) AS n_teff_gspphot, count(fem_gspspec) AS n_fem_gspspec FROM cat")
def f9_coverage(spark, d):
    return G.coverage(catalogue(spark, d), "teff_gspphot", "fem_gspspec")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS low, max({c}) AS high, median({c}) AS middle FROM cat" for c in ("teff_gspphot", "logg_gspphot", "mh_gspphot")))
def f10_summary(spark, d):
    return G.summary(catalogue(spark, d), "teff_gspphot", "logg_gspphot", "mh_gspphot")


@query(f"SELECT category, target, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) >= floor(target * 0.9e0) THEN 'OK' ELSE 'LOW' END AS state FROM (VALUES ('kg_enanas', 4500), ('af_sp', 3000), ('kg_gigantes', 2400), ('b_calientes', 1800), ('m_frias', 1800), ('halo', 1500)) AS t(category, target) LEFT JOIN (SELECT {_CATEGORY} AS category, count(*) AS n FROM cat GROUP BY 1) USING (category)")
def f11_against_targets(spark, d):
    return G.against_targets(catalogue(spark, d).withColumn("category", B.category()), "category", B.targets(15000))


@query("SELECT count(*) FILTER (WHERE has_rvs AND has_xp) AS both, count(*) FILTER (WHERE has_rvs AND NOT has_xp) AS only_rvs, count(*) FILTER (WHERE NOT has_rvs AND has_xp) AS only_xp FROM cat")
def f12_overlap(spark, d):
    r, x = F.col("has_rvs"), F.col("has_xp")
    return catalogue(spark, d, "has_rvs", "has_xp").agg(F.count_if(r & x).alias("both"), F.count_if(r & ~x).alias("only_rvs"), F.count_if(~r & x).alias("only_xp"))


@query("SELECT mk_letter, population_group, chemistry_source, grouping(mk_letter, population_group, chemistry_source) AS which, count(*) AS n, count(*) FILTER (WHERE near_teff_boundary) AS near_teff, count(*) FILTER (WHERE near_logg_boundary) AS near_logg, count(*) FILTER (WHERE near_chemistry_boundary) AS near_chemistry FROM an GROUP BY GROUPING SETS ((mk_letter), (population_group), (chemistry_source))")
def f13_anchor_summary(spark, d):
    return G.anchor_summary(anchored(spark, d))


@query("SELECT count(*) AS n_stars, count(s_suppkey) AS n_truth, count(*) FILTER (WHERE quality_score = 0) AS n_zero_quality FROM hc LEFT JOIN supplier ON source_id = s_suppkey")
def f14_build_report(spark, d):
    truth = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.lit(True).alias("has_truth"))
    return judged(spark, d).join(truth, "source_id", "left").agg(F.count("*").alias("n_stars"), F.count("has_truth").alias("n_truth"), F.count_if(F.col("quality_score") == 0).alias("n_zero_quality"))


@query("SELECT count(*) FILTER (WHERE changed) AS n_corrected, count(*) FILTER (WHERE population_before <> population_group) AS n_translated FROM co")
def f15_audit(spark, d):
    return corrected(spark, d).agg(F.count_if("ab_boundary_logg_corrected").alias("n_corrected"), F.count_if("was_translated").alias("n_translated"))


def _histogram(value: str, bins: int) -> str:
    return f"SELECT CAST(least(floor((v - lo) * {bins}e0 / (hi - lo)), {bins - 1}) AS INTEGER) AS bin, count(*) AS n FROM (SELECT {value} AS v FROM cat WHERE {value} IS NOT NULL), (SELECT min({value}) AS lo, max({value}) AS hi FROM cat) GROUP BY 1"


@query(_histogram("teff_gspphot", 40))
def f16_histogram(spark, d):
    return G.histogram(catalogue(spark, d, "teff_gspphot"), F.col("teff_gspphot"), 40)


@query(_histogram("least(ruwe, 1.7e0)", 50))
def f17_clipped_histogram(spark, d):
    return G.histogram(catalogue(spark, d, "ruwe"), F.least("ruwe", F.lit(1.7)), 50)


@query("SELECT is_giant, count(*) AS n, min(abs_mag) AS brightest, count(*) FILTER (WHERE teff_k < 5200) AS n_cool FROM hc WHERE is_reliable_parallax GROUP BY 1")
def f18_giants_and_dwarfs(spark, d):
    return judged(spark, d).where("is_reliable_parallax").groupBy("is_giant").agg(F.count("*").alias("n"), F.min("abs_mag").alias("brightest"), F.count_if(F.col("teff_k") < 5200).alias("n_cool"))


@query("SELECT count(*) FILTER (WHERE ew_espels_halpha < 0) AS n_emission, count(*) FILTER (WHERE ew_espels_halpha >= 0) AS n_absorption FROM cat WHERE ew_espels_halpha_flag = 0")
def f20_width_split(spark, d):
    w = F.col("ew_espels_halpha")
    return catalogue(spark, d, "ew_espels_halpha", "ew_espels_halpha_flag").where("ew_espels_halpha_flag = 0").agg(F.count_if(w < 0).alias("n_emission"), F.count_if(w >= 0).alias("n_absorption"))


@query(f"SELECT source_id FROM (SELECT source_id, CASE WHEN {_CATEGORY} = 'halo' THEN 1 WHEN {_CATEGORY} = 'b_calientes' THEN 2 ELSE 3 END AS tier FROM cat) ORDER BY tier, source_id LIMIT 1")
def g5_first_by_tier(spark, d):
    tier = F.when(B.category() == "halo", 1).when(B.category() == "b_calientes", 2).otherwise(3)
    return catalogue(spark, d).withColumn("tier", tier).orderBy("tier", "source_id").limit(1).select("source_id")


@query("SELECT count(*) AS n_rows FROM cat")
def b6_manifest(spark, d):
    rows = catalogue(spark, d).withColumn("category", B.category())
    return manifest(rows, "category", total=15000).select("n_rows")
