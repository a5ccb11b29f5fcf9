"""Rules, contracts, anchors and classification over the catalogue."""

from pyspark.sql import functions as F

from starloom.functions import scalar as S
from starloom.operators import anchor as A
from starloom.operators import rules as R
from starloom.plans.registry import query
from starloom.sources.bindings import catalogue


def judged(spark, d):
    return R.judged(catalogue(spark, d))


def anchored(spark, d):
    return A.anchored(judged(spark, d))


def corrected(spark, d):
    return A.corrected(anchored(spark, d))


@query("SELECT mk_letter, population_group, count(*) AS n FROM an GROUP BY ALL")
def flagship_letters_by_population(spark, d):
    return anchored(spark, d).groupBy("mk_letter", "population_group").agg(F.count("*").alias("n"))


@query("SELECT source_id, astrometry_status, teff_k, ruwe_flag, is_reliable_parallax, extinction_ag, abs_mag, v_tan, is_giant, is_high_velocity FROM hc")
def l1_astrometry(spark, d):
    return R.astrometry(catalogue(spark, d)).select("source_id", "astrometry_status", "teff_k", "ruwe_flag", "is_reliable_parallax", "extinction_ag", "abs_mag", "v_tan", "is_giant", "is_high_velocity")


@query("SELECT source_id, adaptive_rv_threshold, nss_solution, n_transits, binary_ruwe, binary_rv, binary_nss, is_binary_candidate FROM hc")
def l2_binarity(spark, d):
    return R.binarity(catalogue(spark, d)).select("source_id", "adaptive_rv_threshold", "nss_solution", "n_transits", "binary_ruwe", "binary_rv", "binary_nss", "is_binary_candidate")


@query("SELECT source_id, has_emission, has_emission_source FROM hc")
def l3_emission(spark, d):
    return R.emission(catalogue(spark, d)).select("source_id", "has_emission", "has_emission_source")


@query("SELECT source_id, quality_score, is_metal_poor FROM hc")
def l9_quality_score(spark, d):
    return judged(spark, d).select("source_id", "quality_score", "is_metal_poor")


@query("""SELECT source_id, astrometry_status, abs_mag, teff_k, mh_gspphot AS metallicity, fem_gspspec AS fe_h, alphafe_gspspec AS alpha_fe, logg_gspphot AS logg, v_tan, extinction_ag,
is_reliable_parallax, is_giant, is_metal_poor, is_binary_candidate, is_high_velocity, has_emission, has_emission_source, ruwe, round(ew_espels_halpha * 10.0e0, 3) AS halpha_ew_aa, bprp_status, rvs_status, quality_score FROM hc""")
def l8_contract_flattened(spark, d):
    return R.flattened(R.contracts(judged(spark, d)))


@query("SELECT source_id, CASE WHEN is_binary_candidate THEN 'candidate' ELSE 'single' END AS binary_status, ruwe, radial_velocity_error AS rv_error_km_s, n_transits AS rv_nb_transits, nss_solution, adaptive_rv_threshold FROM hc")
def c10_contract_package(spark, d):
    return R.contracts(judged(spark, d)).select("source_id", "binary_status", "binary_diagnostics.*")


@query("""SELECT source_id, CASE WHEN teff_k >= 30000 THEN 'O' WHEN teff_k >= 10000 THEN 'B' WHEN teff_k >= 7500 THEN 'A' WHEN teff_k >= 6000 THEN 'F' WHEN teff_k >= 5200 THEN 'G' WHEN teff_k >= 3700 THEN 'K' WHEN teff_k IS NOT NULL THEN 'M' END AS mk_letter,
CASE WHEN teff_k >= 30000 THEN 'O' WHEN teff_k >= 9800 THEN 'B' WHEN teff_k >= 7500 THEN 'A' WHEN teff_k >= 6000 THEN 'F' WHEN teff_k >= 5200 THEN 'G' WHEN teff_k >= 3700 THEN 'K' WHEN teff_k IS NOT NULL THEN 'M' END AS guarded_letter FROM hc""")
def m1_letter(spark, d):
    stars = R.astrometry(catalogue(spark, d))
    return stars.select("source_id", A.letter(F.col("teff_k")).alias("mk_letter"), A.letter(F.col("teff_k"), 9800.0).alias("guarded_letter"))


@query("SELECT source_id, population_group, chemistry_source, chemistry_value, decision_rule FROM an")
def m2_population(spark, d):
    return anchored(spark, d).select("source_id", "population_group", "chemistry_source", "chemistry_value", "decision_rule")


@query("SELECT source_id, near_teff_boundary, near_logg_boundary, near_chemistry_boundary FROM an")
def m3_boundaries(spark, d):
    return anchored(spark, d).select("source_id", "near_teff_boundary", "near_logg_boundary", "near_chemistry_boundary")


@query("SELECT source_id, mk_letter, population_group, teff_k, metallicity, fe_h, alpha_fe, logg, abs_mag, v_tan, quality_score FROM an")
def m4_anchor(spark, d):
    return anchored(spark, d).select("source_id", "mk_letter", "population_group", "teff_k", "metallicity", "fe_h", "alpha_fe", "logg", "abs_mag", "v_tan", "quality_score")


@query("SELECT source_id, mk_before, mk_letter, changed AS ab_boundary_logg_corrected FROM co")
def m5_hot_correction(spark, d):
    return A.hot_correction(anchored(spark, d)).select("source_id", "mk_before", "mk_letter", "ab_boundary_logg_corrected")


@query("SELECT source_id, population_before, population_group FROM co")
def m6_translation(spark, d):
    return A.translated(anchored(spark, d)).select("source_id", "population_before", "population_group")


@query("SELECT source_id, mk_letter, population_group, '7' AS anchor_version, changed AS ab_boundary_logg_corrected, population_before <> population_group AS was_translated FROM co")
def m7_corrected_corpus(spark, d):
    return corrected(spark, d).select("source_id", "mk_letter", "population_group", "anchor_version", "ab_boundary_logg_corrected", "was_translated")


_BINS = ",".join(f"('{k}',{int(a)},{int(min(b, 10**9))},'{label}')" for k, bins in A.SUBTYPES.items() for a, b, label in bins)


@query(f"""SELECT source_id, b.label AS subtype, (b.lo + b.hi) / 2.0e0 AS midpoint FROM an LEFT JOIN (VALUES {_BINS}) AS b(mk, lo, hi, label) ON an.mk_letter = b.mk AND an.teff_k >= b.lo AND an.teff_k < b.hi""")
def m8_subtype(spark, d):
    t = F.col("teff_k")
    return anchored(spark, d).select("source_id", A.subtype(F.col("mk_letter"), t).alias("subtype"), A.subtype_midpoint(F.col("mk_letter"), t).alias("midpoint"))


@query("""SELECT source_id, CASE mk_letter WHEN 'O' THEN 100000e0 - x * 70000e0 WHEN 'B' THEN 30000e0 - x * 20000e0 WHEN 'A' THEN 10000e0 - x * 2500e0 WHEN 'F' THEN 7500e0 - x * 1500e0
WHEN 'G' THEN 6000e0 - x * 800e0 WHEN 'K' THEN 5200e0 - x * 1500e0 ELSE 3700e0 - x * 1300e0 END AS teff FROM (SELECT source_id, mk_letter, (source_id % 10) / 9.0e0 AS x FROM an)""")
def m9_interpolated_teff(spark, d):
    return anchored(spark, d).select("source_id", A.interpolated(F.col("mk_letter"), F.col("source_id") % 10).alias("teff"))


_LUM = "CASE WHEN logg < 1.5e0 THEN 'I' WHEN logg < 2.5e0 THEN 'II' WHEN logg < 3.5e0 THEN 'III' WHEN logg < 4.0e0 THEN 'IV' WHEN logg IS NOT NULL THEN 'V' END"
_AGREES = "CASE WHEN lum IN ('I', 'II') THEN abs_mag < 0 WHEN lum = 'III' THEN abs_mag >= 0 AND abs_mag < 3 WHEN lum = 'IV' THEN abs_mag >= 3 AND abs_mag < 4.5e0 WHEN lum = 'V' THEN abs_mag >= 4.5e0 END"


@query(f"SELECT source_id, lum AS luminosity_class, CASE WHEN logg < 1.5e0 THEN 'I' WHEN logg < 2.5e0 THEN 'II' WHEN logg < 3.5e0 THEN 'III' WHEN logg < 3.9e0 THEN 'IV' WHEN logg IS NOT NULL THEN 'V' END AS early_class, {_AGREES} AS magnitude_agrees FROM (SELECT *, {_LUM} AS lum FROM an)")
def m10_m11_luminosity(spark, d):
    stars = anchored(spark, d).withColumn("luminosity_class", A.luminosity(F.col("logg")))
    return stars.select("source_id", "luminosity_class", A.luminosity(F.col("logg"), 3.9).alias("early_class"), A.magnitude_agrees(F.col("luminosity_class"), F.col("abs_mag")).alias("magnitude_agrees"))


@query(f"""SELECT source_id, round(greatest(0e0, top - cut), 6) AS confidence, round(late, 6) AS spectral_confidence, round(CASE WHEN near_logg_boundary THEN late * 0.9e0 ELSE late END, 6) AS luminosity_confidence FROM (
SELECT *, (CASE WHEN is_binary_candidate THEN greatest(0e0, quality_score - 0.1e0) ELSE quality_score END) * (CASE WHEN near_teff_boundary THEN 0.9e0 ELSE 1e0 END) AS late,
(CASE WHEN quality_score >= 0.8e0 THEN 1e0 WHEN quality_score >= 0.5e0 THEN 0.85e0 WHEN quality_score >= 0.1e0 THEN 0.6e0 ELSE 0.3e0 END) - (CASE WHEN is_binary_candidate THEN 0.15e0 ELSE 0e0 END) AS top,
(CASE WHEN near_teff_boundary THEN 0.1e0 ELSE 0e0 END) + (CASE WHEN near_logg_boundary THEN 0.1e0 ELSE 0e0 END) + (CASE WHEN coalesce(NOT ({_AGREES}), false) THEN 0.05e0 ELSE 0e0 END) + (CASE WHEN abs_mag IS NULL THEN 0.05e0 ELSE 0e0 END)
+ (CASE WHEN chemistry_source = 'metallicity_fallback' THEN 0.1e0 ELSE 0e0 END) + (CASE WHEN near_chemistry_boundary THEN 0.2e0 ELSE 0e0 END) + (CASE WHEN alpha_fe IS NULL THEN 0.05e0 ELSE 0e0 END) + (CASE WHEN quality_score < 0.5e0 THEN 0.05e0 ELSE 0e0 END) AS cut
FROM (SELECT *, {_LUM} AS lum FROM an))""")
def m12_m14_confidence(spark, d):
    stars = A.confidence(anchored(spark, d))
    return stars.select("source_id", *[F.round(c, 6).alias(c) for c in ("confidence", "spectral_confidence", "luminosity_confidence")])


def _two_places(x: str) -> str:
    """A number of at most four decimals with two, halves away from zero, as Java's formatter has it."""
    r = f"round(CAST({x} AS DECIMAL(18, 4)), 2)"
    return f"(CASE WHEN {x} < 0 AND {r} = 0 THEN '-0.00' ELSE CAST({r} AS VARCHAR) END)"


@query(f"""SELECT source_id, CASE WHEN NOT (is_binary_candidate OR has_emission OR is_metal_poor OR is_high_velocity) THEN 'None identified.' ELSE concat_ws(' ',
CASE WHEN is_binary_candidate THEN 'Binary candidate flagged by RUWE=' || {_two_places("ruwe")} || '; physical parameters (Teff, logg, chemistry) may reflect flux contamination from an unresolved companion, and the spectral classification should be treated with corresponding caution.' END,
CASE WHEN has_emission THEN 'H-alpha emission detected (EW=' || {_two_places("coalesce(ew_espels_halpha, 0e0)")} || ' Å, ESP-ELS); consistent with chromospheric activity, a Be-type disk, or an active stellar phenomenon.' END,
CASE WHEN is_metal_poor THEN 'Metal-poor star ([Fe/H]≈' || {_two_places("chemistry_value")} || ' dex); the sub-solar chemistry is consistent with membership in an old stellar population.' END,
CASE WHEN is_high_velocity THEN 'High tangential velocity (v_tan=' || {_two_places("v_tan")} || ' km/s); this kinematic outlier strongly supports Halo membership regardless of photometric metallicity.' END) END AS notable_features FROM an""")
def m15_features(spark, d):
    return A.features(anchored(spark, d)).select("source_id", "notable_features")


@query("""SELECT source_id, (abs_mag IS NULL)::INT + (teff_k IS NULL)::INT + (metallicity IS NULL)::INT + (logg IS NULL)::INT + (v_tan IS NULL)::INT + (quality_score = 0)::INT AS n_warnings, coalesce(quality_score = 0, false) AS zero_quality FROM an""")
def m16_contract_validation(spark, d):
    return A.warnings(anchored(spark, d)).select("source_id", F.size("warnings").alias("n_warnings"), F.array_contains("warnings", "quality is zero").alias("zero_quality"))


@query("SELECT source_id, CASE WHEN lower(trim(nss_solution_type)) IN ('', 'nan', 'none', 'null') THEN NULL ELSE nss_solution_type END AS nss, CAST(trunc(rv_nb_transits) AS BIGINT) AS transits, ew_espels_halpha IS NULL AS no_width FROM cat")
def c6_c8_sanitize(spark, d):
    stars = S.sanitized(catalogue(spark, d))
    return stars.select("source_id", S.known(F.col("nss_solution_type")).alias("nss"), S.whole(F.col("rv_nb_transits")).alias("transits"), S.missing(F.col("ew_espels_halpha")).alias("no_width"))


@query("SELECT source_id AS id, teff_gspphot AS teff, 'x' AS tag, CAST(NULL AS DOUBLE) AS missing FROM cat")
def c1_c5_projection(spark, d):
    stars = catalogue(spark, d, "source_id", "teff_gspphot").toDF("SOURCE_ID", "TEFF")
    return stars.toDF(*[c.lower() for c in stars.columns]).withColumnsRenamed({"source_id": "id"}).withColumns({"tag": F.lit("x"), "missing": F.lit(None).cast("double")})


@query("""SELECT c_custkey, upper(trim(regexp_replace('  ' || c_name || '   x ', '\\s+', ' ', 'g'))) AS one_blank, upper(regexp_replace(c_name || ' y', '\\s+', '', 'g')) AS no_blank,
nullif(regexp_extract(c_name, '(\\d+)', 1), '') AS digits, 'HD' || CAST(c_custkey AS VARCHAR) AS cat_key, c_nationkey IN (1, 2) AND contains(lower(c_mktsegment), 'auto') AS found, least(greatest(c_acctbal, 0e0), 5000e0) AS clipped,
printf('%.1f', c_custkey * 1.0e0) AS shown FROM customer""")
def k_scalar_texts(spark, d):
    c = F.col
    df = spark.read.parquet(f"{d}/customer.parquet")
    return df.select(
        "c_custkey", S.one_blank(F.concat(F.lit("  "), c("c_name"), F.lit("   x "))).alias("one_blank"), S.no_blank(F.concat(c("c_name"), F.lit(" y"))).alias("no_blank"),
        S.group(c("c_name"), r"(\d+)").alias("digits"), S.catalogue_key(F.concat(F.lit("hd "), c("c_custkey").cast("string"))).alias("cat_key"),
        (c("c_nationkey").isin(1, 2) & S.contains_any(c("c_mktsegment"), ["AUTO"])).alias("found"), S.clipped(c("c_acctbal"), 0.0, 5000.0).alias("clipped"), S.fixed(c("c_custkey").cast("double"), "%.1f").alias("shown"),
    )


@query("""SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS size, round(list_sum(list_filter(e, lambda x: x > 0)) / len(list_filter(e, lambda x: x > 0)), 6) AS mean_positive, round(list_sum(e) - (e[1] + e[len(e)]) / 2.0e0, 6) AS area FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def k_array_functions(spark, d):
    e = F.col("embedding").cast("array<double>")
    df = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("e", e).withColumn("x", F.transform(F.sequence(F.lit(1), F.size("e")), lambda k: k.cast("double")))
    return df.select("vec_id", F.round(S.norm(F.col("e")), 6).alias("size"), F.round(S.masked_mean(F.col("e"), lambda x: x > 0), 6).alias("mean_positive"), F.round(S.trapezoid(F.col("x"), F.col("e")), 6).alias("area"))
