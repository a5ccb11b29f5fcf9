"""Rules that turn a catalogue row into measurements, flags and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.scalar import known, log10, true

#: Fixed values of the rules.
RELIABLE_RATIO, RUWE_LIMIT, EXTINCTION, TANGENT = 5.0, 1.4, 2.74, 4.74
GIANT_MAG, GIANT_TEFF, HIGH_VELOCITY, METAL_POOR = 3.0, 7000.0, 200.0, -1.0
LEAST_TRANSITS = 5


def c(name: str) -> Column:
    return F.col(name)


def astrometry(df: DataFrame) -> DataFrame:
    """astrometry_status, teff_k, extinction_ag, abs_mag, v_tan, is_reliable_parallax, is_giant, is_high_velocity, ruwe_flag."""
    p, e = c("parallax"), c("parallax_error")
    status = F.when(p <= 0, "partial").when(e == 0, "failed").otherwise("success")
    df = df.withColumns({"astrometry_status": status, "teff_k": c("teff_gspphot").cast("int"), "ruwe_flag": true(c("ruwe") > RUWE_LIMIT)})
    fine = c("astrometry_status") == "success"
    reliable = true(fine & (F.try_divide(p, e) > RELIABLE_RATIO))
    ag = F.coalesce(c("ebpminrp_gspphot"), F.lit(0.0)) * EXTINCTION
    df = df.withColumns({"is_reliable_parallax": reliable, "extinction_ag": F.when(fine, F.round(ag, 4))})
    reliable = c("is_reliable_parallax")
    mag = c("phot_g_mean_mag") + 5.0 + 5.0 * log10(p / 1000.0) - ag
    speed = F.lit(TANGENT) * F.sqrt(c("pmra") * c("pmra") + c("pmdec") * c("pmdec")) / p
    df = df.withColumns({"abs_mag": F.when(reliable, F.round(mag, 4)), "v_tan": F.when(reliable, F.round(speed, 4))})
    giant = reliable & (c("abs_mag") < GIANT_MAG) & (c("teff_k") < GIANT_TEFF)
    return df.withColumns({"is_giant": true(giant), "is_high_velocity": true(reliable & (c("v_tan") > HIGH_VELOCITY))})


def velocity_limit(teff: Column) -> Column:
    """Radial-velocity error beyond which a star of this temperature counts as variable."""
    return F.when(teff >= 7000, 10.0).when(teff < 4000, 2.0).otherwise(5.0)


def binarity(df: DataFrame) -> DataFrame:
    """adaptive_rv_threshold, nss_solution, is_binary_candidate and its three reasons."""
    df = df.withColumns({"adaptive_rv_threshold": velocity_limit(c("teff_gspphot")), "nss_solution": known(c("nss_solution_type")), "n_transits": F.coalesce(c("rv_nb_transits").try_cast("int"), F.lit(0))})
    df = df.withColumns({
        "binary_ruwe": true(c("ruwe") > RUWE_LIMIT),
        "binary_rv": true((c("n_transits") >= LEAST_TRANSITS) & (c("radial_velocity_error") > c("adaptive_rv_threshold"))),
        "binary_nss": c("nss_solution").isNotNull(),
    })
    return df.withColumn("is_binary_candidate", c("binary_ruwe") | c("binary_rv") | c("binary_nss"))


def emission(df: DataFrame) -> DataFrame:
    """has_emission and has_emission_source: a valid negative width of the catalogue, else the core of the fitted line."""
    by_catalogue = true((c("ew_espels_halpha_flag") == 0) & (c("ew_espels_halpha") < 0))
    source = F.when(by_catalogue, "catalog").when(true(c("emission_core")), "spectral_fit").otherwise("none")
    return df.withColumn("has_emission_source", source).withColumn("has_emission", c("has_emission_source") != "none")


def quality(df: DataFrame) -> DataFrame:
    """quality_score from the parallax and the two continua."""
    bprp = F.when(c("bprp_status") != "success", 0.3).when(~c("bprp_high_snr"), 0.5).otherwise(1.0)
    rvs = F.when(c("rvs_status") != "success", 0.7).when(~c("rvs_stable"), 0.85).otherwise(1.0)
    score = F.when(c("is_reliable_parallax"), 1.0).otherwise(0.0) * bprp * rvs
    best = c("bprp_high_snr") & c("rvs_high_snr") & c("rvs_stable")
    score = F.when(best, F.least(F.lit(1.0), score * 1.1)).otherwise(score)
    return df.withColumn("quality_score", F.round(score, 4))


def judged(df: DataFrame) -> DataFrame:
    """All rules over a catalogue; one projection after another, no shuffle."""
    df = quality(emission(binarity(astrometry(df))))
    return df.withColumn("is_metal_poor", true(c("mh_gspphot") < METAL_POOR))


def contracts(df: DataFrame, version: str = "1") -> DataFrame:
    """The nested contract of every star of a judged catalogue."""
    s = F.struct
    vector = s("abs_mag", "teff_k", c("mh_gspphot").alias("metallicity"), c("fem_gspspec").alias("fe_h"), c("alphafe_gspspec").alias("alpha_fe"), c("logg_gspphot").alias("logg"), "v_tan", "extinction_ag")
    flags = s("is_reliable_parallax", "is_giant", "is_metal_poor", "is_binary_candidate", "is_high_velocity", "has_emission", "has_emission_source")
    binary = s("ruwe", c("radial_velocity_error").alias("rv_error_km_s"), c("n_transits").alias("rv_nb_transits"), "nss_solution", "adaptive_rv_threshold")
    halpha = s((F.round(c("ew_espels_halpha") * 10.0, 3)).alias("ew_aa"), c("ew_espels_halpha_flag").alias("flag"))
    spectral = s(halpha.alias("halpha_catalog"), s(c("bprp_status").alias("status"), c("bprp_high_snr").alias("high_snr")).alias("bprp_continuum"), s(c("rvs_status").alias("status"), c("rvs_stable").alias("stable"), c("rvs_high_snr").alias("high_snr")).alias("rvs_continuum"))
    binary_status = F.when(c("is_binary_candidate"), "candidate").otherwise("single")
    return df.select("source_id", F.lit(version).alias("pipeline_version"), "astrometry_status", binary_status.alias("binary_status"), vector.alias("physical_vector"), flags.alias("logical_flags"), binary.alias("binary_diagnostics"), spectral.alias("spectral_summary"), "quality_score")


def flattened(df: DataFrame) -> DataFrame:
    """A contract as flat columns."""
    return df.select("source_id", "astrometry_status", "physical_vector.*", "logical_flags.*", c("binary_diagnostics.ruwe").alias("ruwe"), c("spectral_summary.halpha_catalog.ew_aa").alias("halpha_ew_aa"), c("spectral_summary.bprp_continuum.status").alias("bprp_status"), c("spectral_summary.rvs_continuum.status").alias("rvs_status"), "quality_score")
