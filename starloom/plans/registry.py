"""Collects the queries of all plan modules."""

from __future__ import annotations

import re

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from starloom.sources.bindings import catalogue_cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("stars", "blocks", "joins", "summaries", "evaluation", "knowledge", "files", "events", "reports", "validation")


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL where there is one.

    The SQL may start from the CTEs ``cat``, ``hc`` (judged catalogue), ``an`` (anchored) and ``co`` (corrected); those it names are put in front.
    """

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _with(sql)
        return f

    return keep


#: The rules again, as SQL, for the checks.
HC = """j1 AS (SELECT *, CASE WHEN parallax <= 0 THEN 'partial' WHEN parallax_error = 0 THEN 'failed' ELSE 'success' END AS astrometry_status,
  CAST(trunc(teff_gspphot) AS INTEGER) AS teff_k, coalesce(ruwe > 1.4e0, false) AS ruwe_flag FROM cat),
j2 AS (SELECT *, coalesce(astrometry_status = 'success' AND parallax / parallax_error > 5, false) AS is_reliable_parallax,
  CASE WHEN astrometry_status = 'success' THEN round(2.74e0 * coalesce(ebpminrp_gspphot, 0e0), 4) END AS extinction_ag FROM j1),
j3 AS (SELECT *, CASE WHEN is_reliable_parallax THEN round(phot_g_mean_mag + 5.0e0 + 5.0e0 * log10(parallax / 1000.0e0) - 2.74e0 * coalesce(ebpminrp_gspphot, 0e0), 4) END AS abs_mag,
  CASE WHEN is_reliable_parallax THEN round(4.74e0 * sqrt(pmra * pmra + pmdec * pmdec) / parallax, 4) END AS v_tan,
  CASE WHEN teff_gspphot >= 7000 THEN 10.0e0 WHEN teff_gspphot < 4000 THEN 2.0e0 ELSE 5.0e0 END AS adaptive_rv_threshold,
  CASE WHEN lower(trim(nss_solution_type)) NOT IN ('', 'nan', 'none', 'null') THEN nss_solution_type END AS nss_solution,
  coalesce(CAST(trunc(rv_nb_transits) AS INTEGER), 0) AS n_transits FROM j2),
j4 AS (SELECT *, coalesce(is_reliable_parallax AND abs_mag < 3 AND teff_k < 7000, false) AS is_giant, coalesce(is_reliable_parallax AND v_tan > 200, false) AS is_high_velocity,
  coalesce(ruwe > 1.4e0, false) AS binary_ruwe, coalesce(n_transits >= 5 AND radial_velocity_error > adaptive_rv_threshold, false) AS binary_rv, nss_solution IS NOT NULL AS binary_nss,
  CASE WHEN ew_espels_halpha_flag = 0 AND ew_espels_halpha < 0 THEN 'catalog' WHEN emission_core THEN 'spectral_fit' ELSE 'none' END AS has_emission_source,
  coalesce(mh_gspphot < -1.0e0, false) AS is_metal_poor FROM j3),
hc AS (SELECT *, binary_ruwe OR binary_rv OR binary_nss AS is_binary_candidate, has_emission_source <> 'none' AS has_emission,
  round(CASE WHEN bprp_high_snr AND rvs_high_snr AND rvs_stable THEN least(1.0e0, 1.1e0 * q) ELSE q END, 4) AS quality_score
  FROM (SELECT *, (CASE WHEN is_reliable_parallax THEN 1.0e0 ELSE 0.0e0 END) * (CASE WHEN bprp_status <> 'success' THEN 0.3e0 WHEN NOT bprp_high_snr THEN 0.5e0 ELSE 1.0e0 END)
    * (CASE WHEN rvs_status <> 'success' THEN 0.7e0 WHEN NOT rvs_stable THEN 0.85e0 ELSE 1.0e0 END) AS q FROM j4))"""

AN = """a1 AS (SELECT * REPLACE (coalesce(teff_k, 5000) AS teff_k, coalesce(quality_score, 1.0e0) AS quality_score), coalesce(mh_gspphot, 0e0) AS metallicity, fem_gspspec AS fe_h, alphafe_gspspec AS alpha_fe, logg_gspphot AS logg FROM hc),
a2 AS (SELECT *, CASE WHEN fe_h <> 0 THEN fe_h ELSE metallicity END AS chemistry_value, is_high_velocity AND is_reliable_parallax AND v_tan IS NOT NULL AS fast FROM a1),
a3 AS (SELECT *, coalesce(alpha_fe >= 0.2e0 AND chemistry_value >= -1.0e0 AND chemistry_value < -0.2e0, false) AS enhanced FROM a2),
an AS (SELECT *, CASE WHEN fast THEN 'Halo' WHEN enhanced THEN 'Disco Grueso' WHEN chemistry_value < -1.0e0 THEN 'Halo' WHEN chemistry_value < -0.2e0 THEN 'Disco Grueso' ELSE 'Disco Fino' END AS population_group,
  CASE WHEN fast THEN 'kinematics_override' WHEN fe_h <> 0 THEN 'fe_h' ELSE 'metallicity_fallback' END AS chemistry_source,
  CASE WHEN fast THEN 'is_high_velocity=True' WHEN enhanced THEN printf('alpha_fe=%.2f>=0.2 AND chemistry=%.3f in [-1.0,-0.2)', alpha_fe, chemistry_value)
    WHEN chemistry_value < -1.0e0 THEN printf('chemistry=%.3f < -1.0', chemistry_value) WHEN chemistry_value < -0.2e0 THEN printf('chemistry=%.3f in [-1.0,-0.2)', chemistry_value) ELSE printf('chemistry=%.3f >= -0.2', chemistry_value) END AS decision_rule,
  CASE WHEN teff_k >= 30000 THEN 'O' WHEN teff_k >= 10000 THEN 'B' WHEN teff_k >= 7500 THEN 'A' WHEN teff_k >= 6000 THEN 'F' WHEN teff_k >= 5200 THEN 'G' WHEN teff_k >= 3700 THEN 'K' ELSE 'M' END AS mk_letter,
  coalesce(least(abs(teff_k - 30000), abs(teff_k - 10000), abs(teff_k - 7500), abs(teff_k - 6000), abs(teff_k - 5200), abs(teff_k - 3700)) <= 200, false) AS near_teff_boundary,
  coalesce(least(abs(logg - 1.5e0), abs(logg - 2.5e0), abs(logg - 3.5e0), abs(logg - 3.9e0)) <= 0.2e0, false) AS near_logg_boundary,
  coalesce(least(abs(chemistry_value - (-0.2e0)), abs(chemistry_value - (-1.0e0))) <= 0.1e0, false) AS near_chemistry_boundary FROM a3)"""

CO = """co AS (SELECT * REPLACE (CASE WHEN changed THEN 'A' ELSE mk_letter END AS mk_letter, CASE population_group WHEN 'Disco Fino' THEN 'Thin Disk' WHEN 'Disco Grueso' THEN 'Thick Disk' ELSE population_group END AS population_group),
  mk_letter AS mk_before, population_group AS population_before FROM (SELECT *, coalesce(teff_k >= 9700 AND teff_k < 10100 AND mk_letter = 'B' AND logg >= 3.8e0, false) AS changed FROM an))"""


def _with(sql: str) -> str:


    level = next((k for k, name in ((4, "co"), (3, "an"), (2, "hc"), (1, "cat")) if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.IGNORECASE)), 0)
    parts = [catalogue_cte(), HC, AN, CO][:level]
    if not parts:
        return sql.strip()
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return start + ",\n".join(parts) + ",\n" + body[len(start) :]
    return "WITH " + ",\n".join(parts) + "\n" + body


def _loaded() -> None:
    for name in MODULES:
        import_module(f"starloom.plans.{name}")


def catalogue_queries() -> dict:
    _loaded()
    return dict(QUERIES)


def catalogue_sql() -> dict:
    _loaded()
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters by population over the whole catalogue: rules, anchors, one aggregate."""
    _loaded()
    return QUERIES["flagship_letters_by_population"](spark, sf_dir)
