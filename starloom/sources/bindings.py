"""Virtual star tables over the test tables.

Operators work on logical column names; a binding supplies the table. The expressions below are
plain SQL that Spark and DuckDB read alike, so the same binding serves queries and their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_K, _C = "o_orderkey", "c_custkey"

#: Logical catalogue column -> expression over orders joined with customer.
CATALOGUE = {
    "source_id": _K,
    "teff_gspphot": f"""CASE WHEN {_K} % 37 = 0 THEN NULL ELSE CAST(CASE {_K} % 10
        WHEN 0 THEN 2600 + ({_K} * 7919) % 1100 WHEN 1 THEN 3700 + ({_K} * 7919) % 1500 WHEN 2 THEN 3700 + ({_K} * 7919) % 1500
        WHEN 3 THEN 5200 + ({_K} * 7919) % 800 WHEN 4 THEN 6000 + ({_K} * 7919) % 1500 WHEN 5 THEN 6000 + ({_K} * 7919) % 1500
        WHEN 6 THEN 7500 + ({_K} * 7919) % 2500 WHEN 7 THEN 9650 + ({_K} * 7919) % 500 WHEN 8 THEN 10000 + ({_K} * 7919) % 20000
        ELSE 28000 + ({_K} * 7919) % 8000 END AS DOUBLE) END""",
    "logg_gspphot": f"CASE WHEN {_K} % 41 = 0 THEN NULL ELSE (({_K} * 613) % 550) / 100.0e0 END",
    "mh_gspphot": f"(({_C} * 13 + {_K} * 29) % 350) / 100.0e0 - 2.5e0",
    "fem_gspspec": f"CASE WHEN {_K} % 9 < 4 THEN (({_K} * 31) % 300 - 200) / 100.0e0 END",
    "alphafe_gspspec": f"CASE WHEN {_K} % 17 < 9 THEN (({_K} * 53) % 60 - 10) / 100.0e0 END",
    "parallax": "(o_totalprice - 20000.0e0) / 20000.0e0",
    "parallax_error": f"0.02e0 + ({_K} % 50) / 25.0e0",
    "pmra": f"(({_K} * 17) % 401 - 200) * 1.0e0",
    "pmdec": f"(({_K} * 43) % 401 - 200) * 1.0e0",
    "ruwe": f"0.8e0 + ({_K} % 23) / 20.0e0",
    "phot_g_mean_mag": f"3.0e0 + (({_K} * 3) % 1500) / 100.0e0",
    "ebpminrp_gspphot": f"CASE WHEN {_K} % 5 = 0 THEN NULL ELSE ({_K} % 80) / 100.0e0 END",
    "radial_velocity_error": f"CASE WHEN {_K} % 7 = 0 THEN NULL ELSE (({_K} * 11) % 150) / 10.0e0 END",
    "rv_nb_transits": f"CASE WHEN {_K} % 11 = 0 THEN NULL ELSE ({_K} % 30) * 1.0e0 END",
    "nss_solution_type": f"CASE {_K} % 20 WHEN 0 THEN 'Orbital' WHEN 1 THEN 'SB1' WHEN 2 THEN '' WHEN 3 THEN 'nan' WHEN 4 THEN ' None ' WHEN 5 THEN 'null' END",
    "ew_espels_halpha": f"CASE WHEN {_K} % 6 = 0 THEN NULL ELSE (({_K} * 19) % 700 - 100) / 1000.0e0 END",
    "ew_espels_halpha_flag": f"CASE WHEN {_K} % 6 = 0 THEN NULL ELSE CAST({_K} % 4 AS INT) END",
    "b": f"(({_K} * 7) % 181 - 90) * 1.0e0",
    "parallax_over_error": f"((o_totalprice - 20000.0e0) / 20000.0e0) / (0.02e0 + ({_K} % 50) / 25.0e0)",
    "flux_over_error": f"(({_K} * 37) % 500) * 1.0e0",
    "has_rvs": f"({_K} % 8 <> 3)",
    "has_xp": f"({_K} % 13 <> 5)",
    "bprp_status": f"CASE WHEN {_K} % 6 = 5 THEN 'failed' ELSE 'success' END",
    "bprp_high_snr": f"({_K} % 4 < 2)",
    "rvs_status": f"CASE WHEN {_K} % 7 = 6 THEN 'failed' ELSE 'success' END",
    "rvs_stable": f"({_K} % 3 < 2)",
    "rvs_high_snr": f"({_K} % 5 < 3)",
    "emission_core": f"({_K} % 19 = 4)",
    "cat_fitted": f"CAST({_K} % 4 AS INT)",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The star catalogue; only the named columns, where any are named."""
    stars = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return stars.selectExpr(*[f"{CATALOGUE[c]} AS {c}" for c in columns or CATALOGUE])


def catalogue_cte(name: str = "cat") -> str:
    """The same as a common table expression."""
    columns = ",\n  ".join(f"{e} AS {c}" for c, e in CATALOGUE.items())
    return f"{name} AS (SELECT {columns}\n  FROM orders JOIN customer ON o_custkey = c_custkey)"
