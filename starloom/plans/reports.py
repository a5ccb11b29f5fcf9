"""Reports, scans that may fail, numpy files, JSON arrays."""

from pyspark.sql import functions as F

from starloom.operators import anchor as A
from starloom.operators import metrics as M
from starloom.operators import reports as P
from starloom.operators import texts as T
from starloom.plans.evaluation import _GRID, _MENTION, _PAIRS, ORDER, pairs
from starloom.plans.registry import query
from starloom.plans.stars import _LUM, anchored
from starloom.sources import arrays as N
from starloom.sources import paged as G
from starloom.sources import readers as R
from starloom.sources import resilient as S
from starloom.sources import sinks as W
from starloom.sources.bindings import catalogue, read
from starloom.sources.scratch import fresh

_MIDDLE = "CASE mk_letter " + " ".join("WHEN '" + k + "' THEN CASE " + " ".join(f"WHEN teff_k >= {float(a)!r}::DOUBLE AND teff_k < {float(b)!r}::DOUBLE THEN {(float(a) + float(b)) / 2!r}::DOUBLE" for a, b, _ in bins) + " END" for k, bins in A.SUBTYPES.items()) + " END"
_LOGG = "CASE lum " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in M.CLASS_LOGG.items()) + " END"
_MEASURED = f"""e AS (SELECT *, {_LUM} AS lum, teff_gspphot + (source_id % 7 - 3) * 150e0 AS true_teff, CASE WHEN source_id % 5 > 0 THEN logg + 0.3e0 END AS true_logg, CASE WHEN source_id % 4 > 0 THEN source_id % 4 ELSE 1 END AS w FROM an),
e2 AS (SELECT abs({_MIDDLE} - true_teff) AS t, CASE WHEN true_logg <> 0 THEN abs({_LOGG} - true_logg) END AS g, w FROM e WHERE true_teff <> 0),
phys AS (SELECT count(t) AS n_teff, round(sum(t * w) / sum(w) FILTER (WHERE t IS NOT NULL), 1) AS teff_error, count(g) AS n_logg, round(sum(g * w) / sum(w) FILTER (WHERE t IS NOT NULL), 4) AS logg_error FROM e2)"""


def measured(spark, d):
    """Stars with invented measurements beside what was found for them."""
    i = F.col("source_id")
    stars = anchored(spark, d).withColumn("luminosity_class", A.luminosity(F.col("logg")))
    return stars.select("source_id", F.col("mk_letter").alias("letter"), "teff_k", "luminosity_class", (F.col("teff_gspphot") + (i % 7 - 3) * 150.0).alias("true_teff"), F.when(i % 5 > 0, F.col("logg") + 0.3).alias("true_logg"), (i % 4).alias("n_measurements"))


@query(f"WITH {_MEASURED} SELECT * FROM phys")
def o2_physical_errors(spark, d):
    return M.physical_errors(measured(spark, d))


_LUMS = "(VALUES " + ", ".join(f"('{x}')" for x in M.LUMINOSITIES) + ")"
_LUM_MATRIX = f"""lp AS (SELECT {_LUM} AS q, {_LUM.replace('logg', 'shifted')} AS t FROM (SELECT *, logg + (source_id % 3 - 1) * 0.5e0 AS shifted FROM an)),
lm AS (SELECT a.l AS truth_label, b.l AS predicted_label, count(lp.t) AS n FROM {_LUMS} AS a(l) CROSS JOIN {_LUMS} AS b(l) LEFT JOIN lp ON lp.t = a.l AND lp.q = b.l GROUP BY ALL)"""


def _luminosities(spark, d):
    g = F.col("logg")
    rows = anchored(spark, d).select(A.luminosity(g).alias("predicted"), A.luminosity(g + (F.col("source_id") % 3 - 1) * 0.5).alias("truth"))
    return M.confusion(rows, "truth", "predicted", M.LUMINOSITIES)


@query(f"WITH {_LUM_MATRIX} SELECT * FROM lm")
def o10_luminosity_confusion(spark, d):
    return _luminosities(spark, d)


_WIDE = ", ".join(f"CAST(sum(n) FILTER (WHERE q = '{x}') AS BIGINT) AS {x}" for x in ORDER)


@query(f"WITH {_PAIRS}, {_GRID} SELECT t AS truth_label, {_WIDE} FROM m GROUP BY t")
def b9_confusion_csv(spark, d):
    path = fresh(spark, "confusion")
    W.csv(P.wide(M.confusion(pairs(spark, d), "truth", "predicted", ORDER), ORDER), path)
    return R.csv(spark, path, "truth_label string, " + ", ".join(f"{x} bigint" for x in ORDER))


_REPORT = f"""{_MEASURED}, {_LUM_MATRIX}, {_PAIRS}, {_GRID},
mk AS (SELECT sum(support) AS n, sum(hits) / sum(support) AS accuracy, sum(CAST(support AS DOUBLE) * predicted) / (sum(support) * CAST(sum(support) AS DOUBLE)) AS e FROM c),
ls AS (SELECT a.l, (SELECT sum(n) FROM lm WHERE truth_label = a.l) AS s, (SELECT sum(n) FROM lm WHERE predicted_label = a.l) AS p, (SELECT sum(n) FROM lm WHERE truth_label = a.l AND predicted_label = a.l) AS h FROM {_LUMS} AS a(l)),
lu AS (SELECT sum(s) AS n, sum(h) / sum(s) AS accuracy, sum(CAST(s AS DOUBLE) * p) / (sum(s) * CAST(sum(s) AS DOUBLE)) AS e FROM ls),
report AS (SELECT level, measure, round(CAST(value AS DOUBLE), 4) AS value FROM (
SELECT 'class' AS level, unnest(['n', 'accuracy', 'kappa']) AS measure, unnest([CAST(n AS DOUBLE), accuracy, (accuracy - e) / (1 - e)]) AS value FROM mk
UNION ALL SELECT 'luminosity', unnest(['n', 'accuracy', 'kappa']), unnest([CAST(n AS DOUBLE), accuracy, (accuracy - e) / (1 - e)]) FROM lu
UNION ALL SELECT 'physical', unnest(['n_teff', 'teff_error', 'n_logg', 'logg_error']), unnest([CAST(n_teff AS DOUBLE), teff_error, CAST(n_logg AS DOUBLE), logg_error]) FROM phys))"""


def _report(spark, d):
    classes = M.agreement(M.confusion(pairs(spark, d), "truth", "predicted", ORDER)).select("n", "accuracy", "kappa")
    return P.assembled({"class": classes, "luminosity": M.agreement(_luminosities(spark, d)).select("n", "accuracy", "kappa"), "physical": M.physical_errors(measured(spark, d))})


@query(f"WITH {_REPORT} SELECT * FROM report")
def o12_report(spark, d):
    return _report(spark, d)


@query(f"WITH {_REPORT} SELECT level, measure, rpad(level, 16, ' ') || rpad(measure, 16, ' ') || coalesce(printf('%.4f', value), 'N/A') AS line FROM report")
def b9_b10_summary_lines(spark, d):
    return P.lines(_report(spark, d))


@query(f"""WITH k AS (SELECT doc_id, (a <> 0)::INT + (b <> 0)::INT AS total, (a <> 0 AND {_MENTION.format('a', '0.02e0')})::INT + (b <> 0 AND {_MENTION.format('b', '0.05e0')})::INT AS passed FROM (SELECT doc_id, text, doc_id % 2000 * 1e0 AS a, doc_id % 7 * 1e0 AS b FROM documents))
SELECT count(*) AS n, round(avg(passed / total), 9) AS mean_coherence, round(avg((passed = total)::INT), 9) AS full_share, count(*) FILTER (WHERE passed < total) AS n_violators, (SELECT array_agg(doc_id ORDER BY doc_id) FROM (SELECT doc_id FROM k WHERE total > 0 AND passed < total ORDER BY doc_id LIMIT 5)) AS first_violators FROM k WHERE total > 0""")
def f31_coherence_summary(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 2000).cast("double").alias("a"), (F.col("doc_id") % 7).cast("double").alias("b"))
    found = P.violations(T.coherence(docs, "text", {"a": 0.02, "b": 0.05}), "doc_id", "checks_passed", "checks_total")
    return found.select("n", F.round("mean_coherence", 9).alias("mean_coherence"), F.round("full_share", 9).alias("full_share"), "n_violators", "first_violators")


@query("SELECT part, count(*) AS n, avg(hit) AS rate FROM (SELECT unnest(['all', CASE WHEN near_teff_boundary THEN 'flagged' ELSE 'plain' END, 'class ' || mk_letter]) AS part, CASE WHEN source_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS hit FROM an) GROUP BY part")
def f33_hit_rates(spark, d):
    return P.hit_rates(anchored(spark, d).withColumn("hit", F.col("source_id") % 3 == 0), "mk_letter", "hit", "near_teff_boundary")


@query("SELECT r_regionkey, r_name FROM region")
def a1_a2_resilient_scan(spark, d):
    return S.first_that_works(lambda: spark.read.parquet(f"{d}/no-such-table.parquet"), lambda: read(spark, d, "region").select("r_regionkey", "r_name"), sleep=lambda _: None)


_PAGE = 64  #: rows of a page here, so that small tables have several


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 100 AND c_custkey <> 7")
def a2_n15_paged_scan(spark, d):
    """Every third page fails twice while it is read, and gives its rows at the third try."""
    archive = G.ParquetArchive(f"{d}/customer.parquet", "c_custkey", failing=lambda at: 2 if at // _PAGE % 3 == 0 else 0)
    return G.scan(spark, archive, "c_custkey long, c_name string, c_acctbal double", _PAGE, wait=0.001, strict=True).where("c_acctbal > 100 and c_custkey <> 7")


@query(f"SELECT c_custkey, c_name FROM (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) WHERE (k // {_PAGE}) % 4 <> 1 OR k % {_PAGE} // {_PAGE // 10} <> 3")
def a1_dead_pages(spark, d):
    """Of every fourth page a tenth is dead: the page falls back to smaller ones, and only those rows are left out."""
    dead = lambda at, n: at // _PAGE % 4 == 1 and at % _PAGE < _PAGE // 10 * 4 and at % _PAGE + n > _PAGE // 10 * 3
    archive = G.ParquetArchive(f"{d}/customer.parquet", "c_custkey", dead=dead)
    return G.scan(spark, archive, "c_custkey long, c_name string", _PAGE, tries=2, wait=0.001)


@query("SELECT s_name AS main_id, s_acctbal AS teff FROM supplier WHERE s_suppkey % 3 > 0")
def a5_e4_batched_names(spark, d):
    """Names in batches of 500 through an archive that calls its columns otherwise."""
    archive = G.ParquetArchive(f"{d}/supplier.parquet", "s_name", {"s_name": "_Source", "s_acctbal": "teff"})
    names = read(spark, d, "supplier").where("s_suppkey % 3 > 0").select(F.concat(F.lit(" "), "s_name").alias("name"))
    return G.looked_up(names.unionByName(names).unionByName(names.limit(1).select(F.lit(" ").alias("name"))), archive, "name", {"teff": "double"}, "main_id", wait=0.001)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 50000")
def a4_capped_fetch(spark, d):
    return S.capped(read(spark, d, "customer"), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT 1000000000000000 + c_custkey AS source_id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS sp_type FROM customer")
def a6_k14_resolver(spark, d):
    name = F.lit(10**15) + F.col("c_custkey")
    rows = read(spark, d, "customer")
    table = rows.where("c_custkey % 3 > 0").select(F.concat(F.lit("Gaia DR3 "), name.cast("string"), F.lit(" (star)")).alias("designation"), F.col("c_mktsegment").alias("sp_type"))
    return S.resolved(rows.select(name.alias("source_id")), table)


@query("SELECT n_nationkey, n_name FROM nation")
def a19_reused_extract(spark, d):
    path, rows = fresh(spark, "extract"), read(spark, d, "nation").select("n_nationkey", "n_name")
    S.reused(spark, path, "n_name", lambda: rows)
    return S.reused(spark, path, "n_name", lambda: rows.limit(0))


@query("SELECT r_regionkey AS source_id, r_regionkey * 1.5e0 AS teff FROM region")
def a13_first_list(spark, d):
    path = fresh(spark, "wrapped")
    item = F.struct(F.col("r_regionkey").alias("source_id"), (F.col("r_regionkey") * F.lit(1.5)).alias("teff"))
    read(spark, d, "region").agg(F.to_json(F.struct(F.lit("x").alias("name"), F.collect_list(item).alias("rows"))).alias("value")).write.text(path)
    return R.wrapped_json(spark, path, "source_id bigint, teff double")


@query("SELECT source_id, teff_gspphot AS teff FROM cat")
def b3_json_arrays(spark, d):
    path = fresh(spark, "arrays")
    W.json_arrays(catalogue(spark, d, "source_id", "teff_gspphot").select("source_id", F.col("teff_gspphot").alias("teff")), path)
    return R.json_array(spark, path, "source_id bigint, teff double")


@query("SELECT vec_id AS source_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 3 > 0")
def a14_b5_row_gather(spark, d):
    path, rows = fresh(spark, "matrix"), read(spark, d, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("flux"))
    N.write_matrix(rows, path)
    found = N.gathered(spark, path, rows.where("source_id % 3 > 0"))
    return found.select("source_id", F.size("flux").alias("n"), F.round(F.aggregate("flux", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT n_nationkey AS source_id, [CAST(n_nationkey AS DOUBLE), n_nationkey + 0.5e0] AS wavelength, [CAST(n_regionkey AS FLOAT), CAST(0.25 AS FLOAT)] AS flux FROM nation")
def b5_archives(spark, d):
    path, k = fresh(spark, "archives"), F.col("n_nationkey").cast("double")
    rows = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("source_id"), F.array(k, k + 0.5).alias("wavelength"), F.array(F.col("n_regionkey").cast("double"), F.lit(0.25)).alias("flux"))
    N.write_archives(rows, path)
    return R.array_files(spark, path).select("source_id", "wavelength", "flux")


@query("SELECT n_nationkey, n_name AS name FROM nation")
def c3_without_stale(spark, d):
    rows = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_name").alias("name_x"), F.col("n_name").alias("name_y"), F.lit(1).alias("teff_pastel"))
    return R.without(rows, "pastel", "_x", "_y")
