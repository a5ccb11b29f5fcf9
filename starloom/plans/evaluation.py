"""Evaluation levels over true and predicted classes."""

from pyspark.sql import functions as F

from starloom.functions import scalar as S
from starloom.operators import anchor as A
from starloom.operators import metrics as M
from starloom.operators import texts as T
from starloom.plans.registry import query
from starloom.plans.stars import anchored
from starloom.sources.bindings import catalogue, read

ORDER = list(A.LETTERS)


def _letter(x: str) -> str:
    return f"CASE WHEN {x} >= 30000 THEN 'O' WHEN {x} >= 10000 THEN 'B' WHEN {x} >= 7500 THEN 'A' WHEN {x} >= 6000 THEN 'F' WHEN {x} >= 5200 THEN 'G' WHEN {x} >= 3700 THEN 'K' ELSE 'M' END"


def pairs(spark, d):
    """Letters of a star and of its shifted temperature."""
    t = F.col("teff_gspphot")
    shifted = t + (F.col("source_id") % 7 - 3) * 150.0
    return catalogue(spark, d, "source_id", "teff_gspphot", "logg_gspphot").where("teff_gspphot is not null").select("source_id", A.letter(t).alias("truth"), A.letter(shifted).alias("predicted"), t.alias("teff"), shifted.alias("guess"), "logg_gspphot")


_PAIRS = f"p AS (SELECT *, {_letter('teff')} AS truth, {_letter('guess')} AS predicted FROM (SELECT source_id, logg_gspphot, teff_gspphot AS teff, teff_gspphot + (source_id % 7 - 3) * 150e0 AS guess FROM cat WHERE teff_gspphot IS NOT NULL))"
_GRID = "g AS (SELECT a.l AS t, b.l AS q, a.i - b.i AS d FROM (VALUES ('O', 1), ('B', 2), ('A', 3), ('F', 4), ('G', 5), ('K', 6), ('M', 7)) AS a(l, i), (VALUES ('O', 1), ('B', 2), ('A', 3), ('F', 4), ('G', 5), ('K', 6), ('M', 7)) AS b(l, i)), m AS (SELECT t, q, abs(d) AS d, count(source_id) AS n FROM g LEFT JOIN p ON truth = t AND predicted = q GROUP BY ALL), c AS (SELECT t AS label, sum(n) AS support, sum(n) FILTER (WHERE t = q) AS hits, (SELECT sum(n) FROM m AS o WHERE o.q = m.t) AS predicted FROM m GROUP BY t)"


@query(f"WITH {_PAIRS}, {_GRID} SELECT t AS truth_label, q AS predicted_label, n FROM m")
def f21_confusion(spark, d):
    return M.confusion(pairs(spark, d), "truth", "predicted", ORDER)


@query(f"WITH {_PAIRS}, {_GRID} SELECT label, CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits, CAST(predicted AS BIGINT) AS predicted, hits / support AS recall, hits / predicted AS \"precision\", 2e0 * hits / (support + predicted) AS f1 FROM c")
def f22_f25_per_class(spark, d):
    return M.per_class(M.confusion(pairs(spark, d), "truth", "predicted", ORDER))


@query(f"""WITH {_PAIRS}, {_GRID}, s AS (SELECT CAST(sum(support) AS DOUBLE) AS n, sum(hits) / sum(support) AS acc, avg(2e0 * hits / (support + predicted)) AS macro, sum(support * 2e0 * hits / (support + predicted)) / sum(support) AS weighted, sum(CAST(support AS DOUBLE) * predicted) / (sum(support) * CAST(sum(support) AS DOUBLE)) AS e FROM c)
SELECT CAST(n AS BIGINT) AS n, acc AS accuracy, macro AS macro_f1, weighted AS weighted_f1, (acc - e) / (1 - e) AS kappa, (SELECT sum(d * n) / sum(n) FROM m) AS mean_distance, (SELECT sum(n) FILTER (WHERE d <= 1) / sum(n) FROM m) AS near_miss FROM s""")
def f22_f24_agreement(spark, d):
    return M.agreement(M.confusion(pairs(spark, d), "truth", "predicted", ORDER), ORDER)


@query(f"WITH {_PAIRS} SELECT round(sum(abs(teff - guess) * (1 + source_id % 3)) / sum(1 + source_id % 3), 6) AS teff_error, round(sum(abs(logg_gspphot - 4.0e0) * (1 + source_id % 3)) / sum(1 + source_id % 3) FILTER (WHERE logg_gspphot IS NOT NULL), 6) AS logg_error FROM p")
def f26_weighted_errors(spark, d):
    w = 1 + F.col("source_id") % 3
    teff, logg = M.weighted_error(F.col("guess"), F.col("teff"), w), M.weighted_error(F.col("logg_gspphot"), F.lit(4.0), w)
    return pairs(spark, d).agg(F.round(teff, 6).alias("teff_error"), F.round(logg, 6).alias("logg_error"))


_LEVELS = " ".join(f"WHEN u < {level!r}::DOUBLE THEN {k}" for k, level in enumerate(M.poisson_levels()))
_DRAWN = f"""x0 AS (SELECT p.*, r, (source_id % {M.PRIME} * 48271 + r * 69621 + 42) % {M.PRIME} AS x FROM p, range(1000) AS rounds(r)),
x1 AS (SELECT * REPLACE ((x * x + 12345) % {M.PRIME} AS x) FROM x0), x2 AS (SELECT * REPLACE ((x * x + r) % {M.PRIME} AS x) FROM x1),
xu AS (SELECT *, (x * 16807 % {M.PRIME}) / {M.PRIME}::DOUBLE AS u FROM x2), xw AS (SELECT *, CASE {_LEVELS} ELSE 12 END AS w FROM xu)"""


@query(f"""WITH {_PAIRS}, {_DRAWN}, m AS (SELECT r, sum(w * (truth = predicted)::INT)::DOUBLE / sum(w) AS m FROM xw GROUP BY r)
SELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m""")
def f27_bootstrap(spark, d):
    rows = pairs(spark, d).withColumn("hit", (F.col("truth") == F.col("predicted")).cast("double"))
    return M.bootstrap(rows, "source_id", "hit").select(F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query(f"""WITH {_PAIRS}, {_DRAWN}, v AS (SELECT *, (truth = predicted)::INT AS a, (abs(teff - guess) <= 200)::INT AS b FROM xw),
m AS (SELECT r, sum(w * a)::DOUBLE / sum(w) AS a, sum(w * b)::DOUBLE / sum(w) AS b FROM v GROUP BY r),
e AS (SELECT quantile_cont(a, [0.025, 0.975]) AS a, quantile_cont(b, [0.025, 0.975]) AS b, quantile_cont(a - b, [0.025, 0.975]) AS d, avg((a - b <= 0)::INT) AS o FROM m),
t AS (SELECT count(*) AS n, avg((truth = predicted)::INT) AS a, avg((abs(teff - guess) <= 200)::INT) AS b FROM p)
SELECT t.n, round(t.a, 9) AS a_mean, round(t.b, 9) AS b_mean, round(t.a - t.b, 9) AS delta_mean, round(e.a[1], 9) AS a_low, round(e.a[2], 9) AS a_high, round(e.b[1], 9) AS b_low, round(e.b[2], 9) AS b_high, round(e.d[1], 9) AS delta_low, round(e.d[2], 9) AS delta_high, round(o, 9) AS not_ahead FROM e, t""")
def f27_paired_bootstrap(spark, d):
    rows = pairs(spark, d).select("source_id", (F.col("truth") == F.col("predicted")).cast("int").alias("letter_right"), (F.abs(F.col("teff") - F.col("guess")) <= 200).cast("int").alias("teff_near"))
    found = M.paired_bootstrap(rows, "source_id", "letter_right", "teff_near")
    return found.select("n", *[F.round(c, 9).alias(c) for c in found.columns if c != "n"])


def p_sql(source: str) -> str:
    """CTE ``pv`` (n, rho, p) from CTE ``source`` (n, rho): the continued fraction of the incomplete beta function, step by step."""
    return f"""ps AS (SELECT n, rho, 1 - rho * rho > ((n - 2) / 2e0 + 1) / ((n - 2) / 2e0 + 2.5e0) AS turned, (n - 2) / 2e0 AS h, 1 - rho * rho AS z FROM {source}),
pa AS (SELECT *, CASE WHEN turned THEN 0.5e0 ELSE h END AS a, CASE WHEN turned THEN h ELSE 0.5e0 END AS b, CASE WHEN turned THEN 1 - z ELSE z END AS x FROM ps),
cf AS (SELECT -1 AS k, *, 1e0 AS f, 1e0 AS c, 0e0 AS d FROM pa UNION ALL
  SELECT k + 1, n, rho, turned, h, z, a, b, x, f * (1 + t / c) / (1 + t * d), 1 + t / c, 1 / (1 + t * d) FROM (SELECT *, CASE WHEN k = -1 THEN 1e0
    WHEN k % 2 = 1 THEN ((k + 1) // 2) * (b - (k + 1) // 2) * x / ((a + 2 * ((k + 1) // 2) - 1) * (a + 2 * ((k + 1) // 2)))
    ELSE -(a + k // 2) * (a + b + k // 2) * x / ((a + 2 * (k // 2)) * (a + 2 * (k // 2) + 1)) END AS t FROM cf WHERE k < 300)),
pv AS (SELECT n, rho, CASE WHEN n < 3 THEN NULL WHEN abs(rho) >= 1 THEN 0e0 WHEN rho = 0 THEN 1e0 WHEN turned THEN 1 - q ELSE q END AS p FROM (SELECT *, exp(a * ln(x) + b * ln(1 - x) - ln(a) - lgamma(a) - lgamma(b) + lgamma(a + b)) * (f - 1) AS q FROM cf WHERE k = 300))"""


@query(f"""WITH RECURSIVE sp AS (SELECT count(*) AS n, corr(a, b) AS rho FROM (SELECT rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2e0 AS a, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2e0 AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL)),
{p_sql('sp')} SELECT n, round(rho, 9) AS rho, round(p, 9) AS p FROM pv""")
def f28_spearman(spark, d):
    rows = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.spearman(rows, "quality", "n_chars").select("n", F.round("rho", 9).alias("rho"), F.round("p", 9).alias("p"))


@query(f"WITH {_PAIRS} SELECT avg(source_id % 100 / 100e0) FILTER (WHERE truth = predicted) AS mean_correct, avg(source_id % 100 / 100e0) FILTER (WHERE truth <> predicted) AS mean_wrong, avg(source_id % 100 / 100e0) FILTER (WHERE truth = predicted) - avg(source_id % 100 / 100e0) FILTER (WHERE truth <> predicted) AS delta FROM p")
def f29_calibration(spark, d):
    c, hit = F.col("source_id") % 100 / F.lit(100.0), F.col("truth") == F.col("predicted")
    good, bad = F.avg(F.when(hit, c)), F.avg(F.when(~hit, c))
    return pairs(spark, d).agg(good.alias("mean_correct"), bad.alias("mean_wrong"), (good - bad).alias("delta"))


@query("SELECT lang, avg(n_chars) AS mean_score, round(stddev_pop(n_chars), 6) AS deviation, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang")
def f30_score_spread(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.avg("n_chars").alias("mean_score"), F.round(F.stddev_pop("n_chars"), 6).alias("deviation"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


_SUB = f"CASE {{0}} " + " ".join("WHEN '" + k + "' THEN CASE " + " ".join(f"WHEN {{1}} >= {int(a)} AND {{1}} < {int(min(b, 10**9))} THEN '{label}'" for a, b, label in bins) + " END" for k, bins in A.SUBTYPES.items()) + " END"


@query(f"WITH {_PAIRS} SELECT truth, count(*) AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS accuracy FROM (SELECT truth, {_SUB.format('truth', 'teff')} AS a, {_SUB.format('truth', 'guess')} AS b FROM p WHERE truth = predicted) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY truth")
def f32_o7_subtypes(spark, d):
    rows = pairs(spark, d).where("truth = predicted").select("truth", A.subtype(F.col("truth"), F.col("teff")).alias("a"), A.subtype(F.col("truth"), F.col("guess")).alias("b")).dropna()
    return rows.groupBy("truth").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("accuracy"))


@query("SELECT count(*) AS n, avg((a1 = 'A')::INT) AS by_rule, avg((teff_k >= 10000)::INT) AS by_teff, avg((logg >= 3.8e0)::INT) AS by_logg, avg(logg) FILTER (WHERE a1 = 'A') AS logg_right FROM (SELECT *, mk_letter AS a1 FROM co WHERE teff_k >= 9700 AND teff_k < 10100 AND logg IS NOT NULL)")
def f34_o9_boundary_strategies(spark, d):
    rows = A.corrected(anchored(spark, d)).where("teff_k >= 9700 and teff_k < 10100 and logg is not null")
    rule = F.col("mk_letter") == "A"
    share = lambda c: F.avg(c.cast("int"))
    return rows.agg(F.count("*").alias("n"), share(rule).alias("by_rule"), share(F.col("teff_k") >= 10000).alias("by_teff"), share(F.col("logg") >= 3.8).alias("by_logg"), F.avg(F.when(rule, F.col("logg"))).alias("logg_right"))


@query("SELECT true_population, population_group, count(*) AS n FROM (SELECT *, CASE WHEN metallicity < -1.0e0 THEN 'Halo' WHEN metallicity < -0.2e0 THEN 'Thick Disk' ELSE 'Thin Disk' END AS true_population FROM co) GROUP BY ALL")
def o2_population_truth(spark, d):
    m = F.col("metallicity")
    truth = F.when(m < -1.0, "Halo").when(m < -0.2, "Thick Disk").otherwise("Thin Disk")
    return A.corrected(anchored(spark, d)).groupBy(truth.alias("true_population"), "population_group").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, nullif(regexp_extract(trim(t), '^([OBAFGKM])', 1), '') AS letter, CASE WHEN length(x) > 2 THEN 'I' ELSE nullif(x, '') END AS legacy_class FROM (SELECT *, regexp_extract(t, '\\b(I{1,3}V?|IV|V)\\b', 1) AS x FROM (SELECT c_custkey, substr('OBAFGKMX', 1 + c_custkey % 8, 1) || (c_custkey % 10) || CASE c_custkey % 6 WHEN 0 THEN 'V' WHEN 1 THEN ' III' WHEN 2 THEN ' IV' WHEN 3 THEN 'IV-V' WHEN 4 THEN ' II' ELSE '' END AS t FROM customer))")
def o11_truth_extraction(spark, d):
    k = F.col("c_custkey")
    tail = F.when(k % 6 == 0, "V").when(k % 6 == 1, " III").when(k % 6 == 2, " IV").when(k % 6 == 3, "IV-V").when(k % 6 == 4, " II").otherwise("")
    t = F.concat(F.substring(F.lit("OBAFGKMX"), 1 + k.cast("int") % 8, F.lit(1)), (k % 10).cast("string"), tail)
    return read(spark, d, "customer").select("c_custkey", S.spectral_letter(t).alias("letter"), S.luminosity_numeral(t).alias("legacy_class"))


_MENTION = "len(list_filter(list_transform(regexp_extract_all(text, '-?\\d+\\.?\\d*'), lambda x: TRY_CAST(x AS DOUBLE)), lambda n: abs(n - {0}) / (abs({0}) + 1e-6) <= {1} OR abs(n - {0}) <= 1)) > 0"


@query(f"SELECT doc_id, (a <> 0)::INT + (b <> 0)::INT AS checks_total, (a <> 0 AND {_MENTION.format('a', '0.02e0')})::INT + (b <> 0 AND {_MENTION.format('b', '0.05e0')})::INT AS checks_passed FROM (SELECT doc_id, text, doc_id % 2000 * 1e0 AS a, doc_id % 7 * 1e0 AS b FROM documents)")
def o6_coherence(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 2000).cast("double").alias("a"), (F.col("doc_id") % 7).cast("double").alias("b"))
    return T.coherence(docs, "text", {"a": 0.02, "b": 0.05}).select("doc_id", "checks_total", "checks_passed")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) > 60 AS too_long FROM documents")
def f31_word_limits(spark, d):
    docs = read(spark, d, "documents").withColumn("physical_profile", F.col("text"))
    return T.over_limits(docs, {"physical_profile": 60}).select("doc_id", (F.size("limit_violations") > 0).alias("too_long"))


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


@query(f"""WITH t AS (SELECT item_id, {_TOKENS.format('b.text')} AS r, {_TOKENS.format("array_to_string(string_split(b.text, ' ')[3:], ' ') || ' tail'")} AS h FROM benchmark b),
w AS (SELECT item_id, w, max(a) AS a, max(b) AS b FROM (SELECT item_id, w, count(*) AS a, 0 AS b FROM t, unnest(r) AS u(w) GROUP BY ALL UNION ALL SELECT item_id, w, 0, count(*) FROM t, unnest(h) AS u(w) GROUP BY ALL) GROUP BY ALL)
SELECT item_id, coalesce(sum(least(a, b)), 0) / max(len(h)) AS rouge1_p, coalesce(sum(least(a, b)), 0) / max(len(r)) AS rouge1_r FROM t JOIN w USING (item_id) GROUP BY item_id""")
def o4_rouge1(spark, d):
    rows = read(spark, d, "benchmark").withColumn("other", F.concat(F.array_join(F.slice(F.split("text", " "), 3, 100000), " "), F.lit(" tail")))
    return T.rouge(rows, "text", "other", stems=False).select("item_id", "rouge1_p", "rouge1_r")


@query()
def o4_rouge_stemmed(spark, d):
    rows = read(spark, d, "benchmark").withColumn("other", F.concat(F.array_join(F.slice(F.split("text", " "), 3, 100000), " "), F.lit(" tail")))
    return T.rouge(rows, "text", "other").select("item_id", "rouge1_f", "rougel_f")
