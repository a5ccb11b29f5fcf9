"""Joins and set operations."""

from pyspark.sql import functions as F

from starloom.operators import joins as J
from starloom.plans.registry import query
from starloom.sources.bindings import catalogue, read


@query("SELECT o_orderkey AS source_id, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def e1_inner(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("source_id"), "c_nationkey")


@query("SELECT o_orderkey AS source_id, m AS first_part FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS m FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def e2_e3_enriched(spark, d):
    more = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.min("l_partkey").alias("first_part"))
    return J.enriched(read(spark, d, "orders").select(F.col("o_orderkey").alias("source_id")), more)


@query("SELECT l_orderkey AS dr2, dr3, dist FROM (SELECT l_orderkey, l_partkey AS dr3, l_discount AS dist, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_partkey) AS n FROM lineitem WHERE l_discount < 0.05e0) WHERE n = 1")
def e5_g1_nearest_match(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("dr2"), F.col("l_partkey").alias("dr3"), F.col("l_discount").alias("dist"))
    return J.nearest(rows, "dr2", "dist", "dr3", 0.05)


@query("SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey")
def e6_left_other_key(spark, d):
    return read(spark, d, "nation").join(read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "s_suppkey")


_NAMES = "WITH m AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'HD ' || c_custkey WHEN c_custkey % 3 = 1 THEN ' hip  ' || c_custkey || ' ' ELSE 'Star  ' || (c_custkey % 400) END AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS teff, c_nationkey * 1.0e0 AS logg FROM customer), l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'hd   ' || c_custkey || ' x' WHEN c_custkey % 3 = 1 THEN 'HIP ' || c_custkey ELSE 'STAR ' || (c_custkey % 400) END AS main_id FROM customer)"
_KEY = "upper(trim(regexp_replace({}, '\\s+', ' ', 'g')))"
_CAT = "CASE WHEN regexp_matches({0}, '(?i)^(HD|HIP)\\s+(\\d+)') THEN upper(regexp_extract({0}, '(?i)^(HD|HIP)\\s+(\\d+)', 1)) || regexp_extract({0}, '(?i)^(HD|HIP)\\s+(\\d+)', 2) END"


@query(_NAMES + f""", p AS (SELECT {_KEY.format("name")} AS k, median(teff) AS teff, median(logg) AS logg, count(*) AS n FROM m GROUP BY 1),
q AS (SELECT {_CAT.format("name")} AS k, median(teff) AS teff, median(logg) AS logg, count(*) AS n FROM m GROUP BY 1 HAVING k IS NOT NULL)
SELECT id, CASE WHEN f THEN q.teff ELSE p.teff END AS teff, CASE WHEN f THEN q.logg ELSE p.logg END AS logg, CASE WHEN f THEN q.n ELSE p.n END AS n_measurements
FROM l LEFT JOIN p ON {_KEY.format("main_id")} = p.k LEFT JOIN q ON {_CAT.format("trim(main_id)")} = q.k, LATERAL (SELECT p.teff IS NULL AND {_CAT.format("trim(main_id)")} IS NOT NULL AS f)""")
def e7_e9_two_pass_names(spark, d):
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("HD "), k)).when(k % 3 == 1, F.concat(F.lit(" hip  "), k, F.lit(" "))).otherwise(F.concat(F.lit("Star  "), k % 400))
    right = c.select(name.alias("name"), F.when(k % 5 != 0, F.col("c_acctbal")).alias("teff"), F.col("c_nationkey").cast("double").alias("logg"))
    main = F.when(k % 3 == 0, F.concat(F.lit("hd   "), k, F.lit(" x"))).when(k % 3 == 1, F.concat(F.lit("HIP "), k)).otherwise(F.concat(F.lit("STAR "), k % 400))
    left = c.select(k.alias("id"), main.alias("main_id"))
    return J.two_pass(left, right, "main_id", "name", ["teff", "logg"], "teff").select("id", "teff", "logg", "n_measurements")


@query("SELECT c_custkey, n_nationkey FROM customer LEFT JOIN nation ON upper(regexp_replace('n ' || c_nationkey, '\\s+', '', 'g')) = upper(regexp_replace('N' || n_nationkey, '\\s+', '', 'g'))")
def e7_bare_name(spark, d):
    left = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("n "), "c_nationkey").alias("name"))
    right = read(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("other"), "n_nationkey")
    return J.by_bare_name(left, right, "name", "other").select("c_custkey", "n_nationkey")


@query("SELECT o_orderkey AS source_id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS has_lines FROM orders")
def e8_flagged(spark, d):
    ids = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"))
    return J.flagged(read(spark, d, "orders").select(F.col("o_orderkey").alias("source_id")), ids, "has_lines")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def e10_e12_semi(spark, d):
    some = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey").join(some, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def e11_anti(spark, d):
    return read(spark, d, "orders").select("o_orderkey").join(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT source_id, teff_gspphot AS teff, s_acctbal AS truth_teff, s_suppkey IS NOT NULL AS has_truth FROM cat LEFT JOIN supplier ON source_id = s_suppkey")
def e13_corpus_with_truth(spark, d):
    truth = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), F.struct(F.col("s_acctbal").alias("teff")).alias("ground_truth"))
    found = catalogue(spark, d, "source_id", "teff_gspphot").join(truth, "source_id", "left")
    return found.select("source_id", F.col("teff_gspphot").alias("teff"), F.col("ground_truth.teff").alias("truth_teff"), F.col("ground_truth").isNotNull().alias("has_truth"))


@query("SELECT source_id, ruwe, s_name FROM cat JOIN supplier ON source_id = s_suppkey")
def e14_e15_matched(spark, d):
    results = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"), "s_name")
    return catalogue(spark, d, "source_id", "ruwe").join(results, "source_id").select("source_id", "ruwe", "s_name")


@query("SELECT s_suppkey AS source_id, coalesce(ruwe, 0e0) AS ruwe FROM supplier LEFT JOIN cat ON source_id = s_suppkey")
def e16_left_default(spark, d):
    results = read(spark, d, "supplier").select(F.col("s_suppkey").alias("source_id"))
    return results.join(catalogue(spark, d, "source_id", "ruwe"), "source_id", "left").select("source_id", F.coalesce("ruwe", F.lit(0.0)).alias("ruwe"))


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def i3_intersection(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(read(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT event_id, list_sort(list_filter(['k', 'missing', 'x'], lambda x: NOT list_contains(coalesce(json_keys(props), []), x))) AS lacking FROM events")
def i4_missing_keys(spark, d):
    lacking = F.array_except(F.array(F.lit("k"), F.lit("missing"), F.lit("x")), F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")))
    return read(spark, d, "events").select("event_id", F.array_sort(lacking).alias("lacking"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def i5_distinct(spark, d):
    return read(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT l_partkey AS part, median(l_quantity) AS l_quantity, median(l_extendedprice) AS l_extendedprice, count(l_suppkey) AS n_measurements FROM lineitem GROUP BY 1")
def f1_medians(spark, d):
    rows = read(spark, d, "lineitem").withColumnRenamed("l_partkey", "part")
    return J.medians(rows, "part", ["l_quantity", "l_extendedprice"], "l_suppkey")
