"""Round trips through every file format: written to the shared folder, read back."""

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.plans.registry import query
from starloom.sources import claims as C
from starloom.sources import readers as R
from starloom.sources import sinks as W
from starloom.sources.bindings import catalogue, read
from starloom.sources.scratch import fresh


@query("""SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'FLOAT[]' THEN 'array<float>' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower(column_type) END AS data_type
FROM (FROM (DESCRIBE orders) UNION ALL FROM (DESCRIBE documents) UNION ALL FROM (DESCRIBE embeddings))""")
def a3_columns_and_types(spark, d):
    found = [R.columns_of(read(spark, d, t)) for t in ("orders", "documents", "embeddings")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("SELECT column_name FROM (DESCRIBE orders)")
def a3_columns(spark, d):
    return R.columns_of(read(spark, d, "orders")).select("column_name")


@query("SELECT o_orderkey AS source_id, c_acctbal AS flux FROM orders LEFT JOIN customer ON o_orderkey = c_custkey")
def a7_requested(spark, d):
    ids = read(spark, d, "orders").select(F.col("o_orderkey").alias("source_id"))
    return R.requested(ids, read(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_acctbal").alias("flux")))


@query("SELECT vec_id AS source_id FROM embeddings WHERE embedding IS NOT NULL")
def a14_spectra_present(spark, d):
    return R.spectra_present(read(spark, d, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("flux")))


@query("SELECT source_id, teff_gspphot, CASE WHEN lower(trim(nss_solution_type)) NOT IN ('', 'nan', 'none', 'null') THEN trim(nss_solution_type) END AS nss_solution_type FROM cat")
def a9_b1_csv(spark, d):
    path = fresh(spark, "csv")
    W.csv(catalogue(spark, d, "source_id", "teff_gspphot", "nss_solution_type"), path)
    rows = R.csv(spark, path, "source_id bigint, teff_gspphot double, nss_solution_type string")
    return R.cleaned(rows, "nss_solution_type").withColumn("nss_solution_type", F.trim("nss_solution_type"))


@query("SELECT c_custkey AS id FROM customer")
def a10_id_list(spark, d):
    path = fresh(spark, "ids")
    W.csv(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), path)
    return R.id_list(spark, path, "id")


@query("SELECT c_name AS name, CAST(c_nationkey AS DOUBLE) AS teff, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS bibcode FROM customer")
def a11_fixed_width(spark, d):
    path = fresh(spark, "fixed")
    line = F.concat(F.rpad("c_name", 34, " "), F.lpad(F.col("c_nationkey").cast("string"), 6, " "), F.when(F.col("c_custkey") % 4 == 0, F.lit("          ")).otherwise(F.rpad("c_mktsegment", 10, " ")))
    read(spark, d, "customer").select(line.alias("value")).write.option("compression", "gzip").text(path)
    return R.fixed_width(spark, path, {"name": (0, 34), "teff": (34, 40), "bibcode": (40, 50)})


def _documents(spark, d):
    return catalogue(spark, d, "source_id", "teff_gspphot").select("source_id", F.col("teff_gspphot").alias("teff"))


@query("SELECT source_id, teff_gspphot AS teff FROM cat")
def a12_b3_json(spark, d):
    path = fresh(spark, "json")
    W.strict_json(_documents(spark, d), path)
    return spark.read.schema("source_id bigint, teff double").json(path)


@query("SELECT r_regionkey AS source_id, r_regionkey * 1.5e0 AS teff FROM region")
def a12_json_array(spark, d):
    path = fresh(spark, "array")
    rows = read(spark, d, "region").agg(F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("source_id"), (F.col("r_regionkey") * F.lit(1.5)).alias("teff")))).alias("value"))
    rows.coalesce(1).write.text(path)
    return R.json_array(spark, path, "source_id bigint, teff double")


@query("SELECT r_regionkey AS source_id, r_regionkey * 1.5e0 AS teff FROM region")
def a13_wrapped_json(spark, d):
    path = fresh(spark, "wrapped")
    rows = read(spark, d, "region").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("r_regionkey").alias("source_id"), (F.col("r_regionkey") * F.lit(1.5)).alias("teff"))).alias("contracts"))).alias("value"))
    rows.coalesce(1).write.text(path)
    return R.wrapped_json(spark, path, "source_id bigint, teff double")


@query("SELECT n_nationkey, n_name FROM nation")
def b2_parquet(spark, d):
    path = fresh(spark, "parquet")
    W.parquet(read(spark, d, "nation"), path, "n_regionkey")
    return R.parquet(spark, path, ["n_nationkey", "n_name"])


@query("SELECT source_id, CAST(source_id // 5000 AS INTEGER) AS batch_no FROM cat WHERE source_id % 10 <> 0")
def a17_b8_batches(spark, d):
    path = fresh(spark, "batches")
    rows = catalogue(spark, d, "source_id").withColumns({"batch_no": F.floor(F.col("source_id") / 5000).cast("int"), "error": F.when(F.col("source_id") % 10 == 0, "failed")})
    W.batches(rows, path)
    return W.consolidated(spark, path, "source_id bigint, error string").select("source_id", "batch_no")


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN teff_gspphot < 4000 THEN 'cool' ELSE 'other' END AS category FROM cat) GROUP BY 1")
def b6_manifest_counts(spark, d):
    rows = catalogue(spark, d, "source_id", "teff_gspphot").withColumn("category", F.when(F.col("teff_gspphot") < 4000, "cool").otherwise("other"))
    one = W.manifest(rows, "category", seed=42).select(F.from_json("categories", "map<string, bigint>").alias("m"))
    return one.select(F.explode("m").alias("category", "n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, regexp_replace(text, '[\\t\\n\\r]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL")
def a16_whole_texts(spark, d):
    path = fresh(spark, "texts")
    rows = read(spark, d, "documents").where("text IS NOT NULL")
    rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.regexp_replace("text", r"[\t\n\r]", " ")).alias("value")).write.text(path)
    line = R.whole_texts(spark, path).select(F.explode(F.filter(F.split("text", "\n"), lambda x: x != "")).alias("line"))
    return line.select(F.substring_index("line", "\t", 1).alias("doc_id"), F.split("line", "\t")[1].alias("text"))


@query("SELECT unnest([1, 2, 3, 10, 11]) AS batch_no, unnest([1, 2, 3, 4, 5]) AS place, (SELECT count(*) FROM nation) AS n, unnest(['DB-2', 'DB-2', 'DB-2', 'DB-2', 'DB-2']) AS folder")
def b7_a17_a18_claimed_folders(spark, d):
    """Two folders claimed, numbered batch files in the second, read back from the latest in the order of their numbers."""
    root, day = fresh(spark, "runs"), datetime.date(2024, 1, 31)
    first, second = C.claimed_folder(spark, root, day), C.claimed_folder(spark, root, day)
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"))
    for folder, numbers in ((first, [7]), (second, [10, 2, 11, 1, 3])):
        for k in numbers:
            W.json_arrays(rows.coalesce(1), f"{folder}/batch_results_{k}.json")
    found = R.batch_files(spark, R.latest(spark, root), "source_id bigint", r"batch_[^/]*?_?(\d+)\.json").groupBy("batch_no").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy("batch_no")).cast("int")  # five files
    return found.select("batch_no", place.alias("place"), "n", F.lit("/".join(second.rsplit("/")[-1:])[:4]).alias("folder"))
