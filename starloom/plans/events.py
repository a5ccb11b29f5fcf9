"""Event-time windows and incremental runs, an extension beyond batch catalogues."""

from pyspark.sql import functions as F

from starloom.operators import rules as L
from starloom.plans.registry import query
from starloom.sources.bindings import catalogue, read
from starloom.sources.scratch import fresh
from starloom.streaming import incremental as I


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def p_tumbling(spark, d):
    return I.tumbling(read(spark, d, "events")).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, CAST(min(ts) AS VARCHAR)[:19] AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def p_sessions(spark, d):
    return I.sessions(read(spark, d, "events")).select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("SELECT source_id, is_giant FROM hc")
def n13_streamed_contracts(spark, d):
    """The catalogue arrives as files; a stream judges what is new and appends it."""
    arriving, out = fresh(spark, "arriving"), fresh(spark, "judged")
    stars = catalogue(spark, d)
    stars.write.parquet(arriving)
    stream = I.source(spark, arriving, stars.schema)
    I.appended(stream, lambda b: L.judged(b).select("source_id", "is_giant"), "source_id", out, fresh(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("source_id bigint, is_giant boolean, batch int").parquet(out).select("source_id", "is_giant")
