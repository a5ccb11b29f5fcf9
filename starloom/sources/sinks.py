"""Writers."""

from __future__ import annotations

import datetime
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.scalar import sanitized
from starloom.sources.readers import listed


def csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    """A document a line, NULL fields written out."""
    df.write.option("ignoreNullFields", False).json(path)


def strict_json(df: DataFrame, path: str) -> None:
    """As json_lines, after NaN and infinities have become NULL."""
    json_lines(sanitized(df), path)


def json_arrays(df: DataFrame, path: str) -> None:
    """Files that are a JSON array of documents each, NULL fields written out; NaN and infinities become NULL."""
    rows = sanitized(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches):
        last = None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(["[" if last is None else last + ","])], ["value"])
                last = text
        yield pa.RecordBatch.from_arrays([pa.array(["[]"] if last is None else [last, "]"])], ["value"])

    rows.mapInArrow(run, "value string").write.text(path)


def numbered_folder(spark: SparkSession, folder: str, day: datetime.date | None = None) -> str:
    """The next folder DB-N-date."""
    found = [int(m[1]) for name in listed(spark, folder) if (m := re.match(r"^DB-(\d+)-", name))]
    return f"{folder}/DB-{max(found, default=0) + 1}-{(day or datetime.date.today()).isoformat()}"


def manifest(df: DataFrame, category: str, **parameters) -> DataFrame:
    """One row: n_rows, the counts of each category and the NULL percent of each column with any, as JSON, and the parameters."""
    counts = df.groupBy(category).count().agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(category, "count"))))).alias("categories"))
    nulls = df.agg(F.count("*").alias("n_rows"), F.to_json(F.struct(*[F.round(F.avg(F.col(c).isNull().cast("int")) * 100, 4).alias(c) for c in df.columns])).alias("null_percent"))
    return nulls.crossJoin(counts).withColumn("parameters", F.lit(json.dumps(parameters, sort_keys=True)))


def batches(df: DataFrame, folder: str, batch: str = "batch_no") -> None:
    """Done and failed rows of each batch under folders of their own."""
    df.withColumn("state", F.when(F.col("error").isNull(), "done").otherwise("failed")).write.mode("append").partitionBy("state", batch).json(folder)


def consolidated(spark: SparkSession, folder: str, schema: str, state: str = "done") -> DataFrame:
    return spark.read.schema(schema + ", state string, batch_no int").json(folder).where(F.col("state") == state).drop("state")
