"""Attempts as streaming state: every key is judged once for each rung, whatever is delivered again.

Rows arrive as files of an inbox. A stateful operator keeps which attempts each key has had, across micro-batches and runs, and
lets a row pass only once with each number of attempts: a key that comes again in a later file, or
twice in one, is not judged again. The first attempt uses the full prompt, later ones the reduced prompt. Answers that hold go
to ``results``; those that do not go to ``again``, a second folder that the stream reads, and come back with their number; after the last
attempt they go to ``failed``. Every folder is written by number of the micro-batch, so one that is run again replaces itself.

What lies on disk at once: the inbox, the three folders, the state, and the answers of one micro-batch, which go when they are dealt to the folders. A task
closes its part of the state when it is done with it, else every run would leave its own local copy open, of some megabytes however few its keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from starloom.operators import inference as I
from starloom.sources.claims import removed

TRIES = 3
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def counted(stream: DataFrame, key: str, most: int = TRIES) -> DataFrame:
    """Rows of a stream (with a column ``attempts``: how many were had before) that are due, ``attempts`` counting this one.

    The state holds every key with each number of attempts that it has come with, and lets each pass once. Spark keeps it without
    a call to Python for each key.
    """
    due = stream.where(F.col("attempts") < most).dropDuplicates([key, "attempts"])
    return due.withColumn("attempts", F.col("attempts") + 1).select(*stream.columns)


def judged(batch: DataFrame, key: str, generate: Callable[[pd.DataFrame], list[str]] = I.rule_generator) -> DataFrame:
    """attempts, raw, error, result, errors, is_valid of every row; whole Arrow batches go to the generator.

    The generator gets a column ``text``: the full prompt at the first attempt, the reduced one later. What it raises is
    the error of its rows.
    """
    rows = batch.withColumn("text", F.when(F.col("attempts") > 1, F.col("reduced")).otherwise(F.col("prompt")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in batches:
            try:
                raw, error = list(generate(own)), [None] * len(own)
            except Exception as failure:  # the generator is user code; its failure belongs to its rows
                raw, error = [None] * len(own), [str(failure)[-500:]] * len(own)
            yield own.drop(columns="text").assign(raw=raw, error=error)

    shape = StructType(list(batch.schema.fields)).add("raw", StringType()).add("error", StringType())
    return I.validated(I.parsed(rows.mapInPandas(run, shape)))


def run_ladder(spark: SparkSession, inbox: str, folder: str, checkpoint: str, schema: StructType, key: str = "source_id", generate: Callable[[pd.DataFrame], list[str]] = I.rule_generator, tries: int = TRIES) -> None:
    """Judge what is in the inbox and not judged yet, until every row has an answer or ``tries`` attempts.

    ``schema`` has the key, prompt, reduced and what the generator reads. Results, failed rows (with the end of the last answer)
    and rows to be tried again lie under ``folder``. A later call goes on where this one, or one that broke off, ended.
    """
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        _run(spark, inbox, folder, checkpoint, schema, key, generate, tries)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _run(spark: SparkSession, inbox: str, folder: str, checkpoint: str, schema: StructType, key: str, generate: Callable[[pd.DataFrame], list[str]], tries: int, files: int = 100) -> None:
    full = StructType(list(schema.fields)).add("attempts", IntegerType())
    again = f"{folder}/again"
    spark.createDataFrame([], full).write.mode("append").parquet(f"{again}/batch=-1")  # the folder is there before it is read

    def write(batch: DataFrame, number: int) -> None:
        keep = lambda rows, name: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        answers = f"{folder}/judged/batch={number}"
        rows, retried = judged(batch, key, generate), ~F.col("is_valid") & (F.col("attempts") < tries)
        again_only = [c for c in full.names if c not in (key, "attempts")]
        rows = rows.withColumns({c: F.when(retried, F.col(c)) for c in again_only})  # only rows that come again need what the generator reads
        rows.write.mode("overwrite").parquet(answers)  # answers are had once: the three parts read what was written
        found = spark.read.schema(rows.schema).parquet(answers)
        valid, last = F.col("is_valid"), F.coalesce("error", "raw")
        keep(found.where(valid).select(key, "attempts", "raw", "result"), "results")
        reason = F.format_string("Failed after %d attempts.", "attempts")
        keep(found.where(~valid & (F.col("attempts") >= tries)).select(key, "attempts", reason.alias("reason"), F.substring(last, 1, 500).alias("last_raw"), "errors"), "failed")
        keep(found.where(retried).select(*full.names), "again")
        removed(spark, answers)

    for _ in range(tries):
        read = lambda path: spark.readStream.schema(full).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(path)
        new = read(inbox).withColumn("attempts", F.lit(0))
        rows = new.unionByName(read(again))
        counted(rows, key, tries).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
