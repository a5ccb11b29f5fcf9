"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a batch holds a few MB even where texts are long.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20
#: A join key with more rows than both HOT_ROWS and one in MOST_HOT is dealt to several tasks.
HOT_ROWS, MOST_HOT = 4096, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers get, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; one of our own only where it is unset and all run on one machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="starloom-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that shuffle files go when the query that wrote them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back. Later queries start from it, so the shuffle files of this one go at its end."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    return written(df, fresh_path(df.sparkSession, name))


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete intermediate tables in the shared folder."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


class Scratch:
    """Intermediate tables of one run in the shared folder; ``release`` deletes some, ``drop`` all of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.paths = spark, fresh_path(spark, name), []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{len(self.paths) + 1}"
        found = written(df, path)
        self.paths.append((found, path))
        return found

    def release(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read any more."""
        forget(self.spark, *[path for held, path in self.paths if any(held is t for t in tables)])

    def drop(self) -> None:
        forget(self.spark, self.path)


def spread_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", by: str | None = None, total: int | None = None) -> DataFrame:
    """``big`` joined with ``small`` on ``key``, hot keys of ``big`` dealt to several tasks.

    A key is hot with more than max(HOT_ROWS, rows / MOST_HOT) rows, so there are fewer than
    MOST_HOT of them whatever the size, and only these reach the driver; rows of ``small`` with such a key are
    repeated for each of its salts. ``big`` has to be a stored table, whose row numbers are the
    salts, unless ``by`` names a column that tells the rows of a key apart. ``total``: rows of
    ``big``, where known.
    """
    total = big.count() if total is None else total
    limit = max(HOT_ROWS, total // MOST_HOT)
    if total <= limit:
        return big.join(small, key, how)
    hot = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    hot = hot.select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__salts"))
    found = hot.collect()
    if not found:
        return big.join(small, key, how)
    hot = F.broadcast(big.sparkSession.createDataFrame(found, hot.schema))
    salts = F.coalesce("__salts", F.lit(1))
    row = F.xxhash64(by) if by else F.monotonically_increasing_id()
    dealt = big.withColumn("__row", row).join(hot, key, "left").withColumn("__salt", F.pmod("__row", salts).cast("int")).drop("__salts", "__row")
    copied = small.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(copied, [key, "__salt"], how).drop("__salt")


def text_bytes(column: str = "text") -> Column:
    """A whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def held_out(modulus: int, column: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod modulus is 1; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == 1, F.lit(False))


def tokenizer_path(name: str) -> str:
    """Default place of a public tokenizer's file; operators take another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, modulus: int = 3) -> DataFrame:
    """text (bytes) and quality of at most ``most`` labelled rows, for fitting a model.

    The documents with the smallest hash of doc_id are taken, none with crc32(doc_id) mod
    ``modulus`` = 1. Labels that are null or neither 0 nor 1 are left out, and so are doc_ids
    labelled both ways. A text that stands several times under one doc_id is one row; of several
    texts under one doc_id that with the smallest hash is taken, so ``most`` bounds the rows.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(modulus))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("top")).where("quality = top")
    drawn = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(F.broadcast(drawn), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "quality")).alias("one")
    return texts.groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.quality")
