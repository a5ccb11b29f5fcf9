"""Versions of text vectors in a folder, with a manifest that says what they were made from."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.retrieval import embedded, text_digest
from starloom.sources.claims import point, pointed, removed, there

MANIFEST = "manifest.json"


def content_digest(texts: DataFrame, key: str, text: str) -> tuple[int, str]:
    """Rows, and a digest of all keys and texts that does not depend on their order."""
    own = F.xxhash64(F.col(key), text_digest(F.col(text)))
    found = texts.agg(F.count("*").alias("n"), F.bit_xor(own).alias("x"), F.sum(F.pmod(own, F.lit(1 << 31))).alias("s")).first()
    return found.n, f"{found.x or 0:x}.{found.s or 0:x}"


def versioned_vectors(texts: DataFrame, folder: str, encoder: str, dimensions: int, encode: Callable, key: str = "source_id", text: str = "query") -> tuple[DataFrame, str]:
    """(key, digest, vector, from_cache) of all ``texts``, and why they were had: cached, stale, dimension, encoder or missing.

    The manifest of the folder names the version in force, its encoder, dimensions and the digest of its texts. Where all agree
    its vectors are read. Where only texts have changed (``stale``) the rows whose own text has not keep their vector; else all
    are made anew. A new version is written beside the old, then the manifest is switched at once, and versions before the last
    are deleted. Texts without words have zero vectors, which stay in their places. NULL texts count as empty; keys are taken to be
    unique.
    """
    spark, place = texts.sparkSession, f"{folder}/{MANIFEST}"
    rows, digest = content_digest(texts, key, text)
    held = json.loads(pointed(spark, place) or "null")
    if held is None or not there(spark, f"{folder}/{held['version']}/_SUCCESS"):
        why = "missing"
    elif held["encoder"] != encoder:
        why = "encoder"
    elif held["dimensions"] != dimensions:
        why = "dimension"
    else:
        why = "cached" if (held["rows"], held["digest"]) == (rows, digest) else "stale"
    if why == "cached":
        return spark.read.parquet(f"{folder}/{held['version']}").select(key, "digest", "vector", F.lit(True).alias("from_cache")), why
    wanted = texts.select(key, F.col(text).alias("__text"), text_digest(F.col(text)).alias("digest"))
    if why == "stale":
        old = spark.read.parquet(f"{folder}/{held['version']}").select(key, F.col("digest").alias("__digest"), F.col("vector").alias("__vector"))
        wanted = wanted.join(old, key, "left")
        same = F.coalesce(F.col("digest") == F.col("__digest"), F.lit(False))
    else:
        wanted, same = wanted.withColumn("__vector", F.lit(None).cast("array<float>")), F.lit(False)
    kept = wanted.where(same).select(key, "digest", F.col("__vector").alias("vector"), F.lit(True).alias("from_cache"))
    made = embedded(wanted.where(~same), "__text", "vector", encode).select(key, "digest", "vector", F.lit(False).alias("from_cache"))
    version = f"v-{uuid.uuid4().hex}"
    kept.unionByName(made).write.partitionBy("from_cache").parquet(f"{folder}/{version}")
    point(spark, place, json.dumps({"version": version, "encoder": encoder, "dimensions": dimensions, "rows": rows, "digest": digest, "before": held and held["version"]}))
    if held and held.get("before"):
        removed(spark, f"{folder}/{held['before']}")  # readers of the version before this one may still be at work
    return spark.read.parquet(f"{folder}/{version}").select(key, "digest", "vector", "from_cache"), why
