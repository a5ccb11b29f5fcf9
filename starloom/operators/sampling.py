"""Deterministic stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(c: Column) -> Column:
    """A portable hash of a whole number, for a random but repeatable order."""
    return (c * F.lit(2654435761)) % F.lit(4294967296)


def stratified(df: DataFrame, stratum: str, key: str, total: int) -> DataFrame:
    """Of each stratum its share of ``total``: at least one row, at most all, rounded down.

    Ranks are limited while they are computed, so a large stratum sends few rows; the counts are a row for each stratum.
    """
    sizes = df.where(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.count("*").alias("__size"))
    whole = sizes.agg(F.sum("__size").alias("__all"))
    quota = sizes.crossJoin(F.broadcast(whole)).select(stratum, F.least("__size", F.greatest(F.lit(1), F.floor(F.col("__size") * total / F.col("__all")))).alias("__quota"))
    order = Window.partitionBy(stratum).orderBy(draw(F.col(key)), key)
    ranked = df.where(F.col(stratum).isNotNull()).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= total)
    return ranked.join(F.broadcast(quota), stratum).where(F.col("__n") <= F.col("__quota")).drop("__n", "__quota")


def topped_up(sample: DataFrame, df: DataFrame, key: str, total: int) -> DataFrame:
    """The sample with further rows of ``df`` up to ``total``."""
    lacking = max(0, total - sample.count())
    rest = df.join(sample.select(key), key, "left_anti").orderBy(draw(F.col(key)), key).limit(lacking)
    return sample.unionByName(rest)
