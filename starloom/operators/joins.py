"""Cross-catalogue joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scalar import catalogue_key, no_blank, one_blank


def nearest(df: DataFrame, key: str, distance: str, other: str, within: float) -> DataFrame:
    """The nearest match of each key below ``within``; ties go to the smaller ``other``."""
    order = Window.partitionBy(key).orderBy(distance, other)
    return df.where(F.col(distance) < within).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def enriched(base: DataFrame, more: DataFrame, key: str = "source_id") -> DataFrame:
    """Left join on the key after one row for each key of ``more`` is kept."""
    return base.join(more.dropDuplicates([key]), key, "left")


def flagged(df: DataFrame, ids: DataFrame, name: str, key: str = "source_id") -> DataFrame:
    """``name``: whether the key is among ``ids``."""
    found = ids.select(key).distinct().withColumn("__there", F.lit(True))
    return df.join(found, key, "left").withColumn(name, F.coalesce("__there", F.lit(False))).drop("__there")


def medians(df: DataFrame, key: str, values: list[str], counted: str) -> DataFrame:
    """Exact medians of the values for each key, and how many rows have ``counted``."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.median(v).alias(v) for v in values], F.count(counted).alias("n_measurements"))


def two_pass(left: DataFrame, right: DataFrame, name: str, right_name: str, values: list[str], test: str) -> DataFrame:
    """Join by normalised name; rows whose ``test`` stays NULL are filled by catalogue key, all values together.

    ``right`` holds measurements under names; they are reduced again on the key, so a name written in two ways
    doesn't multiply rows.
    """
    main = medians(right.withColumn("__key", one_blank(F.col(right_name))), "__key", values, right_name)
    second = medians(right.withColumn("__cat", catalogue_key(F.col(right_name))), "__cat", values, right_name)
    names = [*values, "n_measurements"]
    second = second.withColumnsRenamed({v: f"__{v}" for v in names})
    joined = left.withColumns({"__key": one_blank(F.col(name)), "__cat": catalogue_key(F.trim(F.col(name)))}).join(main, "__key", "left").join(second, "__cat", "left")
    fill = F.col(test).isNull() & F.col("__cat").isNotNull()
    filled = {v: F.when(fill, F.col(f"__{v}")).otherwise(F.col(v)) for v in names}
    return joined.withColumns(filled).drop("__key", "__cat", *[f"__{v}" for v in names])


def by_bare_name(left: DataFrame, right: DataFrame, name: str, right_name: str) -> DataFrame:
    """Left join on names without any blank."""
    right = right.withColumn("__key", no_blank(F.col(right_name))).drop(right_name)
    return left.withColumn("__key", no_blank(F.col(name))).join(right, "__key", "left").drop("__key")
