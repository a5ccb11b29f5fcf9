"""Summaries of catalogues and contracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.ordering import running_total


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def flag_shares(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row for each flag: how often it is set, and in percent."""
    one = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(f)).alias(f) for f in flags])
    long = one.unpivot(["total"], flags, "flag", "n_set")
    return long.select("flag", "n_set", (F.try_divide(F.col("n_set") * 100.0, F.col("total"))).alias("percent"))


def median(df: DataFrame, value: str) -> DataFrame:
    """One row, ``middle``: the exact median of a column, from counts by value in range partitions; NULL without values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = running_total(counts, ["v"], "n", "upto")
    placed = upto.crossJoin(F.broadcast(upto.agg(F.max("upto").alias("total"))))
    first = lambda reached: F.min(F.when(reached, F.col("v")))
    twice = 2 * F.col("upto")
    return placed.agg(((first(twice >= F.col("total")) + first(twice > F.col("total"))) / 2.0).alias("middle"))


def quality_bands(df: DataFrame, score: str = "quality_score") -> DataFrame:
    s = F.col(score)
    return df.agg(
        F.count_if(s >= 0.95).alias("excellent"), F.count_if((s >= 0.7) & (s < 0.95)).alias("good"), F.count_if((s >= 0.4) & (s < 0.7)).alias("fair"),
        F.count_if(s < 0.4).alias("poor"), F.avg(s).alias("mean_score"),
    ).crossJoin(F.broadcast(median(df, score).withColumnRenamed("middle", "median_score")))


def null_shares(df: DataFrame, *columns: str) -> DataFrame:
    """Percent of NULL in each column that has any, from one pass."""
    names = list(columns or df.columns)
    one = df.agg(*[(F.avg(F.col(n).isNull().cast("int")) * 100.0).alias(n) for n in names])
    return one.unpivot([], names, "column_name", "null_percent").where("null_percent > 0")


def completeness(df: DataFrame, *columns: str) -> DataFrame:
    one = df.agg(*[(F.avg(F.col(n).isNotNull().cast("int")) * 100.0).alias(n) for n in columns])
    return one.unpivot([], list(columns), "column_name", "present_percent")


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count(n).alias(f"n_{n}") for n in columns])


def summary(df: DataFrame, *columns: str) -> DataFrame:
    """Least, largest and exact median of each column, a row for each."""
    one = df.agg(*[F.struct(F.min(n).cast("double").alias("low"), F.max(n).cast("double").alias("high")).alias(n) for n in columns])
    ends = one.unpivot([], list(columns), "column_name", "v").select("column_name", "v.low", "v.high")
    middles = reduce(DataFrame.unionByName, [median(df, n).select(F.lit(n).alias("column_name"), F.col("middle").cast("double").alias("middle")) for n in columns])
    return ends.join(F.broadcast(middles), "column_name")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """How many keys there are, and how many rows repeat one; distinct keys are counted after a shuffle by key."""
    per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated"))


def against_targets(df: DataFrame, label: str, goal: dict[str, int]) -> DataFrame:
    """Target and actual count of each category; LOW below nine tenths of the target."""
    spark = df.sparkSession
    wanted = spark.createDataFrame(list(goal.items()), f"{label} string, target int")
    found = wanted.join(distribution(df, label), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("state", F.when(F.col("n") >= F.floor(F.col("target") * 0.9), "OK").otherwise("LOW"))


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in equal bins from the least to the largest value, the last bin closed; empty bins have no row."""
    rows = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.floor(F.try_divide((F.col("v") - F.col("lo")) * F.lit(float(bins)), F.col("hi") - F.col("lo")))
    binned = rows.crossJoin(F.broadcast(ends)).select(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))


def line_statistics(df: DataFrame) -> DataFrame:
    """Per line index of ``cat_triplet``: attempted, fitted, of high quality, and their rates."""
    lines = df.select(F.posexplode("cat_triplet").alias("line_index", "line"))
    n, ok, high = F.count("*"), F.count_if(F.col("line.status") == "success"), F.count_if(F.col("line.high_quality_fit"))
    found = lines.groupBy("line_index").agg(n.alias("attempted"), ok.alias("fitted"), high.alias("high_quality"))
    return found.withColumns({"fitted_rate": F.col("fitted") / F.col("attempted"), "high_rate": F.col("high_quality") / F.col("attempted")})


def anchor_summary(df: DataFrame) -> DataFrame:
    """Counts by letter, population and chemistry source, and of the three kinds of nearness, in one pass."""
    sets = df.groupingSets([["mk_letter"], ["population_group"], ["chemistry_source"]], "mk_letter", "population_group", "chemistry_source")
    return sets.agg(
        F.grouping_id().alias("which"), F.count("*").alias("n"), F.count_if("near_teff_boundary").alias("near_teff"),
        F.count_if("near_logg_boundary").alias("near_logg"), F.count_if("near_chemistry_boundary").alias("near_chemistry"),
    )
