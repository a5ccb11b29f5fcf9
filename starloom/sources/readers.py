"""Scans of files, each with a schema of its own; paths are whatever Spark can open."""

from __future__ import annotations

import io
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.scalar import known, number
from starloom.schemas import FIXED_WIDTH, SCHEMAS


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; text that stands for a missing value is NULL, a bad number too."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("header", True).option("nanValue", "nan").option("mode", "PERMISSIVE").csv(path)


def id_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The whole numbers of one column of a CSV file."""
    return spark.read.option("header", True).csv(path).select(F.col(column).try_cast("long").alias(column)).dropna()


def fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int]] = FIXED_WIDTH, numbers: tuple[str, ...] = ("teff", "e_teff", "logg", "feh")) -> DataFrame:
    """A fixed-width text file, plain or compressed; empty fields are NULL, named columns numbers."""
    out = []
    for name, (a, b) in columns.items():
        text = F.nullif(F.trim(F.substring("value", a + 1, b - a)), F.lit(""))
        out.append((number(text) if name in numbers else text).alias(name))
    return spark.read.text(path).select(*out)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of documents; bare NaN is read, then NULL by ``sanitized``."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)


def wrapped_json(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("stars", "contracts", "data", "corpus")) -> DataFrame:
    """A JSON array, or an object that holds it under one of ``keys`` or, failing these, as its first value that is a list."""
    item = SCHEMAS.get(schema, schema)
    text = spark.read.text(path, wholetext=True)
    wide = ", ".join(f"{k} array<struct<{_fields(item)}>>" for k in keys)
    bare = F.from_json("value", f"array<struct<{_fields(item)}>>", {"allowNonNumericNumbers": "true"})
    held = F.from_json("value", wide, {"allowNonNumericNumbers": "true"})
    lists = F.filter(F.map_values(F.from_json("value", "map<string, string>")), lambda x: F.ltrim(x).startswith("["))
    first = F.from_json(F.get(lists, 0), f"array<struct<{_fields(item)}>>", {"allowNonNumericNumbers": "true"})
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(F.coalesce(*[held[k] for k in keys], first))
    return text.select(F.inline(rows))


def _fields(ddl: str) -> str:
    depth, out, part = 0, [], ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """source (file name without ending) and text of each file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("source"), F.col("value").alias("text"))


def batch_files(spark: SparkSession, folder: str, schema: str, pattern: str = r"batch_[^/]*?_?(\d+)[^/]*\.json$") -> DataFrame:
    """All numbered batch files of a folder, with batch_no from each file's name."""
    df = spark.read.schema(SCHEMAS.get(schema, schema)).option("multiLine", True).json(f"{folder}/batch_*.json")
    return df.withColumn("batch_no", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("int"))


def array_files(spark: SparkSession, path: str) -> DataFrame:
    """source_id, wavelength, flux, flux_error of the .npz archives of a path, one for each source; missing errors are NULL."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                found = re.search(r"(\d+)\.npz$", name)
                with np.load(io.BytesIO(content)) as held:
                    if found is None or "wavelength" not in held or "flux" not in held:
                        continue
                    error = held["flux_error"].astype(np.float32) if "flux_error" in held else None
                    rows.append((int(found[1]), held["wavelength"].astype(float), held["flux"].astype(np.float32), error))
            yield pd.DataFrame(rows, columns=["source_id", "wavelength", "flux", "flux_error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path).select("path", "content")
    return files.mapInPandas(run, SCHEMAS["rvs"])


def columns_of(df: DataFrame) -> DataFrame:
    """column_name and data_type, by name."""
    return df.sparkSession.createDataFrame([(n, t) for n, t in sorted(df.dtypes)], "column_name string, data_type string")


def requested(ids: DataFrame, table: DataFrame, key: str = "source_id") -> DataFrame:
    """The table's rows for the ids asked for, NULL where there is none, in the order in which the ids are first asked for."""
    first = ids.select(key, F.monotonically_increasing_id().alias("__at")).groupBy(key).agg(F.min("__at").alias("__at"))
    return first.join(table, key, "left").orderBy("__at").drop("__at")


def without(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` without the columns whose names contain one of ``parts``, anywhere: ``_x`` takes ``name_x`` and ``a_xyz`` alike."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not any(p in c for p in parts)])


def spectra_present(table: DataFrame, key: str = "source_id", values: str = "flux") -> DataFrame:
    """Keys that have at least one value in their array."""
    return table.where(F.exists(values, lambda x: x.isNotNull() & ~F.isnan(x))).select(key).distinct()


def latest(spark: SparkSession, folder: str, pattern: str = r"^DB-(\d+)-\d{4}-\d{2}-\d{2}$") -> str | None:
    """The folder with the largest number in its name; None without one."""
    found = [(int(m[1]), name) for name in listed(spark, folder) if (m := re.match(pattern, name))]
    return f"{folder}/{max(found)[1]}" if found else None


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []


def cleaned(df: DataFrame, *texts: str) -> DataFrame:
    """Texts that stand for a missing value become NULL."""
    return df.withColumns({t: known(F.col(t)) for t in texts})
