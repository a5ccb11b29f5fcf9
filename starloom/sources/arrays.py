"""Numpy matrices and archives as files, written and read by the executors."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one matrix file.
ROWS = 4096


def _write(folder: str, name: str, content: bytes) -> None:
    files, at = pyarrow.fs.FileSystem.from_uri(folder)
    files.create_dir(at)
    with files.open_output_stream(f"{at}/{name}") as out:
        out.write(content)


def write_matrix(df: DataFrame, folder: str, key: str = "source_id", values: str = "flux", rows: int = ROWS) -> None:
    """Parts of ``rows`` rows: matrix-<part>.npy and beside it ids-<part>.npy, in the same order; NULL rows are NaN.

    A part's name follows from its task, so a task that runs again writes the same files.
    """

    def run(batches):
        held, part, at = [], 0, TaskContext.get().partitionId()

        def out(own: pd.DataFrame) -> int:
            size = max((len(v) for v in own[values] if v is not None), default=0)
            matrix = np.full((len(own), size), np.nan, dtype=np.float32)
            for k, v in enumerate(own[values]):
                if v is not None:
                    matrix[k, : len(v)] = np.asarray(v, dtype=np.float32)
            for name, array in (("matrix", matrix), ("ids", own[key].to_numpy(dtype=np.int64))):
                content = io.BytesIO()
                np.save(content, array)
                _write(folder, f"{name}-{at:05d}-{part:05d}.npy", content.getvalue())
            return len(own)

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= rows:
                whole = pd.concat(held)
                yield pd.DataFrame({"n": [out(whole[:rows])]})
                held, part = [whole[rows:]], part + 1
        if sum(map(len, held)):
            yield pd.DataFrame({"n": [out(pd.concat(held))]})

    df.select(key, values).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def gathered(spark: SparkSession, folder: str, ids: DataFrame, key: str = "source_id") -> DataFrame:
    """``key`` and flux of the ids asked for, each row taken from its matrix by its place; ids that aren't there, and rows without any value, are left out."""

    def places(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                own = np.load(io.BytesIO(content))
                yield pd.DataFrame({"file": path.replace("ids-", "matrix-"), key: own, "place": np.arange(len(own))})

    def rows(own: pd.DataFrame) -> pd.DataFrame:
        files, at = pyarrow.fs.FileSystem.from_uri(own["file"].iloc[0])
        with files.open_input_file(at) as file:
            matrix = np.load(io.BytesIO(file.read()))[own["place"].to_numpy()]
        some = ~np.isnan(matrix).all(axis=1)
        return pd.DataFrame({key: own[key].to_numpy()[some], "flux": [[None if np.isnan(x) else x for x in r] for r in matrix[some].tolist()]})

    index = spark.read.format("binaryFile").option("pathGlobFilter", "ids-*.npy").load(folder).select("path", "content").mapInPandas(places, f"file string, {key} long, place long")
    return index.join(ids.select(key).distinct(), key).groupBy("file").applyInPandas(rows, f"{key} long, flux array<float>")


def write_archives(df: DataFrame, folder: str, key: str = "source_id", arrays: tuple[str, ...] = ("wavelength", "flux")) -> None:
    """One archive <key>.npz for each row, with its arrays by name; NULL arrays are left out."""

    def run(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                content = io.BytesIO()
                np.savez_compressed(content, **{name: np.asarray(row[name], dtype=np.float64) for name in arrays if row[name] is not None})
                _write(folder, f"{row[key]}.npz", content.getvalue())
            yield pd.DataFrame({"n": [len(batch)]})

    df.select(key, *arrays).mapInPandas(run, "n long").agg(F.sum("n")).collect()
