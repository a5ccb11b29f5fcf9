"""Scans that may fail: tried again with growing waits, replaced by the next source, or left out."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.scalar import source_id
from starloom.sources.readers import listed

log = logging.getLogger(__name__)


def attempted(scan: Callable[[], DataFrame], tries: int = 4, wait: float = 15.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame | None:
    """What ``scan`` gives; after each failure it waits twice as long as before. None after the last."""
    for k in range(tries):
        try:
            return scan()
        except Exception as error:
            log.warning("scan failed (%d of %d): %s", k + 1, tries, error)
            if k + 1 < tries:
                sleep(wait * 2**k)
    return None


def scanned(scan: Callable[[], DataFrame], description: str) -> DataFrame | None:
    """One try: None, and a warning with the description, where it fails, so that its part is left out."""
    found = attempted(scan, tries=1)
    if found is None:
        log.warning("%s is left out", description)
    return found


def first_that_works(*scans: Callable[[], DataFrame], wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame | None:
    """The first scan that succeeds, with a wait between one and the next; None where none does."""
    for k, scan in enumerate(scans):
        found = attempted(scan, tries=1)
        if found is not None:
            return found
        if k + 1 < len(scans):
            sleep(wait)
    return None


def capped(df: DataFrame, *order: str, most: int = 50_000) -> DataFrame:
    """All columns of the first ``most`` rows in a total order."""
    return df.orderBy(*order).limit(most)


def reused(spark: SparkSession, path: str, needed: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The extract at ``path`` if it is there and has the column ``needed``; else it is made, written and read back."""
    if listed(spark, path):
        found = spark.read.parquet(path)
        if needed in found.columns:
            return found
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resolved(ids: DataFrame, table: DataFrame, key: str = "source_id", text: str = "designation") -> DataFrame:
    """``ids`` with what a resolver table says of them; its ids stand within a text. NULL where it has none."""
    return ids.join(table.withColumn(key, source_id(F.col(text))).drop(text).where(F.col(key).isNotNull()), key, "left")
