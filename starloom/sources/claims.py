"""Names that only one writer gets, and pointers that change at once, through Hadoop's file systems."""

from __future__ import annotations

import datetime
import os
import re

from pyspark.sql import SparkSession

from starloom.sources.readers import listed


def _at(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _created(path, files) -> bool:
    """Whether this call has made the file; a file that is there is not made again.

    Distributed file systems decide that in one step where a file is created without leave to overwrite. Hadoop's
    view of a local disk looks first and creates then, so there the operating system is asked.
    """
    if files.getUri().getScheme() == "file":
        try:
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    try:
        files.create(path, False).close()
    except Exception:
        if not files.exists(path):
            raise
        return False
    return True


def claimed_folder(spark: SparkSession, folder: str, day: datetime.date | None = None) -> str:
    """The next folder DB-N-date, made here: of several writers that ask at once each gets a number of its own.

    A number is claimed by creating the file .claims/N, which is granted once; the folder is made after it. A writer that
    dies between the two leaves a gap.
    """
    names = listed(spark, folder)
    number = max([0, *(int(m[1]) for name in names if (m := re.match(r"^DB-(\d+)-", name))), *map(int, filter(str.isdigit, listed(spark, f"{folder}/.claims")))])
    while True:
        number += 1
        claim, files = _at(spark, f"{folder}/.claims/{number}")
        files.mkdirs(claim.getParent())
        granted = _created(claim, files)
        if granted:
            path = f"{folder}/DB-{number}-{(day or datetime.date.today()).isoformat()}"
            files.mkdirs(_at(spark, path)[0])
            return path


def pointed(spark: SparkSession, path: str) -> str | None:
    """What a pointer file holds; None without one."""
    at, files = _at(spark, path)
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def point(spark: SparkSession, path: str, text: str) -> None:
    """Write a pointer beside its place and rename it there, over what stands there: readers see the old text or the new."""
    jvm = spark.sparkContext._jvm
    at, files = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{jvm.java.util.UUID.randomUUID().toString()}")
    stream = files.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(files.makeQualified(beside), files.makeQualified(at), options)


def there(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)
