"""Scans of archives that answer in pages and may fail while they run, as a Spark data source.

An archive is any object that can be pickled and has

    size(filters) -> int                                   rows that satisfy the filters
    page(columns, filters, offset, limit) -> pyarrow.Table  rows offset .. offset + limit in a fixed order
    named(columns, keys) -> pyarrow.Table                   the rows of these keys (for lookups only)
    places(filters, offset, limit) -> object                optional: what its ``page`` needs to find these rows; a task is given it as ``archive.found``

``filters`` are (column, operator, value) with =, >, >=, <, <=, in. A partition of the scan is one page, or a run of pages where there
are more than MOST, so pages are read in parallel and a page that fails is tried again where it runs, with waits that double; one that goes on failing
is read as smaller pages, and what is still dead is left out with a warning, or ends the scan if ``strict``.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

PAGE, BATCH, TRIES, WAIT, SMALLER = 50_000, 500, 4, 15.0, 10
#: Partitions of a scan at most; rows of an archive over files that a task holds in order.
MOST, WINDOW = 256, 1 << 17
#: Names that the column with the identifier may have, in any case.
ID_NAMES = ("source", "_source", "id", "main_id")

Filters = list[tuple[str, str, object]]
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


class Archive(Protocol):
    def size(self, filters: Filters) -> int: ...

    def page(self, columns: list[str], filters: Filters, offset: int, limit: int) -> pa.Table: ...

    def named(self, columns: list[str], keys: list) -> pa.Table: ...


def tried(call: Callable[[], pa.Table], tries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> pa.Table | None:
    """What ``call`` gives; after each failure it waits twice as long as before. None after the last."""
    for k in range(tries):
        try:
            return call()
        except Exception as error:
            log.warning("archive failed (%d of %d): %s", k + 1, tries, error)
            if k + 1 < tries:
                sleep(wait * 2**k)
    return None


class Page(InputPartition):
    """A run of pages."""

    def __init__(self, offset: int, limit: int, found: object = None):
        self.offset, self.limit, self.found = offset, limit, found


class PagedReader(DataSourceReader):
    def __init__(self, archive: Archive, schema: StructType, page: int, tries: int, wait: float, strict: bool):
        self.archive, self.names, self.filters = archive, schema.names, []
        self.schema = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in schema.fields])
        self.page, self.tries, self.wait, self.strict = page, tries, wait, strict

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of a column with a value go to the archive; Spark applies the others."""
        for f in filters:
            kind = OPERATORS.get(type(f))
            if kind and len(f.attribute) == 1:
                self.filters.append((f.attribute[0], kind, list(f.value) if kind == "in" else f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        total = tried(lambda: self.archive.size(self.filters), self.tries, self.wait)
        if total is None:
            if self.strict:
                raise RuntimeError("the archive does not answer")
            log.warning("the archive does not answer and is left out")
            return [Page(0, 0)]
        run = self.page * max(1, -(-total // (self.page * MOST)))
        places = getattr(self.archive, "places", lambda *_: None)
        return [Page(at, min(run, total - at), places(self.filters, at, min(run, total - at))) for at in range(0, total, run)] or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if partition.found is not None:
            self.archive.found = partition.found
        end = partition.offset + partition.limit
        for at in range(partition.offset, end, self.page):
            yield from self.read_page(at, min(self.page, end - at))

    def read_page(self, offset: int, limit: int) -> Iterator[pa.RecordBatch]:
        fetch = lambda at, n: lambda: self.archive.page(self.names, self.filters, at, n)
        whole = tried(fetch(offset, limit), self.tries, self.wait)
        if whole is not None:
            yield from self.batches(whole)
            return
        step = max(1, limit // SMALLER)
        for at in range(offset, offset + limit, step):
            n = min(step, offset + limit - at)
            part = tried(fetch(at, n), self.tries, self.wait)
            if part is not None:
                yield from self.batches(part)
            elif self.strict:
                raise RuntimeError(f"rows {at} to {at + n} can't be read")
            else:
                log.warning("rows %d to %d are left out", at, at + n)

    def batches(self, found: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from found.select(self.names).cast(self.schema).to_batches(max_chunksize=10_000)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def scan(spark: SparkSession, archive: Archive, schema: str, page: int = PAGE, tries: int = TRIES, wait: float = WAIT, strict: bool = False) -> DataFrame:
    """A table of the archive's rows; columns of ``schema`` only are asked for, filters are pushed down.

    Rows keep no order. A page of more rows than an archive gives at once should be avoided: ``page`` is
    both its limit and the grain of parallel reads.
    """
    name = f"paged_{uuid.uuid4().hex}"

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> PagedReader:
            return PagedReader(archive, schema, page, tries, wait, strict)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Paged)
    return spark.read.format(name).load()


def id_column(names: list[str]) -> str | None:
    """The column that holds the identifier, by its name."""
    return next((n for n in names if n.lower() in ID_NAMES), None)


def looked_up(keys: DataFrame, archive: Archive, key: str, wanted: dict[str, str], to: str, size: int = BATCH, tries: int = TRIES, wait: float = WAIT) -> DataFrame:
    """The archive's rows of the distinct ``keys``, asked for in batches of ``size``: ``to`` and the columns of ``wanted`` (name there: type).

    Blank and NULL keys are not asked for. The archive's identifier is found by its name (ID_NAMES); an
    answer without such a column, and a batch that goes on failing, give no rows and a warning. Wanted columns that an answer
    lacks are NULL.
    """
    names, shape = list(wanted), ", ".join([f"`{to}` string", *(f"`{n}` {kind}" for n, kind in wanted.items())])
    types = {n: _arrow(_parsed(kind)) for n, kind in wanted.items()}

    def asked(own: list[str]) -> Iterator[pa.RecordBatch]:
        found = tried(lambda: archive.named(names, own), tries, wait)
        if found is None:
            log.warning("%d names are left out", len(own))
            return
        identifier = id_column(found.column_names)
        if identifier is None:
            log.warning("no identifier among %s", found.column_names)
            return
        columns = [found[identifier].cast(pa.string())]
        columns += [found[n].cast(types[n]) if n in found.column_names else pa.nulls(len(found), types[n]) for n in names]
        yield from pa.table(columns, names=[to, *names]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held.append(name)
                if len(held) >= size:
                    yield from asked(held)
                    held = []
        if held:
            yield from asked(held)

    own = keys.select(F.trim(F.col(key).cast("string")).alias(key)).where(F.col(key) != "").distinct()
    return own.mapInArrow(run, shape)


def _parsed(kind: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(kind)


class ParquetArchive:
    """An archive over Parquet files, in the order of a column, with failures on request.

    ``failing``: how often a page that starts at an offset fails before it answers; ``dead``: offsets of rows that always fail.

    The order is cut into windows of about WINDOW rows, by values of the column: (first offset, rows, from, below). They are found once, where
    the scan is planned, in two passes over the column in batches. A page is a slice of its window, which is read (Parquet leaves out
    row groups outside its values) and sorted when a page first needs it; one window is held at a time.
    """

    def __init__(self, path: str, order: str, rename: dict[str, str] | None = None, failing: Callable[[int], int] | None = None, dead: Callable[[int, int], bool] | None = None):
        self.path, self.order, self.rename, self.failing, self.dead = path, order, rename or {}, failing, dead
        self.calls: dict[int, int] = {}
        self.found: list[tuple] | None = None
        self.held: tuple | None = None

    def rows(self, filters: Filters):
        import pyarrow.dataset as ds

        kinds = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "in": lambda a, b: a.isin(b)}
        held = None
        for column, kind, value in filters:
            own = kinds[kind](ds.field(column), value)
            held = own if held is None else held & own
        return ds.dataset(self.path.removeprefix("file://")), held

    def size(self, filters: Filters) -> int:
        data, held = self.rows(filters)
        return data.count_rows(filter=held, use_threads=False)

    def windows(self, filters: Filters) -> list[tuple]:
        import pyarrow.compute as pc

        data, held = self.rows(filters)
        batches = lambda: (b.column(0) for b in data.to_batches(columns=[self.order], filter=held, use_threads=False))
        total = self.size(filters)
        if total <= WINDOW:
            return [(0, total, None, None)]
        step, drawn, passed = max(1, WINDOW // 16), [], 0
        for own in batches():  # every step-th value
            drawn.append(own.take(pa.array(range(-passed % step, len(own), step), pa.int64())).drop_null())
            passed += len(own)
        drawn = pa.chunked_array(drawn, type=data.schema.field(self.order).type)
        drawn = drawn.filter(pc.equal(drawn, drawn)) if pa.types.is_floating(drawn.type) else drawn
        drawn = drawn.take(pc.sort_indices(drawn)).to_pylist()
        cuts = sorted(set(drawn[16::16]))
        counts = [0] * (len(cuts) + 1)
        nulls = 0
        bounds = pa.array(cuts, data.schema.field(self.order).type).to_numpy(zero_copy_only=False)
        for own in batches():
            nulls += own.null_count
            own = own.drop_null().to_numpy(zero_copy_only=False)
            for k, n in zip(*np.unique(np.searchsorted(bounds, own, side="right"), return_counts=True)):
                counts[k] += int(n)
        counts[-1] += nulls  # the last window has what no value bounds: NaN, and nulls at the end
        out, first = [], 0
        for k, n in enumerate(counts):
            if n:
                out.append((first, n, cuts[k - 1] if k else None, cuts[k] if k < len(cuts) else None))
            first += n
        return out

    def places(self, filters: Filters, offset: int, limit: int) -> list[tuple]:
        """The windows that hold these rows."""
        if self.found is None:
            self.found = self.windows(filters)
        return [w for w in self.found if w[0] < offset + limit and offset < w[0] + w[1]]

    def window(self, columns: list[str], filters: Filters, window: tuple) -> pa.Table:
        import pyarrow.dataset as ds

        asked = (tuple(columns), repr(filters), window)
        if self.held is None or self.held[0] != asked:
            data, held = self.rows(filters)
            _, _, low, high = window
            column = ds.field(self.order)
            if low is not None and high is None:
                last = column.is_null() | (column >= low)
                if pa.types.is_floating(data.schema.field(self.order).type):
                    last |= column.is_nan()
                held = last if held is None else held & last
            elif low is not None or high is not None:
                inside = column < high if low is None else (column >= low) & (column < high)
                held = inside if held is None else held & inside
            self.held = None
            found = data.to_table(columns=list({*columns, self.order}), filter=held, use_threads=False).sort_by(self.order).combine_chunks()
            self.held = asked, found
        return self.held[1]

    def page(self, columns: list[str], filters: Filters, offset: int, limit: int) -> pa.Table:
        self.calls[offset] = self.calls.get(offset, 0) + 1
        if self.failing and self.calls[offset] <= self.failing(offset):
            raise ConnectionError(f"page at {offset} timed out")
        if self.dead and self.dead(offset, limit):
            raise ConnectionError(f"page at {offset} is dead")
        parts = [self.window(columns, filters, w).slice(max(0, offset - w[0]), min(offset + limit, w[0] + w[1]) - max(offset, w[0])) for w in self.places(filters, offset, limit)]
        return pa.concat_tables(parts) if parts else self.rows([])[0].schema.empty_table()

    def named(self, columns: list[str], keys: list) -> pa.Table:
        import pyarrow.dataset as ds

        back = {v: k for k, v in self.rename.items()}
        data, _ = self.rows([])
        there = [back.get(n, n) for n in columns if back.get(n, n) in data.schema.names]
        found = data.to_table(columns=[self.order, *[n for n in there if n != self.order]], filter=ds.field(self.order).isin(keys), use_threads=False)
        return found.rename_columns([self.rename.get(n, n) for n in found.column_names])
