import logging

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from starloom.sources import paged as G


@pytest.fixture
def path(tmp_path):
    pq.write_table(pa.table({"id": list(range(1000)), "name": [f"n{k}" for k in range(1000)], "v": [k / 2 for k in range(1000)]}), tmp_path / "t.parquet")
    return str(tmp_path / "t.parquet")


def test_pages_that_fail_while_read_give_their_rows(spark, path):
    archive = G.ParquetArchive(path, "id", failing=lambda at: 2 if at % 300 == 0 else 0)
    df = G.scan(spark, archive, "id long, v double", page=100, tries=3, wait=0.001, strict=True)
    assert df.rdd.getNumPartitions() == 10
    assert sorted((r.id, r.v) for r in df.collect()) == [(k, k / 2) for k in range(1000)]


def test_dead_page_falls_back_to_smaller_ones(spark, path):
    dead = lambda at, n: at <= 430 < at + n
    rows = G.scan(spark, G.ParquetArchive(path, "id", dead=dead), "id long", page=100, tries=2, wait=0.001).collect()
    assert {r.id for r in rows} == set(range(1000)) - set(range(430, 440))
    with pytest.raises(Exception, match="can't be read"):
        G.scan(spark, G.ParquetArchive(path, "id", dead=dead), "id long", page=100, tries=1, wait=0.001, strict=True).collect()


def test_filters_reach_the_archive(path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains
    from pyspark.sql.types import _parse_datatype_string

    reader = G.PagedReader(G.ParquetArchive(path, "id"), _parse_datatype_string("struct<id: bigint, v: double>"), 100, 1, 0.0, True)
    other = StringContains(("name",), "n1")
    assert list(reader.pushFilters([GreaterThan(("v",), 400.0), other, EqualTo(("id",), 900)])) == [other]
    assert reader.filters == [("v", ">", 400.0), ("id", "=", 900)]
    pages = reader.partitions()
    assert [(p.offset, p.limit) for p in pages] == [(0, 1)]
    assert [b.to_pydict() for b in reader.read(pages[0])] == [{"id": [900], "v": [450.0]}]


def test_silent_archive(spark, path, caplog):
    class Silent(G.ParquetArchive):
        def size(self, filters):
            raise ConnectionError("no route")

    assert G.scan(spark, Silent(path, "id"), "id long", tries=2, wait=0.001).collect() == []
    with pytest.raises(Exception, match="does not answer"):
        G.scan(spark, Silent(path, "id"), "id long", tries=1, wait=0.001, strict=True).collect()


def test_waits_double(caplog):
    waits = []
    with caplog.at_level(logging.WARNING):
        assert G.tried(lambda: 1 / 0, 4, 15.0, waits.append) is None
    assert waits == [15.0, 30.0, 60.0] and len(caplog.records) == 4


def test_lookups_in_batches(spark, path):
    class Counting(G.ParquetArchive):
        def named(self, columns, keys):
            if len(keys) > 40 or "n13" in keys and self.calls.setdefault(0, 0) < 1:
                self.calls[0] = 1
                raise ConnectionError("too many, or not yet")
            return super().named(columns, keys)

    keys = spark.createDataFrame([(f" n{k} ",) for k in range(0, 300)] + [("n5",), (None,), ("  ",), ("unknown",)], "star string").repartition(3)
    found = G.looked_up(keys, Counting(path, "name", {"name": "Main_ID", "v": "Teff"}), "star", {"Teff": "double", "logg": "double"}, "main_id", size=40, tries=2, wait=0.001).collect()
    assert sorted((r.main_id, r.Teff, r.logg) for r in found) == sorted((f"n{k}", k / 2, None) for k in range(300))
    none = G.looked_up(keys, G.ParquetArchive(path, "name"), "star", {"v": "double"}, "main_id", tries=1, wait=0.001)
    assert none.collect() == []  # no column that could be the identifier
    assert G.id_column(["x", "Main_ID"]) == "Main_ID" and G.id_column(["x"]) is None


@pytest.mark.parametrize("by", ["id", "name", "v", "w"])
def test_pages_of_windows_of_an_unsorted_file_are_those_of_its_order(tmp_path, monkeypatch, by):
    monkeypatch.setattr(G, "WINDOW", 64)
    draw = [(k * 389) % 1000 for k in range(1000)]
    table = pa.table({"id": draw, "name": [f"n{k}" for k in draw], "v": [float("nan") if k < 5 else k / 2 for k in draw], "w": [None if k < 70 else k for k in draw]})
    pq.write_table(table, tmp_path / "u.parquet", row_group_size=100)
    archive = G.ParquetArchive(str(tmp_path / "u.parquet"), by)
    reads, whole = [], table.sort_by(by)[by].to_pylist()
    window = archive.window
    archive.window = lambda *a: reads.append(a[2]) or window(*a)
    found = [x for at in range(0, 1000, 7) for x in archive.page([by], [], at, 7)[by].to_pylist()]
    assert str(found) == str(whole) and len(set(reads)) > 8
    some = [("id", ">", 500)]
    archive = G.ParquetArchive(str(tmp_path / "u.parquet"), "id")
    assert [x for at in range(0, 499, 7) for x in archive.page(["id"], some, at, 7)["id"].to_pylist()] == list(range(501, 1000))


def test_many_pages_share_partitions(spark, path, monkeypatch):
    reader = G.PagedReader(G.ParquetArchive(path, "id"), G._parsed("struct<id: bigint>"), 2, 1, 0.0, True)
    pages = reader.partitions()
    assert len(pages) <= G.MOST and sum(p.limit for p in pages) == 1000 and all(p.offset % 2 == 0 for p in pages)
    assert sorted(x for p in pages for b in reader.read(p) for x in b.column(0).to_pylist()) == list(range(1000))
