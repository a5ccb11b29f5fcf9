import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from starloom.llm import store
from starloom.llm.common import fresh_path, tokenizer_path


def test_crc_of_parts_combines():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 5000, dtype=np.uint8).tobytes()
    cuts = [0, 1, 7, 900, 4999, 5000]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    crcs = np.array([zlib.crc32(p) for p in parts])
    after = np.array([5000 - b for b in cuts[1:]])
    assert int(np.bitwise_xor.reduce(store.crc_shift(crcs, after))) == zlib.crc32(data)


def test_chunks_follow_content():
    draw = np.random.default_rng(2)
    shared = draw.integers(0, 50000, 20000)
    a = np.concatenate([draw.integers(0, 50000, 333), shared])
    ends_a, ends_b, short = store.chunk_ends(a, shared, shared[:5])
    assert [ends_a] == store.chunk_ends(a) and [ends_b] == store.chunk_ends(shared) and short == [5]
    assert ends_a[-1] == len(a) and ends_b[-1] == len(shared)
    assert len({e - 333 for e in ends_a} & set(ends_b)) > 0.9 * len(ends_b)
    sizes = np.diff([0, *store.chunk_ends(np.zeros(10000, dtype=np.int64))[0]])
    assert sizes.max() <= store.LONGEST
    assert np.diff([0, *ends_a])[:-1].min() >= store.SHORTEST


def expected(rows):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = store.write_store(docs, fresh_path(spark, "store"))
    got = sorted(tuple(r) for r in store.verify_documents(spark, folder).collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got == expected(rows)
    stage = spark.read.parquet(f"{folder}/stage").where("kind = 'chunk'")
    assert stage.count() == stage.select("digests").distinct().count()
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    text = dict(rows)
    for r in store.read_documents(spark, folder).limit(20).collect():
        assert np.frombuffer(bytes(r.ids), dtype="<u2").tolist() == [*library.encode(text[r.doc_id], add_special_tokens=False).ids, 0]


def test_edges(spark):
    rows = [(None, "first"), (3, None), (2, ""), (9, "word " * 4000), (4, "<|endoftext|>x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, route int")
    folder = store.write_store(docs, fresh_path(spark, "store"))
    got = sorted((tuple(r) for r in store.verify_documents(spark, folder).collect()), key=lambda r: (r[0] is not None, r[0]))
    assert got == expected(rows)
    empty = store.write_store(docs.limit(0), fresh_path(spark, "store"))
    assert store.verify_documents(spark, empty).count() == 0
    twice = store.write_store(docs.union(docs), fresh_path(spark, "store"))
    assert store.verify_documents(spark, twice).count() == 10


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    folder = store.write_store(docs, fresh_path(spark, "store"))
    spark.read.parquet(f"{folder}/stage").withColumn("data", store.F.when(store.F.col("kind") == "chunk", store.F.unhex(store.F.lit("0100"))).otherwise(store.F.col("data"))).write.partitionBy("kind").parquet(f"{folder}-bad/stage")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{folder}/{name}").write.parquet(f"{folder}-bad/{name}")
    with pytest.raises(Exception, match="damaged"):
        store.verify_documents(spark, f"{folder}-bad").collect()
