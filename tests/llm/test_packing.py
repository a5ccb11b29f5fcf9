import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from starloom.llm import packing
from starloom.llm.byte_ids import byte_ids
from starloom.llm.common import tokenizer_path


def brute_first_fit(sizes, room):
    free, bins = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, f in enumerate(free):
            if f >= sizes[i]:
                break
        else:
            b = len(free)
            free.append(room)
            bins.append([])
        free[b] -= sizes[i]
        bins[b].append(i)
    return bins


def test_first_fit_decreasing_equals_scan():
    draw = random.Random(5)
    for n in (0, 1, 2, 7, 300):
        sizes = [draw.randint(1, 64) for _ in range(n)]
        assert packing.first_fit_decreasing(sizes, 64) == brute_first_fit(sizes, 64)


def test_group_covers_all():
    draw = random.Random(6)
    for _ in range(200):
        lengths = [draw.randint(1, draw.choice([5, 40, 300])) for _ in range(draw.randint(0, 40))]
        seen = defaultdict(list)
        for sequence in packing.pack_group(lengths, 64):
            n = sum(p[2] for p in sequence)
            assert n == 64 or n & (n - 1) == 0 and n < 64
            for doc, start, size in sequence:
                seen[doc] += range(start, start + size)
        assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}


def check(rows, docs):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    for doc_id, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(packing.packing_digest(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "x  y\n\n z", 0), (4, "<|endoftext|> tail ", 0), (5, "word " * 9000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int")
    check(packing.packing_digest(docs).collect(), [r[:2] for r in rows])
    assert packing.pack_documents(docs.limit(0)).count() == 0
    twice = packing.pack_documents(docs.union(docs)).collect()
    assert sum(len(r.ids) for r in twice if r.doc_id == 5) == 2 * next(r.doc_tokens for r in twice if r.doc_id == 5)


def test_hard_texts_fall_back():
    encode = byte_ids(tokenizer_path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for text in ("a" * 30000, " " * 30000 + "x", "\n \t" * 5000, "’s ’’ ٣٤ ½ é"):
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
