import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from starloom.llm import suffixes


def test_two_stage_order_equals_sorting():
    draw = random.Random(3)
    for _ in range(300):
        data = bytes(draw.choices(draw.choice([b"ab", b"abc", bytes(range(256)), b"\x00\xff", b"a"]), k=draw.randint(0, 60)))
        if draw.random() < 0.5:
            data = data * draw.randint(1, 4)
        depth = draw.choice([1, 2, 5, 1000])
        order = suffixes.two_stage_order(data, depth)
        assert sorted(order.tolist()) == list(range(len(data)))
        assert [data[i:][:depth] for i in order] == sorted(data[i:][:depth] for i in range(len(data)))


def test_repeated_starts():
    draw = random.Random(4)
    for _ in range(100):
        parts = [bytes(draw.choices(b"ab", k=draw.randint(9, 40))) for _ in range(draw.randint(1, 6))]
        windows = Counter(p[i : i + 9] for p in parts for i in range(len(p) - 8))
        found, first = suffixes.repeated_starts(parts, 9)
        kinds = [p[i : i + 9] for p, f in zip(parts, first) for i in np.flatnonzero(f)]
        assert len(kinds) == len(set(kinds)) == len(windows)
        assert [f.tolist() for f in found] == [[windows[p[i : i + 9]] > 1 for i in range(len(p) - 8)] for p in parts]


def brute(texts):
    windows = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=np.int8)
        for i in range(len(t) - 199):
            if windows[t[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        spans = int((np.diff(np.concatenate([[0], gone])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def odd_texts():
    draw = random.Random(9)
    noise = lambda n: "".join(draw.choices("abcdefgh é\n", k=n))
    shared, edge = noise(450), noise(200)
    texts = [None, "", "short", noise(900), shared[:300] + noise(50) + shared, noise(70) + shared + noise(70) + edge, edge, edge[:199], edge[1:] + "x", "ab" * 700, "x" * 5000, noise(40) + "x" * 210]
    texts += [noise(300) + shared[100:320] + noise(10) + shared[280:] for _ in range(4)]
    copy = noise(700)
    return texts + [copy, copy, copy[:350] + noise(90), "Nd, " * 90, "short", noise(250)]


def check_removal(spark, texts):
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    got = sorted(((r.doc_id is not None, r.doc_id or 0), *tuple(r)[1:]) for r in suffixes.removal_report(docs).collect())
    found = brute([(t or "").encode() for t in texts])
    assert got == sorted(((i != 3, 0 if i == 3 else i // 2), *f) for i, f in enumerate(found))


def test_removal_equals_brute_force(spark):
    check_removal(spark, odd_texts())


def test_small_limits_change_nothing(spark, monkeypatch):
    # buckets of every size are split into blocks of a few segments
    for name, value in (("HOT_BYTES", 0), ("ARRAY_BYTES", 900), ("REMEMBERED", 2), ("HELD", 3), ("BROADCAST", 2)):
        monkeypatch.setattr(suffixes, name, value)
    draw = random.Random(12)
    noise = lambda n: "".join(draw.choices("abcdefgh é\n", k=n))
    license_line = noise(260)
    check_removal(spark, odd_texts() + [noise(draw.randint(0, 90)) + license_line + noise(draw.randint(0, 90)) for _ in range(40)])


def test_small_pieces_hold_every_window(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 300)
    monkeypatch.setattr(suffixes, "LONGEST", 20)
    for text in odd_texts():
        own = (text or "").encode()
        first, n, _, _ = suffixes.segments(own)
        assert sorted(k for a, m in zip(first, n) for k in range(a, a + m)) == list(range(max(0, len(own) - 199)))


def test_any_column_names(spark):
    names = ["key", "mark", "packed", "marks", "__key", "__marks", "row", "a.b", "size", "kept", "n_spans", "digest"]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate([None, "", "z" * 500, "q w" * 200, "plain"])], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = suffixes.remove_repeats(docs)
    assert got.dtypes == docs.dtypes
    rows = {r.doc_id: r for r in got.collect()}
    assert [rows[i].text for i in range(5)] == [None, "", "", "", "plain"]
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in rows.values())
    assert suffixes.remove_repeats(docs.select("text")).columns == ["text"]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.removal_report(docs).collect()}
    assert got == dict(zip([r.doc_id for r in rows], brute([r.text.encode() for r in rows])))
    assert suffixes.removal_report(docs.limit(0)).count() == 0
    cut = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert suffixes.remove_repeats(docs).columns == docs.columns
    for r in rows:
        n_bytes, n_removed, n_spans, _ = got[r.doc_id]
        assert cut[r.doc_id].n_chars == len(cut[r.doc_id].text)
        assert (cut[r.doc_id].text == r.text) == (n_spans == 0)


def test_sorting_holds_few_suffixes_at_once():
    import tracemalloc

    draw = np.random.default_rng(5)
    data = draw.integers(97, 105, 200_000, dtype=np.uint8).tobytes() + b"\0" * 300 + b"ab" * 500
    tracemalloc.start()
    order = suffixes.two_stage_order(data, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    keys = [data[i : i + 200] for i in order.tolist()]
    assert sorted(order.tolist()) == list(range(len(data))) and all(a <= b for a, b in zip(keys, keys[1:]))
    assert peak < 80 * len(data)
