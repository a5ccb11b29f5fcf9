import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from starloom.llm import best_fit
from starloom.llm.common import tokenizer_path


def brute_best_fit(lengths, room):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(room - n)
    return free


def expanded(runs):
    """place: (sequence, offset, length)"""
    found = {}
    for r in runs:
        for k in range(r.count):
            assert r.first + k not in found
            found[r.first + k] = (r.sequence + k // r.each, r.offset + k % r.each * r.length, r.length)
    return found


def held(runs, histogram):
    room = len(histogram) - 1
    found = expanded(runs)
    lengths = [n for n in range(room, 0, -1) for _ in range(int(histogram[n]))]
    assert sorted(found) == list(range(len(lengths)))
    assert [found[i][2] for i in range(len(lengths))] == lengths
    sequences = defaultdict(list)
    for sequence, offset, length in found.values():
        sequences[sequence].append((offset, length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    return sequences


def test_runs_of_best_fit_equal_pieces_one_by_one():
    draw = random.Random(3)
    for _ in range(60):
        room = draw.choice([10, 33, 64])
        lengths = [draw.randint(1, room) for _ in range(draw.randint(0, 120))]
        histogram = np.bincount(lengths or [0], minlength=room + 1)
        histogram[0] = 0
        before = np.cumsum(histogram[::-1])[::-1] - histogram
        runs, sequences = best_fit.best_fit([(n, int(before[n]), int(histogram[n])) for n in range(1, room + 1) if histogram[n]], best_fit.Rooms(), room, 0)
        free = brute_best_fit(lengths, room)
        assert sequences == len(free)
        fills = sorted(sum(n for _, n in own) for own in held(runs, histogram).values())
        assert fills == sorted(room - f for f in free)


def test_configurations_reach_the_optimum_of_a_known_case():
    # 60 + 40 and 50 + 50 fill sequences of 100 without waste
    found = best_fit.configurations([60, 50, 40], [40, 20, 40], 100)
    assert sum(often for _, often in found) == 50
    assert Counter({g: sum(p.get(g, 0) * often for p, often in found) for g in range(3)}) == Counter({0: 40, 1: 20, 2: 40})
    # three of 33 and one of 1 are dearer than any pair
    assert sum(often for _, often in best_fit.configurations([33, 1], [300, 100], 100)) == 100


def test_groups_have_equal_numbers_and_cover_the_large():
    histogram = np.zeros(101, dtype=np.int64)
    histogram[[100, 90, 80, 70, 5]] = [3, 4, 8, 4, 50]
    found = best_fit.linear_groups(histogram, 10, 4)
    assert found == [(90, 3, 4), (80, 7, 8), (70, 15, 4)]
    assert best_fit.linear_groups(np.zeros(11, dtype=np.int64), 2, 4) == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_whole_and_tight(seed):
    draw = np.random.default_rng(seed)
    lengths = np.clip((draw.gamma(2.0, 120.0, 4000) if seed % 2 else draw.integers(1, 257, 4000)).astype(int), 1, 256)
    if seed == 2:
        lengths[:1300] = 129  # a third of all pieces of one length, which pairs with none of its own
    histogram = np.bincount(lengths, minlength=257)
    runs, sequences = best_fit.packing_plan(histogram, groups=40)
    assert len(held(runs, histogram)) == sequences
    assert sequences >= -(-int(lengths.sum()) // 256)
    assert sequences <= len(brute_best_fit(lengths.tolist(), 256)) + 1


def test_plan_of_nothing_and_of_whole_sequences():
    assert best_fit.packing_plan(np.zeros(9, dtype=np.int64)) == ([], 0)
    histogram = np.zeros(9, dtype=np.int64)
    histogram[8] = 5
    assert best_fit.packing_plan(histogram)[1] == 5


def test_actual_pieces_stay_in_their_groups():
    histogram = np.zeros(65, dtype=np.int64)
    histogram[[40, 39, 38, 24, 23, 22]] = [5, 5, 5, 5, 5, 5]
    groups = [(40, 0, 15), (24, 15, 15)]
    runs, left, rooms, sequences = best_fit.substituted(groups, [({0: 1, 1: 1}, 15)], histogram, 0.5)
    assert sequences == 15 and not left
    held(runs, histogram)
    assert {free: sum(n for _, n in own) for free, own in rooms.runs.items()} == {2: 5, 4: 5}


def test_pieces_of_documents(spark):
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    draw = random.Random(9)
    texts = ["", None, "a", "long words " * 900, "x" * 5000, "same text here"] + ["same text here"] * 40
    texts += [" ".join(draw.choice(["star", "light", "über", "of", "12"]) for _ in range(draw.randint(0, 700))) for _ in range(150)]
    docs = spark.createDataFrame([(k if k != 7 else None, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, part int").repartition(5)
    rows = best_fit.pack_best_fit(docs).collect()
    digest = best_fit.best_fit_digest(docs).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length, zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in rows) == sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in digest)
    for found in (rows, digest):
        sequences = defaultdict(list)
        for r in found:
            sequences[r.sequence_id].append(r)
        for own in sequences.values():
            at = 0
            for r in sorted(own, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= 1024
    documents = defaultdict(list)
    for r in rows:
        documents[r.doc_id].append(r)
    for doc_id, own in documents.items():
        text = texts[7 if doc_id is None else doc_id] or ""
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [i for r in own for i in r.ids] == ids
        assert all(r.length == 1024 for r in own[1:]) and len(own) == -(-len(ids) // 1024)
        assert all(r.start == sum(o.length for o in own[:k]) for k, r in enumerate(own))
    assert len({r.sequence_id for r in rows}) <= len(brute_best_fit([r.length for r in rows], 1024)) + 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert best_fit.best_fit_digest(empty).collect() == []
    assert best_fit.pack_best_fit(empty).collect() == []
