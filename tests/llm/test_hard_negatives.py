import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import hard_negatives as H

SHAPE = "vec_id long, embedding array<double>, label int, ids string, score int"


def brute(rows, scale=256, shift=7, positives=5, negatives=5):
    kept = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((vec_id, [math.floor(c * scale) for c in x], (label + 1) % 10 if vec_id % shift == 0 else label))
    out = []
    for a, (anchor, q, label) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(s * t for s, t in zip(q, x)), vec_id, own == label) for b, (vec_id, x, own) in enumerate(kept) if b != a)
        for s, vec_id, _ in [r for r in scored if r[2]][:positives]:
            fit = [r for r in scored if not r[2] and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(anchor, vec_id, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fit)]
    return sorted(out)


def found(spark, rows, parts=3):
    df = spark.createDataFrame([(i, x, label, "clash", 1) for i, x, label in rows], SHAPE).repartition(parts)
    got = H.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def cloud(n, size, labels, seed, spread=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, size))
    return [(k, (centres[k % labels] + spread * draw.normal(size=size)).tolist(), int(draw.integers(labels))) for k in range(n)]


def small(monkeypatch):
    """Many trees, leaves, turns and copies on little data."""
    for name, value in (("TREE", 64), ("LEAF", 8), ("FIRST", 100), ("GROWTH", 3), ("ANCHORS", 4), ("VISITS", 2), ("DEALT", 1)):
        monkeypatch.setattr(H, name, value)


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force_over_many_trees(spark, monkeypatch, seed):
    small(monkeypatch)
    rows = cloud(1200, 4, 5, seed, 0.3)
    assert found(spark, rows) == brute(rows)


def test_hot_vector_ties_and_repeated_rows(spark, monkeypatch):
    small(monkeypatch)
    draw = random.Random(4)
    rows = [(k, [0.5, 0.25], k % 3) for k in range(0, 900, 3)]  # a third of all, one vector
    rows += [(k, [draw.choice([0.5, 0.25, 1.0, -1.0]), draw.choice([0.25, 0.0, 0.5])], draw.randint(0, 2)) for k in range(900) if k % 3]
    rows += [rows[100], rows[100], (100, [0.5, 0.25], 1), (100, [0.5, 0.25], 1), (200, [0.0, 0.0], 2), (200, [0.0, 0.0], 2), (300, [-0.1, 0.0], 1)]
    assert found(spark, rows) == brute(rows)


def test_invalid_rows_short_vectors_and_long_numbers(spark):
    rows = cloud(300, 3, 3, 8)
    rows += [(400, None, 1), (500, [1.0, None, 1.0], 1), (600, [float("nan"), 1.0, 0.0], 1), (700, [float("inf"), 1.0, 0.0], 2), (800, [1.0, 0.5, 0.25], None), (None, [1.0, 1.0, 1.0], 1), (900, [], 1), (1000, [0.75], 2), (1100, [0.5, 0.5], 0)]
    assert found(spark, rows) == brute(rows)
    long_ones = [(k, [c * 1e5 for c in x], label) for k, x, label in cloud(250, 3, 3, 9)]  # squares beyond 2**52
    assert found(spark, long_ones) == brute(long_ones)


def test_few_rows_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []
    rows = [(100, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]
    assert found(spark, rows) == brute(rows) == [(100, 1, 1, 2, 65536, 58880)]


def test_bounds_hold_every_score():
    draw = np.random.default_rng(5)
    space = H.Space(6, 0.0)
    x = np.floor(draw.normal(size=(700, 6)) * 256)
    space.largest = float(np.sqrt((x * x).sum(axis=1)).max())
    order, cell = H.Tree.build(space, [v.tobytes() for v in x], [0] * 700, 1)
    tree = H.Tree(space, *cell)
    assert (tree.x == x[order]).all()
    q = np.floor(draw.normal(size=(9, 6)) * 256)
    least, most = tree.bounds(space, q)
    s = q @ tree.x.T
    for leaf in range(len(tree.starts) - 1):
        own = s[:, tree.starts[leaf] : tree.starts[leaf + 1]]
        if own.shape[1]:
            assert (own <= most[:, leaf, None]).all() and (own >= least[:, leaf, None]).all()
    assert (most < s.max()).any()  # some leaves can be left out
