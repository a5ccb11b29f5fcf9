import random
import re
import numpy as np

from starloom.llm import near_copies


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_kept(rows):
    """Smallest doc_id of every group that links of similarity 0.8 reach, all pairs compared."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y)):
                up[top(i)] = top(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), doc), doc)
    return sorted(least.values())


def family(rng, vocabulary, size, edits, copies):
    """A text and copies of it, each with ``edits`` words of its own."""
    base = [rng.choice(vocabulary) for _ in range(size)]
    texts = [" ".join(base)]
    for _ in range(copies):
        own = list(base)
        for k in rng.sample(range(size), edits):
            own[k] = rng.choice(vocabulary)
        texts.append(" ".join(own))
    return texts


def planted(seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = []
    for _ in range(12):
        texts += family(rng, vocabulary, 400, 4, 3)  # similarity about 0.9
        texts += family(rng, vocabulary, 300, 40, 2)  # far below 0.8
    texts += [texts[0].upper(), texts[0].replace(" ", "\n\t"), "one two", "One  two", "two one", "same " * 50, "same " * 70]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(d, texts[k]) for d, k in enumerate(order)]


def test_planted_families(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = near_copies.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept) == brute_kept(rows)
    assert all(dict(rows)[r.doc_id] == r.text for r in kept)


def test_large_components(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = list(enumerate(family(rng, vocabulary, 300, 1, 40)))
    monkeypatch.setattr(near_copies, "HOT_COMPONENT", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_copies.one_of_each(docs).collect()] == brute_kept(rows) == [0]


def test_odd_rows(spark):
    schema = "doc_id long, text string, node long, fps string, `row` int, `a.b` string"
    rows = [(None, "alone", 1, None, None, "x"), (None, None, None, None, None, None), (4, "", 2, "f", 3, None), (6, " \n", 2, "f", 3, None), (5, "twice " * 9, 1, "g", 2, "y"), (5, "twice " * 9, 1, "g", 2, "y"), (7, "long " * 50000, 0, "", 0, "")]
    docs = spark.createDataFrame(rows, schema)
    found = near_copies.one_of_each(docs)
    assert found.dtypes == docs.dtypes
    # null, empty and blank texts are one group; equal rows leave one
    assert sorted((r.doc_id or 0, r.node) for r in found.collect()) == [(0, 1), (4, 2), (5, 1), (7, 0)]
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_passages_added_cut_and_replaced(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        texts += [base, base + [word() for _ in range(80)], base[:335], base[:100] + [word() for _ in range(32)] + base[132:]]
        texts += [base[:200] + [word() for _ in range(90)] + base[290:]]  # below 0.8 to all others
    rows = list(enumerate(" ".join(t) for t in texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in near_copies.one_of_each(docs).collect())
    assert kept == brute_kept(rows) == sorted([*range(0, 60, 5), *range(4, 60, 5)])


def test_links_across_blocks(spark, monkeypatch):
    # Chains: every text is similar to the next one only, so no link may be lost to a split.
    rng = random.Random(13)
    words = [f"w{k}" for k in range(800)]
    rows = [(d, " ".join(words[20 * d : 20 * d + 300])) for d in range(24)]
    common = " ".join(f"c{k}" for k in range(300))
    rows += [(100 + d, common + " " + " ".join(f"x{rng.random()}" for _ in range(30 + d))) for d in range(30)]
    monkeypatch.setattr(near_copies, "HOT_COMPONENT", 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == brute_kept(rows)


def test_parities_are_a_bound():
    rng = np.random.default_rng(17)
    for size in (0, 1, 7, 60, 300, 5000):
        for shared in (0.0, 0.5, 0.88, 0.9, 1.0):
            both = rng.integers(0, 1 << 63, int(size * shared), dtype=np.uint64)
            x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, size - len(both), dtype=np.uint64)])) for _ in range(2))
            differ = int(np.bitwise_count((near_copies.parities(x) ^ near_copies.parities(y)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(x, y))
            if near_copies.alike(x, y, 0.8):
                assert near_copies.close(differ, len(x), len(y), 0.8)
    # most pairs that share little are told apart
    sets = [rng.integers(0, 1 << 63, 200, dtype=np.uint64) for _ in range(20)]
    differ = [int(np.bitwise_count((near_copies.parities(a) ^ near_copies.parities(b)).view(np.uint64)).sum()) for a in sets for b in sets if a is not b]
    assert not any(near_copies.close(d, 200, 200, 0.8) for d in differ)


def test_wide_parities_never_differ_by_more_than_the_sets():
    draw = np.random.default_rng(6)
    for n, m, both in ((0, 0, 0), (1, 0, 0), (300, 310, 290), (2000, 1500, 1400), (900, 1100, 0), (5000, 5000, 5000)):
        pool = np.unique(draw.integers(0, 1 << 63, n + m, dtype=np.uint64) << np.uint64(1))[: n + m - both]
        x, y = pool[:n], pool[n - both : n - both + m]
        apart = n + m - 2 * len(np.intersect1d(x, y))
        found = near_copies.differing(near_copies.wide_parities(x), near_copies.wide_parities(y))
        assert found <= apart and found % 2 == apart % 2
        if not both and n + m > 100:
            assert not near_copies.close(found, len(x), len(y), 0.8)
