import re
import time
import zlib
from collections import Counter
from math import isclose, log10

import numpy as np
import xxhash

from starloom.llm import lattice_lm, simhash
from starloom.llm.common import tokenizer_path


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    left, comp = set(range(len(fps))), {}
    for i in range(len(fps)):
        if i in left:
            left.discard(i)
            queue, own = [i], [i]
            while queue:
                a = queue.pop()
                new = [b for b in left if bin(fps[a] ^ fps[b]).count("1") <= 3]
                left -= set(new)
                own += new
                queue += new
            comp |= {b: own for b in own}
    return comp


def test_near_duplicates(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    texts += [(i + 900, t) for i, t in enumerate([None, "", " \n", "one", "One two", "one two three", "A b c a b c", "ΣA É x", "w " * 70000])] + [(None, "one"), (905, "one two three")]
    frame = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, fp int")
    fps = [brute_fingerprint(t) for _, t in texts]
    comp = brute_components(fps)
    expected = Counter((texts[i][0], f"{fps[i]:016x}", min((texts[j][0] for j in comp[i] if texts[j][0] is not None), default=None)) for i in range(len(texts)))
    got = simhash.near_duplicates(frame).select("doc_id", simhash.hexadecimal().alias("f"), "component_id").collect()
    assert Counter(tuple(r) for r in got) == expected
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_links_join_all(spark, monkeypatch):
    draw = np.random.default_rng(8)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(seeds.tolist())
    for s in seeds.tolist():  # chains of near fingerprints
        for _ in range(15):
            for bit in draw.integers(0, 64, draw.integers(1, 5)).tolist():
                s ^= 1 << bit
            fps.add(s)
    fps = sorted(fps)
    expected = brute_components(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for hot, compared in ((10**6, 1024), (3, 4)):
        monkeypatch.setattr(simhash, "HOT_GROUP", hot)
        monkeypatch.setattr(simhash, "COMPARED", compared)
        root = {r.node % (1 << 64): r.root for r in simhash.components(simhash.linked(frame)).collect()}
        groups = {}
        for i, f in enumerate(fps):
            groups.setdefault(root.get(f, f - (1 << 64) if f >> 63 else f), set()).add(i)
        assert {frozenset(g) for g in groups.values()} == {frozenset(x) for x in expected.values()}


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (200, 201), (201, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100 and got[201] == 200


def brute_word(lattice, pieces, word):
    """Sum over all segmentations, one by one."""
    whole = b" " + word

    def rest(at):
        if at == len(whole):
            return 1.0
        total = np.exp(lattice.bytes[whole[at]]) * rest(at + 1)
        for end in range(at + 1, len(whole) + 1):
            if whole[at:end] in pieces:
                total += np.exp(pieces[whole[at:end]]) * rest(end)
        return total

    return log10(rest(0))


def pieces_of(path, counts, ends):
    """Log probabilities of pieces, bytes and the end, from the file and the counts."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(m.get_piece_size()) if not m.is_control(i) and not m.is_unknown(i)]
    best = max(m.get_score(i) for i in own if not m.is_byte(i))
    zipf = {i: 1 / (2 + best - m.get_score(i)) for i in own if not m.is_byte(i)}
    zipf |= {i: min(zipf.values()) for i in own if m.is_byte(i)}
    weight = {i: counts.get(i, 0) + 0.1 + 2000 * zipf[i] / sum(zipf.values()) for i in own}
    total = sum(weight.values()) + ends + 0.1
    pieces = {m.id_to_piece(i).replace("▁", " ").encode(): np.log(weight[i] / total) for i in own if not m.is_byte(i)}
    single = {int(m.id_to_piece(i)[3:5], 16): np.log(weight[i] / total) for i in own if m.is_byte(i)}
    return m, {p: v for p, v in pieces.items() if b" " not in p[1:]}, single, np.log((ends + 0.1) / total)


class Brute:
    def __init__(self, single):
        self.bytes = single


def test_lattice_against_enumeration():
    path = tokenizer_path("piece_bpe_32k.model")
    counts = {i: float(i % 7) for i in range(32000)}
    lattice = lattice_lm.Lattice(path, counts, 5.0)
    _, pieces, single, end = pieces_of(path, counts, 5.0)
    words = [b"a", b"the", b"token", "été".encode(), b"xq$", b"ation", "你".encode(), "▁x".encode()]
    assert np.allclose(lattice.scores(words), [brute_word(Brute(single), pieces, w) for w in words]) and np.isclose(lattice.end, end)
    total = sum(np.exp(v) for v in pieces.values()) + sum(np.exp(v) for v in single.values()) + np.exp(lattice.end)
    assert total <= 1 + 1e-9


def test_long_words(monkeypatch):
    lattice = lattice_lm.Lattice(tokenizer_path("piece_bpe_32k.model"), {i: float(i % 5) for i in range(32000)}, 5.0)
    draw = np.random.default_rng(4)
    words = [draw.choice(list(b"etaoin shrdlu".replace(b" ", b"")), n).astype(np.uint8).tobytes() for n in (1, 2, 40, 300, 511)]
    short = lattice.scores(words)
    for stretch in (1 << 16, 37):
        monkeypatch.setattr(lattice_lm, "LONG", 1)
        monkeypatch.setattr(lattice_lm, "STRETCH", stretch)
        assert np.allclose(lattice.scores(words), short)
    began = time.perf_counter()
    assert np.isfinite(lattice.scores([b"z" * 5000, bytes(range(33, 127)) * 4000])).all()
    assert time.perf_counter() - began < 30


def test_document_scores_against_enumeration(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    texts = ["the cat sat", "A cat, the", "sat on été", "", None, "the the zq$", "on a cat mat"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    assert any(held) and not all(held)
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split() for t in texts]
    m = pieces_of(path, {}, 0)[0]
    counts = Counter(i for w, h in zip(words, held) if not h for x in w for i in m.encode(x.decode()))
    _, pieces, single, end = pieces_of(path, counts, held.count(False))
    expected = {d: sum(brute_word(Brute(single), pieces, x) for x in w) + end / np.log(10) for d, w in enumerate(words)}
    for frequent in (0, 100_000):
        got = {r.doc_id: r.score for r in lattice_lm.score_documents(frame, frequent=frequent).collect()}
        assert got.keys() == expected.keys() and all(isclose(got[d], expected[d], rel_tol=1e-9) for d in got)


def test_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "the THE"), (1001, None), (1002, ""), (1003, "unheardofword é"), (7, "again again"), (7, "again again")]
    frame = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, word string")

    def words(text):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]

    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (i, t), h in zip(rows, held) if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    expected = sorted((str(i), h, len(words(t)), sum(w in c for w in words(t)), n, round(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for (i, t), h in zip(rows, held))
    for frequent in (0, 50, 100_000):
        got = lattice_lm.score_documents(frame, frequent=frequent).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
        scores = sorted(round(r.score, 6) for r in got)
        assert frequent == 0 or np.allclose(scores, last)
        last = scores
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert lattice_lm.score_documents(frame.limit(0)).count() == 0
    alone = lattice_lm.score_documents(frame.where("text = 'again again'").limit(1)).first()
    assert alone.n_tokens == 3 and alone.train_tokens == (0 if alone.held_out else 3)
