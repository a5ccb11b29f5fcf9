import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from starloom.llm import divergence as D

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=10):
    docs, counts, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = PATTERN.findall((text or "").translate(LOWER))
        langs[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        share = lambda n, N: 1 + 10**9 * (n + 2) // (N + 2 * v)
        differ = lambda p, q: (p - q) ** 2 // (p + q)
        whole = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        for s in sources:
            pair = sorted((-sum(differ(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            term = sorted((-differ(p[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > whole[t])[:top]
            for part, found in (("pair", pair), ("term", term)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out)


def texts(n, seed, sources=6):
    draw = random.Random(seed)
    words = [w + x for w in ("Star", "LIGHT", "über", "señal", "ÀB", "zz", "日本", "q") for x in ("", "a", "B", "ß", "é", "xy")]
    rows = []
    for _ in range(n):
        s = draw.choice([0, 0, 0, *range(sources)])
        own = draw.choices(words, [1 + (k * (s + 3)) % 11 for k in range(len(words))], k=draw.randint(0, 40))
        rows.append((draw.choice([" ", "\n", "-", "1", "_"]).join(own), draw.choice(["en", "en", "de", None]), f"src{s}"))
    return rows


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, item string").repartition(3)
    return sorted(tuple(r) for r in D.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("options", [{}, {"shard_rows": 7}, {"most_groups": 0}])
def test_equals_brute_force(spark, options):
    rows = texts(400, 1)
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("Same same", None, None), ("lonely word", "it", "a"), ("other word", "it", "b"), ("a\x00b A\x7fB", "en", "src1")]
    assert found(spark, rows, **options) == brute(rows)


def test_hot_source_repeated_rows_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD_TERMS", 20)
    rows = texts(60, 2) + [("Boiler plate line", "en", "src0")] * 700 + [("word " * 100_000 + "Ünique", "en", "src1")]
    rows += [(f"rare{k} TAIL", "en", "src2") for k in "abcdefghij"]
    assert found(spark, rows, least=5, top=3) == brute(rows, 5, 3)


def test_empty_table_and_no_kept_terms(spark):
    assert found(spark, []) == []
    rows = [("a", "en", "x"), ("b", "en", "y"), (None, None, None)]
    assert found(spark, rows) == brute(rows) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_sql_equals_brute_force():
    rows = texts(300, 5)
    documents = pa.table({c: pa.array(list(v), pa.string()) for c, v in zip(("text", "lang", "source"), zip(*rows))})  # noqa: F841
    assert sorted(tuple(r) for r in duckdb.sql(D.SQL).fetchall()) == brute(rows)


def test_runs_hold_whole_terms():
    rows = pa.table({"lang": ["en"] * 9, "term": list("aabbbbbcd"), "source": list("xyxyzuvxx"), "n": [1] * 9})
    cut = list(D._runs(rows.to_batches(max_chunksize=2), lambda t: t, 3))
    assert pa.concat_tables(cut).to_pylist() == rows.to_pylist()
    places = [{t: None for t in c["term"].to_pylist()} for c in cut]
    assert sum(map(len, places)) == 4
