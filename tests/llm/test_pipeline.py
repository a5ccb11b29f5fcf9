import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from starloom.llm import quality
from starloom.llm.common import stored, tokenizer_path
from test_models import brute_base
from test_near_copies import brute_kept
from test_suffixes import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = []
    for name, stage in cp.STAGES[:-1]:
        own = stored(stage(spark, docs, SF), "test-stage")
        assert own.columns == docs.columns and own.dtypes == docs.dtypes
        after.append([docs.collect(), own.collect()])
        docs = own
    forest = quality.fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    before, kept = after[0]
    good = forest.scores(quality.statistics([r.text.encode() for r in before])) >= 0.5
    assert {r.doc_id for r in kept} == {r.doc_id for r, g in zip(before, good) if g}
    before, kept = after[1]
    assert sorted(r.doc_id for r in kept) == brute_kept([(r.doc_id, r.text) for r in before])
    before, kept = after[2]
    lost = {r.doc_id: b[1] for r, b in zip(before, brute([r.text.encode() for r in before]))}
    assert len(before) == len(kept)
    text = {r.doc_id: r.text for r in before}
    assert all((r.text == text[r.doc_id]) == (lost[r.doc_id] == 0) for r in kept)
    before, kept = after[3]
    assert len(before) == len(kept) and not any(brute_base(r.text) for r in kept)
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    pieces = {}
    for r in cp.packing_stage(spark, docs, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in kept:
        ids = [i for _, part in sorted(pieces[r.doc_id]) for i in part]
        assert ids == [*library.encode(r.text, add_special_tokens=False).ids, 0]


def test_odd_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(None, "alone and without a number, but with words enough to stand", "en", "s", 1), (None, None, None, None, None), (3, "", "en", None, 0), (5, "twice " * 40, "en", "s", 9), (5, "twice " * 40, "en", "s", 9), (6, "twice " * 40, "en", "s", 9), (7, "word " * 30000, "en", "s", None)]
    docs = spark.createDataFrame(rows, base.schema)
    found = cp.near_duplicate_stage(spark, docs, SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [(False, 3), (False, 5), (False, 7), (True, 0)]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() > 0 or name == "quality classifier"


def test_any_columns_go_through_all_stages(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    names = ["key", "mark", "row", "a.b", "__key", "node", "name", "fp", "score", "predicted", "digest", "slots", "k"]
    docs = base.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    more = spark.createDataFrame([(None, None, None, None, None), (5, "twice " * 40, "en", "s", 9), (5, "twice " * 40, "en", "s", 9)], base.schema)
    docs = docs.unionByName(more.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]))
    for _, stage in cp.STAGES[:-1]:
        own = stored(stage(spark, docs, SF), "test-odd")
        assert own.dtypes == docs.dtypes and own.count() > 0
        assert own.select(*[f"`{n}`" for n in names]).distinct().collect() == [tuple(range(len(names)))]
        docs = own
    assert cp.packing_stage(spark, docs, SF).count() > 0


def test_run(spark):
    out = cp.run(spark, SF)
    fills = {r.sequence_id: r.n for r in out.groupBy("sequence_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert np.mean([n == 1024 for n in fills.values()]) > 0.5 and max(fills.values()) <= 1024
