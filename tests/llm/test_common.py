from collections import Counter

import pytest

from starloom.llm import common
from starloom.llm.common import labelled_sample, spread_join, stored


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "MOST_HOT", 100)
    rows = [(None, -1)] + [(1 if k % 3 == 0 else k, k) for k in range(3000)]
    big = stored(spark.createDataFrame(rows, "key long, other long"), "big")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(0, 3000, 2)] + [(1, "one")], "key long, value string")
    for by in (None, "other"):
        for how in ("inner", "left"):
            got = Counter(map(tuple, spread_join(big, small, "key", how, by=by).select("key", "other", "value").collect()))
            assert got == Counter(map(tuple, big.join(small, "key", how).select("key", "other", "value").collect()))


def test_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, "same")] * 500 + [(0, "a"), (0, "b"), (7, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (0, 0), (7, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    assert not {r.id for r in spark.range(6).where(common.held_out(3, "id")).collect()} & {0, 1}
    found = labelled_sample(docs, labels, 10).collect()
    assert sorted((r.doc_id, r.quality) for r in found) == [(0, 0), (1, 1)]
    assert labelled_sample(docs, labels, 1).count() == 1
    assert labelled_sample(docs.limit(0), labels, 10).count() == 0


def test_shared_folder_has_to_be_named_on_a_cluster():
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError):
        common.shared_dir(Session())
