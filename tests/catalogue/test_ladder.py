import json

from starloom.streaming import ladder as L

SCHEMA = "source_id long, prompt string, reduced string"


def generator():
    def answer(k):
        return json.dumps({"source_id": str(k), "classification": {"spectral_type": "G", "luminosity_class": "V", "population_group": "Halo"}, "confidence_scores": {n + "_confidence": 0.5 for n in ("spectral_type", "luminosity", "population")}, "stellar_description": {n: "a" for n in ("physical_profile", "population_context", "notable_features")}})

    def generate(rows):
        if (rows["source_id"] == 99).any():
            raise RuntimeError("out of memory")
        late = rows["text"].str.startswith("full") & (rows["source_id"] % 3 == 0)
        return ["no" if k % 5 == 0 or wait else answer(k) for k, wait in zip(rows["source_id"], late)]

    return generate


def test_attempts_over_files_and_runs(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    rows = spark.createDataFrame([(k, f"full {k}", f"short {k}") for k in range(1, 13)], SCHEMA)
    generate = generator()  # of a function, so that workers need not import this module
    run = lambda: L.run_ladder(spark, inbox, out, state, rows.schema, generate=generate)
    rows.unionByName(rows.where("source_id < 4")).coalesce(1).write.parquet(f"{inbox}/a")  # some twice in one file
    run()
    expected = {k: 2 if k % 3 == 0 else 1 for k in range(1, 13) if k % 5}

    def results():
        return sorted((r.source_id, r.attempts) for r in spark.read.parquet(f"{out}/results").collect())

    def failed():
        return sorted((r.source_id, r.attempts, r.reason, r.last_raw) for r in spark.read.parquet(f"{out}/failed").collect())

    assert results() == sorted(expected.items())
    assert failed() == [(5, 3, "Failed after 3 attempts.", "no"), (10, 3, "Failed after 3 attempts.", "no")]
    # the same keys in a later file are not judged again, new ones are
    rows.unionByName(spark.createDataFrame([(13, "full", "short"), (99, "full", "short")], SCHEMA)).coalesce(1).write.parquet(f"{inbox}/b")
    run()
    assert {(k, n) for k, n in results()} >= set(expected.items()) and len(results()) in (len(expected), len(expected) + 1)
    assert [r[:3] for r in failed() if r[0] not in (13,)] == [(5, 3, "Failed after 3 attempts."), (10, 3, "Failed after 3 attempts."), (99, 3, "Failed after 3 attempts.")]
    assert next(r[3] for r in failed() if r[0] == 99) == "out of memory"
    before = (results(), failed())
    run()  # nothing new
    assert (results(), failed()) == before


def test_state_needs_no_python_call_for_each_key(spark):
    stream = spark.readStream.format("rate").load().selectExpr("value AS source_id", "'p' AS prompt", "0 AS attempts")
    found = L.counted(stream, "source_id")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Python" not in plan and "TransformWithState" not in plan and found.columns == stream.columns


def test_answers_of_a_batch_and_open_state_do_not_stay_on_disk(spark, tmp_path, monkeypatch):
    inbox, out, state = (str(tmp_path / n) for n in ("inbox", "out", "state"))
    name, seen, judged = "spark.sql.streaming.stateStore.unloadOnCommit", [], L.judged
    monkeypatch.setattr(L, "judged", lambda *a: seen.append(spark.conf.get(name)) or judged(*a))
    rows = spark.createDataFrame([(k, f"full {k}", f"short {k}") for k in range(1, 13)], SCHEMA)
    rows.coalesce(1).write.parquet(f"{inbox}/a")
    L.run_ladder(spark, inbox, out, state, rows.schema, generate=generator())
    assert set(seen) == {"true"} and spark.conf.get(name) == "false"
    assert not list((tmp_path / "out" / "judged").glob("batch=*"))
    assert spark.read.parquet(f"{out}/results").count() == 10 and spark.read.parquet(f"{out}/failed").count() == 2
    again = spark.read.parquet(f"{out}/again")  # what comes again still has what the generator reads
    assert again.count() > 0 and again.where("prompt is null or reduced is null").count() == 0
