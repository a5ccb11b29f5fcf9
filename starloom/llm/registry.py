"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.llm import best_fit, bpe, divergence, hard_negatives, lattice_lm, line_rules, packing, pivot_search, quality, secret_scan, simhash, store, suffixes
from starloom.llm.common import fresh_path, table


def op1_pivot_search(spark, sf_dir):
    return pivot_search.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_suffix_dedup(spark, sf_dir):
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


def op3_quality_trees(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_line_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return line_rules.judge_lines(docs, line_rules.fit_lines(docs, table(spark, sf_dir, "labels")))


def op5_bpe_round_trip(spark, sf_dir):
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op6_lattice_lm(spark, sf_dir):
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"))


def op7_packing(spark, sf_dir):
    return packing.packing_digest(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op9_token_store(spark, sf_dir):
    folder = store.write_store(table(spark, sf_dir, "documents"), fresh_path(spark, "op9"))
    return store.verify_documents(spark, folder)


def op10_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.fit_secrets(docs))


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_best_fit(spark, sf_dir):
    return best_fit.best_fit_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pivot_search, op2_suffix_dedup, op3_quality_trees, op4_line_rules, op5_bpe_round_trip, op6_lattice_lm, op7_packing, op8_simhash, op9_token_store, op10_secret_scan, op11_hard_negatives, op12_source_divergence, op13_best_fit)}
SQL: dict[str, str] = {"op1_pivot_search": pivot_search.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_source_divergence": divergence.SQL}


def llm_queries() -> dict:
    return dict(QUERIES)


def llm_sql() -> dict:
    return dict(SQL)
