"""Quality rules: a linear-chain CRF marks the lines of a text as content or boilerplate.

Each line is described by binned counts; Viterbi decoding over the lines of the whole text
labels them, and a text is kept where content lines hold at least half of its characters.

The CRF learns from document labels: lines of documents labelled good are content, lines of
documents labelled bad start as boilerplate; after a first fit, lines of bad documents that the
model takes for content become content, and it is fitted once more. It learns from the
SAMPLE labelled documents with the smallest hash; fitting and decoding cover all lines of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm import crf
from starloom.llm.common import labelled_sample, small_batches, text_bytes
from starloom.llm.docstats import BANG, CONTINUED, DIGIT, END, LOWER, NEWLINE, OTHER, PUNCT, SPACE, SYMBOL, UPPER, Lines

SAMPLE = 4000
CONTENT, BOILERPLATE = 0, 1
SHARE = 0.5
#: Bin edges of each slot.
EDGES = {
    "words": [1, 2, 4, 8, 16, 32],
    "symbols": [0.001, 0.02, 0.05, 0.1, 0.2],
    "upper": [0.001, 0.05, 0.15, 0.3, 0.6],
    "digits": [0.001, 0.05, 0.2, 0.5],
    "bangs": [0.001, 0.05, 0.1],
    "repeated": [0.001, 0.25, 0.5, 0.75],
    "word_length": [2, 3.5, 5, 7, 9, 14],
    "punctuation": [0.001, 0.03, 0.08, 0.15],
    "seen": [1],
    "ends": [1],
    "place": [1, 2],
}
WIDTH = max(len(e) for e in EDGES.values()) + 1
ROWS = len(EDGES) * WIDTH


def line_slots(lines: Lines) -> np.ndarray:
    """Rows of the weight table for every line."""
    c = lines.counts
    shown = c.sum(axis=1) - c[:, SPACE] - c[:, NEWLINE] - c[:, CONTINUED]
    some = np.maximum(shown, 1)
    words = np.maximum(lines.words, 1)
    ends = np.cumsum(lines.lines)
    place = np.ones(len(c))
    place[ends - lines.lines] = 0
    place[ends - 1] = 2
    values = {
        "words": lines.words,
        "symbols": c[:, SYMBOL] / some,
        "upper": c[:, UPPER] / np.maximum(c[:, UPPER] + c[:, LOWER], 1),
        "digits": c[:, DIGIT] / some,
        "bangs": c[:, BANG] / some,
        "repeated": lines.repeated / words,
        "word_length": shown / words,
        "punctuation": c[:, PUNCT] / some,
        "seen": lines.seen,
        "ends": (c[:, END] > 0).astype(int),
        "place": place,
    }
    return np.stack([k * WIDTH + np.digitize(values[name], edges) for k, (name, edges) in enumerate(EDGES.items())], axis=1)


def fit_lines(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> crf.Chain:
    """Fit the CRF; without labels of both kinds every line counts as content."""
    small_batches(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if not texts:
                continue
            lines = Lines(texts)
            slots = line_slots(lines).astype(np.int16)
            ends = np.cumsum(lines.lines)
            whole = [slots[e - n : e] for e, n in zip(ends, lines.lines)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x.tobytes() for x in whole], pa.binary())], ["quality", "slots"])

    rows = labelled_sample(docs, labels, sample).select("text", "quality").mapInArrow(described, "quality int, slots binary").collect()
    rows = sorted((r.quality, bytes(r.slots)) for r in rows)
    if len({q for q, _ in rows}) < 2:
        return crf.Chain(np.zeros((ROWS, 2)), np.zeros((2, 2)))
    parts = [np.frombuffer(x, dtype=np.int16).reshape(-1, len(EDGES)).astype(np.int64) for _, x in rows]
    lengths = np.array([len(p) for p in parts])
    slots = np.concatenate(parts)
    bad = np.repeat(np.array([q == 0 for q, _ in rows]), lengths)
    gold = np.where(bad, BOILERPLATE, CONTENT)
    chain = crf.fit(slots, gold, lengths, ROWS, 2, decay=1e-3)
    for _ in range(2):
        found = crf.viterbi(chain.emissions(slots), lengths, chain.moves)
        gold = np.where(bad & (found == BOILERPLATE), BOILERPLATE, CONTENT)
        chain = crf.fit(slots, gold, lengths, ROWS, 2, decay=1e-3)
    return chain


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


def judge_lines(docs: DataFrame, chain: crf.Chain, share: float = SHARE) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    A null or empty text has no words, so base_failed is true and kept false. content_share is
    the share of characters (without white space) in content lines, 1 where there are none.
    Rows with equal or null doc_id are judged one by one; columns besides doc_id and text are not
    read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not texts:
                continue
            lines = Lines(texts)
            c = lines.counts
            shown = c[:, [PUNCT, LOWER, UPPER, DIGIT, SYMBOL, OTHER, END, BANG]].sum(axis=1)
            label = crf.viterbi(chain.emissions(line_slots(lines)), lines.lines, chain.moves)
            chars = lines.per_text(shown)
            good = lines.per_text(np.where(label == CONTENT, shown, 0)) / np.maximum(chars, 1)
            good[chars == 0] = 1.0
            failed = (lines.n_words < 50) | (100 * lines.n_repeat_words > 50 * lines.n_words)
            columns = [lines.n_words, chars, lines.per_text(c[:, SYMBOL]), lines.n_dup_lines, lines.n_repeat_words, failed, good, ~failed & (good >= share)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in columns)], [f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, SCHEMA)
