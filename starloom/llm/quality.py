"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are quantised to at most BINS bins at quantiles of the fitting sample; every tree
grows by the best gain over bin histograms of gradients. A fitted forest is flattened into
arrays (feature, threshold, left, right, value), and all documents of a batch walk down all
trees together by numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.common import held_out, labelled_sample, small_batches, text_bytes
from starloom.llm.docstats import BANG, CONTINUED, DIGIT, END, LOWER, NEWLINE, OTHER, PUNCT, SPACE, SYMBOL, UPPER, Lines

#: Labelled documents that the forest is fitted on at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAF, L2 = 80, 5, 64, 0.15, 12, 1.0
FEATURES = ("log_words", "log_lines", "word_length", "symbols", "upper", "digits", "bangs", "punctuation", "ends", "blank", "beyond_ascii", "dup_lines", "repeat_words", "distinct_words", "line_words", "symbol_words", "long_lines")


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each whole text; an empty text has zeros."""
    lines = Lines(texts)
    c = lines.per_text(lines.counts).astype(float)
    chars = c.sum(axis=1) - c[:, CONTINUED]
    shown = np.maximum(chars - c[:, SPACE] - c[:, NEWLINE], 1)
    words = np.maximum(lines.n_words, 1)
    symbol_lines = lines.counts[:, SYMBOL] > 0.02 * np.maximum(lines.counts.sum(axis=1), 1)
    columns = [
        np.log1p(lines.n_words),
        np.log1p(lines.lines),
        shown / words,
        c[:, SYMBOL] / shown,
        c[:, UPPER] / np.maximum(c[:, UPPER] + c[:, LOWER], 1),
        c[:, DIGIT] / shown,
        c[:, BANG] / shown,
        c[:, PUNCT] / shown,
        c[:, END] / words,
        (c[:, SPACE] + c[:, NEWLINE]) / np.maximum(chars, 1),
        c[:, OTHER] / shown,
        lines.n_dup_lines / lines.lines,
        lines.n_repeat_words / words,
        lines.n_distinct / words,
        lines.n_words / lines.lines,
        lines.per_text(symbol_lines.astype(np.int64)) / lines.lines,
        lines.per_text((lines.words > 40).astype(np.int64)) / lines.lines,
    ]
    out = np.stack(columns, axis=1)
    out[lines.n_words == 0] = 0
    return out


@dataclass
class Forest:
    """Flattened trees; a node goes right where its feature exceeds its threshold; leaves point at themselves."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))[:, None]
        for k in range(0, len(self.roots), 16):
            node = np.broadcast_to(self.roots[k : k + 16], (len(x), len(self.roots[k : k + 16])))
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            out += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Fit boosted trees to 0/1 labels; without labels of both kinds the forest is a constant."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99)
        trees = 0
    base = np.log(share / (1 - share)) if len(y) else 0.0
    if not len(y):
        trees = 0
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    flat = binned + np.arange(x.shape[1]) * BINS
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        at = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(at)
        right.append(at)
        value.append(0.0)
        return at

    raw = np.full(len(x), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = p - y, p * (1 - p)
        roots.append(node())
        todo = [(roots[-1], np.arange(len(x)), 0)]
        while todo:
            at, rows, level = todo.pop()
            g, h = slope[rows].sum(), bend[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * LEAF:
                size = x.shape[1] * BINS
                cells = flat[rows].ravel()
                spread = x.shape[1]
                gs = np.bincount(cells, np.repeat(slope[rows], spread), size).reshape(spread, BINS).cumsum(axis=1)
                hs = np.bincount(cells, np.repeat(bend[rows], spread), size).reshape(spread, BINS).cumsum(axis=1)
                ns = np.bincount(cells, minlength=size).reshape(spread, BINS).cumsum(axis=1)
                gain = gs**2 / (hs + L2) + (g - gs) ** 2 / (h - hs + L2) - g * g / (h + L2)
                gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
                k = int(gain.argmax())
                if gain.flat[k] > best[0]:
                    best = (gain.flat[k], divmod(k, BINS))
            if best[1] is None:
                value[at] = -rate * g / (h + L2)
                raw[rows] += value[at]
                continue
            f, b = best[1]
            feature[at], threshold[at] = f, edges[f][b]
            left[at], right[at] = node(), node()
            goes = binned[rows, f] > b
            todo += [(left[at], rows[~goes], level + 1), (right[at], rows[goes], level + 1)]
    return Forest(base, *(np.array(v, dtype=t) for v, t in ((roots, np.int64), (feature, np.int64), (threshold, float), (left, np.int64), (right, np.int64), (value, float))), depth)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled documents outside the held-out third."""
    small_batches(docs.sparkSession)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = statistics(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "x"])

    rows = labelled_sample(docs, labels, sample).mapInArrow(described, "doc_id long, quality int, x binary").collect()
    rows = sorted((r.doc_id, bytes(r.x), r.quality) for r in rows)  # the forest doesn't depend on the order of arrival
    x = np.frombuffer(b"".join(r[1] for r in rows)).reshape(-1, len(FEATURES))
    return grow(x, np.array([r[2] for r in rows], dtype=float))


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    A null text counts as empty and is scored like it; a null doc_id isn't held out; repeated
    rows are scored one by one. Only text enters a score. Columns besides doc_id and text are
    not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = forest.scores(statistics(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(3).alias("held_out"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def filter_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, whose score is at least 0.5; one pass, no join.

    A null text counts as empty for the score and stays null; repeated rows and those with a null
    doc_id are judged one by one. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select(["row"]).filter(pa.array(forest.scores(statistics(batch.column(0).to_pylist())) >= 0.5))

    # all columns go through in a struct, so that no name can clash
    rows = docs.select(text_bytes().alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, StructType([rows.schema["row"]])).select("row.*")
