"""Language-model scores: marginal likelihood of subword lattices.

The pieces of an existing vocabulary have unigram probabilities: the scores of the vocabulary's file
are the prior (a Dirichlet one of weight PRIOR), the piece counts over all training documents the evidence. A text's
probability sums over all segmentations of its words into pieces (single bytes included, so that
no text is impossible) and ends with one end event; a forward recursion in log space runs over all
words of one length at once, over a long word by itself along the pieces that match in it.

Word counts are taken over the whole corpus. Of the FREQUENT commonest words of at most CARRIED bytes (so of
bounded bytes) the counts and scores are broadcast; rarer words are joined, so nothing that grows with the corpus is
held in one place.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import held_out, small_batches, stored, text_bytes, tokenizer_path

FREQUENT = 100_000
#: Words that a task counts before it sends them on.
HELD_WORDS = 200_000
#: What the file's scores weigh against the counts, in pieces; added to the count of every piece.
PRIOR, SMOOTH = 2000.0, 0.1
#: Words of more bytes than LONG are scored by themselves, those of more than CARRIED bytes are never broadcast.
LONG, CARRIED = 512, 64
#: Bytes of a long word whose matches are held at once.
STRETCH = 1 << 16
BASE = 0x9E3779B97F4A7C15
WORD = 1 << 64


def file_prior(scores: np.ndarray, is_byte: np.ndarray) -> np.ndarray:
    """Probabilities of the pieces by the scores of their file.

    Scores of a unigram file are log probabilities. Those of a file of merges are the negative
    ranks of the pieces, which by Zipf's law have probabilities in inverse proportion to them. Bytes,
    which stand for what no piece covers, get the weight of the least piece.
    """
    if not len(scores) or is_byte.all():
        return np.full(len(scores), 1 / max(len(scores), 1))
    words = scores[~is_byte]
    known = 1 / (2 + words.max() - words) if words.min() < -100 else np.exp(words - words.max())
    weight = np.full(len(scores), known.min())
    weight[~is_byte] = known
    return weight / weight.sum()


class Lattice:
    """Log probabilities of words, given counts of the vocabulary's pieces."""

    def __init__(self, path: str, counts: dict[int, float] | None = None, ends: float = 0.0):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        counts = counts or {}
        size = self.model.get_piece_size()
        own = [i for i in range(size) if not self.model.is_control(i) and not self.model.is_unknown(i)]
        prior = file_prior(np.array([self.model.get_score(i) for i in own]), np.array([self.model.is_byte(i) for i in own]))
        weight = {i: counts.get(i, 0.0) + SMOOTH + PRIOR * q for i, q in zip(own, prior.tolist())}
        total = sum(weight.values()) + ends + SMOOTH
        logs = {i: np.log(w / total) for i, w in weight.items()}
        self.end = float(np.log((ends + SMOOTH) / total))
        self.bytes = np.full(256, -np.inf)
        pieces: dict[bytes, float] = {}
        for i in own:
            name = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(name[3:5], 16)] = logs[i]
            else:
                key = name.replace("▁", " ").encode("utf-8")
                if b" " not in key[1:]:  # a word has its one blank at the front
                    pieces[key] = logs[i]
        self.longest = max(map(len, pieces), default=1)
        self.tables = []  # for each length: sorted hashes of the pieces, and their log probabilities
        for n in range(1, self.longest + 1):
            names = [p for p in pieces if len(p) == n]
            hashes = np.array([self.hash(p) for p in names], dtype=np.uint64)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(names):
                raise ValueError("two pieces have one hash")
            self.tables.append((hashes[order], np.array([pieces[p] for p in names])[order]))

    @staticmethod
    def hash(piece: bytes) -> int:
        value = 0
        for b in piece:
            value = (value * BASE + b + 1) % WORD
        return value

    def scores(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word (not of the end event)."""
        out = np.zeros(len(words))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for n, rows in by_length.items():
            if n > LONG:
                for i in rows:
                    out[i] = self.forward_long(b" " + words[i])
                continue
            step = max(1, 400_000 // n)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                data = np.frombuffer(b"".join([b" " + words[i] for i in part]), dtype=np.uint8).reshape(len(part), n)
                out[part] = self.forward(data)
        return out / np.log(10)

    def forward(self, data: np.ndarray) -> np.ndarray:
        """Forward recursion over words of one length; a row is a word with a blank before it."""
        rows, n = data.shape
        keep = min(self.longest, n)
        ahead = np.full((keep + 1, rows), -np.inf)  # the last positions, the newest first
        ahead[0] = 0.0
        hashes = np.zeros((keep, rows), dtype=np.uint64)  # of the substrings ending here, by length
        column = np.ascontiguousarray(data.T)
        for end in range(n):
            own = column[end].astype(np.uint64) + np.uint64(1)
            m = min(keep, end + 1)
            hashes[1:m] = hashes[: m - 1] * np.uint64(BASE) + own
            hashes[0] = own
            paths = np.full((m + 1, rows), -np.inf)
            paths[m] = ahead[0] + self.bytes[column[end]]
            for length in range(1, m + 1):
                keys, logs = self.tables[length - 1]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, hashes[length - 1]), len(keys) - 1)
                    paths[length - 1] = np.where(keys[at] == hashes[length - 1], ahead[length - 1] + logs[at], -np.inf)
            top = paths.max(axis=0)
            best = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                now = best + np.log(np.exp(paths - best).sum(axis=0))
            ahead[1:] = ahead[:-1].copy()
            ahead[0] = now
        return ahead[0]

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces in a word: where they end, their lengths, their log probabilities, by end."""
        ends, lengths, logs = [], [], []
        hashes = np.zeros(len(data), dtype=np.uint64)
        for n in range(1, min(self.longest, len(data)) + 1):
            own = data[n - 1 :].astype(np.uint64) + np.uint64(1)
            hashes = hashes[: len(own)] * np.uint64(BASE) + own  # of the n bytes from each place on
            keys, values = self.tables[n - 1]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == hashes)
                ends.append(hit + n)
                lengths.append(np.full(len(hit), n))
                logs.append(values[at[hit]])
        single = self.bytes[data]
        some = np.flatnonzero(np.isfinite(single))
        ends, lengths, logs = np.concatenate([*ends, some + 1]), np.concatenate([*lengths, np.ones(len(some), dtype=np.int64)]), np.concatenate([*logs, single[some]])
        order = np.argsort(ends, kind="stable")
        return ends[order], lengths[order], logs[order]

    def forward_long(self, word: bytes) -> float:
        """The forward recursion over one long word, along the pieces that match, STRETCH bytes at a time."""
        ahead = [0.0]  # of the last ``longest`` places, the newest last
        done = 0
        while done < len(word):
            back = min(done, self.longest)
            ends, lengths, logs = self.matches(np.frombuffer(word[done - back : done + STRETCH], dtype=np.uint8))
            new = ends > back
            ends, lengths, logs = ends[new] - back, lengths[new].tolist(), logs[new].tolist()
            size = min(STRETCH, len(word) - done)
            cut = np.searchsorted(ends, np.arange(1, size + 2)).tolist()
            for k in range(size):
                paths = [ahead[-n] + v for n, v in zip(lengths[cut[k] : cut[k + 1]], logs[cut[k] : cut[k + 1]])]
                top = max(paths, default=-inf)
                ahead.append(top + log(sum([exp(x - top) for x in paths])) if top > -inf else -inf)
            ahead = ahead[-self.longest - 1 :]
            done += size
        return ahead[-1]


_LATTICES: dict = {}


def _lattice(key, *args) -> Lattice:
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(*args)
    return _LATTICES[key]


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z only), without the end."""
    return text.lower().split()


def word_counts(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """word, c: its count over all documents that aren't held out, 0 for words of held-out ones only."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "c"])
            held.clear()
            return batch

        for batch in batches:
            for text, held_text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held_text:
                    for w in set(tokens(text)):
                        held.setdefault(w, 0)
                else:
                    held.update(tokens(text))
            if len(held) >= HELD_WORDS:
                yield out()
        if held:
            yield out()

    rows = docs.select(text_bytes().alias("text"), held_out(modulus).alias("held_out"))
    return rows.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_counts(words: DataFrame, path: str) -> dict[int, float]:
    """Pieces of the vocabulary's own segmentation of every word, weighted by the word's count; bounded by the vocabulary."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _lattice(path, path).model
        total = np.zeros(model.get_piece_size())
        for batch in batches:
            texts = [w.decode("utf-8") for w in batch.column(0).to_pylist()]
            for k in range(0, len(texts), 4096):
                ids = model.encode(texts[k : k + 4096], num_threads=1)
                weights = batch.column(1).to_numpy()[k : k + 4096]
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int64)
                total += np.bincount(flat, weights=np.repeat(weights, [len(x) for x in ids]), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["piece", "n"])

    rows = words.where("c > 0").mapInArrow(cut, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    return {r.piece: r.n for r in rows.collect()}


def score_documents(docs: DataFrame, path: str | None = None, modulus: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """Scores of every row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) mod ``modulus`` is not 1, a null doc_id among
    them. A null or empty text is the end alone. Repeated rows count and are scored one by one.
    Without training rows every token is unknown and base_score is 0. An empty table gives no rows. Columns besides
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or tokenizer_path("piece_bpe_32k.model")
    words = stored(word_counts(docs, modulus), "lm-words")
    trained = docs.where(~held_out(modulus)).count()
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.expr("if(c > 0, 1, 0)")), F.lit(0)).alias("v")).first()
    total, distinct = sums.n + trained, sums.v + (trained > 0)
    scale = total + 0.5 * (distinct + 1)
    pieces = spark.sparkContext.broadcast(piece_counts(words, path))
    key = uuid.uuid4().hex  # names this run in the workers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(key, path, pieces.value, trained)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.scores(batch.column(0).to_pylist()))], ["word", "c", "s"])

    # the smallest count from which on there are at most ``frequent`` words, from counts by size
    short = F.length("word") <= CARRIED
    steps = words.where((F.col("c") > 0) & short).groupBy(F.floor(F.log2("c") * 8).alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("low")).orderBy(F.desc("k")).collect()
    least, taken = None, 0
    for r in steps:
        taken += r.n
        if taken > frequent:
            break
        least = r.low
    is_frequent = (F.col("c") >= least) & short if least is not None else F.lit(False)
    common = words.where(is_frequent).mapInArrow(score, "word binary, c long, s double").collect()
    shared = spark.sparkContext.broadcast({bytes(r.word): (np.log10((r.c + 0.5) / scale), r.s) for r in common})
    rare = words.where(~is_frequent).mapInArrow(score, "word binary, c long, s double")

    end_base = float(np.log10(((trained or 0) + 0.5) / scale))
    names = ["word", "row", "tf", "doc_id", "n_tokens", "n_known", "base", "s"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        end = _lattice(key, path, pieces.value, trained).end / np.log(10)
        for batch in batches:
            whole: list[list] = [[] for _ in range(7)]
            word, row, tf = [], [], []
            for doc_id, text, at in zip(*(c.to_pylist() for c in batch.columns)):
                parts = tokens(text)
                base, sub, found = end_base, end, int(trained > 0)
                for w, n in Counter(parts).items():
                    hit = known.get(w)
                    if hit is None:
                        word.append(w)
                        row.append(at)
                        tf.append(n)
                    else:
                        base += n * hit[0]
                        sub += n * hit[1]
                        found += n
                for column, value in zip(whole, (b" %d" % at, at, doc_id, len(parts) + 1, found, base, sub)):
                    column.append(value)
            types = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            n = len(word)
            yield pa.RecordBatch.from_arrays([pa.array(whole[0], types[0]), pa.array(whole[1], types[1]), pa.nulls(len(whole[0]), types[2]), *(pa.array(c, t) for c, t in zip(whole[2:], types[3:]))], names)
            yield pa.RecordBatch.from_arrays([pa.array(word, types[0]), pa.array(row, types[1]), pa.array(tf, types[2]), *(pa.nulls(n, t) for t in types[3:])], names)

    # a row's own sums travel under a key that no word can have, so they are spread evenly
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.monotonically_increasing_id().alias("row"))
    parts = rows.mapInArrow(split, "word binary, row long, tf int, doc_id long, n_tokens long, n_known long, base double, s double")
    joined = parts.join(rare.select("word", "c", F.col("s").alias("word_s")), "word", "left").select(
        "row",
        "doc_id",
        "n_tokens",
        F.when(F.col("tf").isNull(), F.col("n_known")).otherwise(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        F.when(F.col("tf").isNull(), F.col("base")).otherwise(F.col("tf") * F.log10((F.col("c") + 0.5) / F.lit(float(scale)))).alias("base"),
        F.when(F.col("tf").isNull(), F.col("s")).otherwise(F.col("tf") * F.col("word_s")).alias("s"),
    )
    found = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("s").alias("score"))
    return found.select("doc_id", held_out(modulus).alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
