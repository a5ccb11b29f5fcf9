"""BPE encoding and decoding with contiguous rank arrays.

Every word is held as a row of part ids with, beside it, the merge ranks of adjacent parts.
One step finds the smallest rank of the row (leftmost at ties), deletes that boundary and
refreshes the two neighbouring ranks. Words of one length form a matrix, so that a step is a
few numpy calls for thousands of words; all rows still active have made the same number of
merges and therefore have the same length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import small_batches, text_bytes, tokenizer_path

#: Longer pieces are merged with a heap: scanning their whole rank array would take quadratic time.
SHORT = 48
#: Words kept in a worker's cache; a full cache is emptied. It bounds memory, results don't depend on it.
CACHE_WORDS = 150_000
NO_RANK = np.int64(1 << 40)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the code points from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankArrayBPE:
    """Encoder for a word-level BPE file: lower case, white space dropped, word ends marked."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: s for s, i in (self.vocab | self.specials).items()}
        self.size = max(self.names) + 1
        suffix = model["end_of_word_suffix"] or ""
        letters = byte_alphabet()
        self.inner = np.array([self.vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([self.vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([self.vocab[a] * self.size + self.vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile(b"|".join(regex.escape(s.encode()) for s in sorted(self.specials, key=len, reverse=True)))
        self.cache: dict[bytes, tuple[bytes, str]] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merge words of one length; parts: one row of part ids for each."""
        ranks = self.rank_of(parts[:, :-1], parts[:, 1:])
        while True:
            if ranks.shape[1] == 0:
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            going = best < NO_RANK
            if not going.all():
                for row, ids in zip(rows[~going].tolist(), parts[~going].tolist()):
                    out[row] = ids
                parts, ranks, rows, at, best = parts[going], ranks[going], rows[going], at[going], best[going]
            if not len(rows):
                return
            line = np.arange(len(rows))
            n = parts.shape[1]
            parts[line, at] = self.merged[best]
            column = np.arange(n - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
            column = np.arange(n - 2)
            ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
            before = at > 0
            ranks[line[before], at[before] - 1] = self.rank_of(parts[line[before], at[before] - 1], parts[line[before], at[before]])
            after = at < n - 2
            ranks[line[after], at[after]] = self.rank_of(parts[line[after], at[after]], parts[line[after], at[after] + 1])
        for row, ids in zip(rows.tolist(), parts.tolist()):
            out[row] = ids

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for one long piece, from a heap of (rank, position)."""
        lookup = self.__dict__.setdefault("pair_rank", dict(zip(self.keys.tolist(), self.ranks.tolist())))
        n = len(parts)
        ahead, behind, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := lookup.get(parts[i] * self.size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = ahead[i]
            if not alive[i] or j >= n or parts[i] != left or parts[j] != right:
                continue
            parts[i] = int(self.merged[rank])
            alive[j] = False
            ahead[i] = ahead[j]
            if ahead[i] < n:
                behind[ahead[i]] = i
            for a, b in ((behind[i], i), (i, ahead[i])):
                if a >= 0 and b < n and (r := lookup.get(parts[a] * self.size + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p, keep in zip(parts, alive) if keep]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece (its bytes, no white space)."""
        out: list = [None] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        for n, rows in by_length.items():
            if n > SHORT:
                for i in rows:
                    data = np.frombuffer(pieces[i], dtype=np.uint8)
                    out[i] = self.merge_long([*self.inner[data[:-1]].tolist(), int(self.final[data[-1]])])
                continue
            data = np.frombuffer(b"".join([pieces[i] for i in rows]), dtype=np.uint8).reshape(len(rows), n)
            parts = self.inner[data]
            parts[:, -1] = self.final[data[:, -1]]
            self.merge_rows(parts, np.array(rows), out)
        return out

    def split(self, word: bytes) -> list[bytes]:
        """Normalise a run without ASCII white space and cut it into pieces."""
        text = word.decode("utf-8")
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters one by one: no final sigma
        return [p.encode("utf-8") for p in self.pieces.findall(text.lower())]

    def learn(self, words: Iterable[bytes]) -> None:
        """Put words into the cache; equal pieces are merged once."""
        cut = {w: self.split(w) for w in words}
        distinct = list(dict.fromkeys(p for pieces in cut.values() for p in pieces))
        ids = dict(zip(distinct, self.encode_pieces(distinct)))
        names = self.names
        for word, pieces in cut.items():
            own = [i for p in pieces for i in ids[p]]
            self.cache[word] = (np.array(own, dtype="<u4").tobytes(), " ".join([names[i] for i in own]))

    def encode_batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, str]]:
        """For each text (UTF-8) its ids as little-endian unsigned 32-bit integers, and their decoded text."""
        runs, wanted = [], set()
        for text in texts:
            parts: list = []
            last = 0
            if b"<|" in text:
                for m in self.special.finditer(text):
                    parts += [text[last : m.start()].split(), m.group().decode()]
                    last = m.end()
            parts.append(text[last:].split() if last else text.split())
            runs.append(parts)
            for words in parts[::2]:
                wanted.update(words)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.learn(wanted - self.cache.keys())
        cache = self.cache
        for parts in runs:
            ids, decoded = [], []
            for k, words in enumerate(parts):
                if k % 2:
                    ids.append(np.array([self.specials[words]], dtype="<u4").tobytes())
                    decoded.append(words)
                else:
                    found = [cache[w] for w in words]
                    ids += [f[0] for f in found]
                    decoded += [f[1] for f in found if f[0]]
            yield b"".join(ids), " ".join(decoded)

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by a space, as the file names no decoder; unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)


ENCODERS: dict[str, RankArrayBPE] = {}


def encoder(path: str) -> RankArrayBPE:
    if path not in ENCODERS:
        ENCODERS[path] = RankArrayBPE(path)
    return ENCODERS[path]


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>, decoded string), one for each input row.

    Nulls and empty texts give no ids and an empty decoded text; rows with equal or null doc_id
    are kept as they are; other columns of ``docs``, whatever their names, are not read.
    """
    return _mapped(docs, path, id_column, text_column, "doc_id long, ids array<int>, decoded string", False)


def _mapped(docs: DataFrame, path: str | None, id_column: str, text_column: str, schema: str, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    path = path or tokenizer_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            found = list(bpe.encode_batch(batch.column(1).to_pylist()))
            if digest:
                columns = [
                    pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                    pa.array([hashlib.sha256(text.encode("utf-8")).hexdigest() for _, text in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                columns = [pa.array([np.frombuffer(ids, dtype="<i4") for ids, _ in found], pa.list_(pa.int32())), pa.array([text for _, text in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_bytes(text_column).alias("text"))
    return rows.mapInArrow(run, schema)


def digest_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """encode_documents reduced in place to (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return _mapped(docs, path, id_column, text_column, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", True)
