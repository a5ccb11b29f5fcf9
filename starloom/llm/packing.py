"""Packing of token ids into sequences of fixed length: first-fit decreasing over a tournament tree.

A task tokenises its rows, deals them at random (seeded, so a retried task gives the same rows)
into groups of documents, and packs each group by itself: whole sequences are cut from long
documents, what remains of each goes first-fit decreasing into bins. The tree holds the free
room of every bin; each inner node holds the larger of its children, so the first bin with
enough room is found by one descent. At last the emptiest bins are taken apart to fill the gaps of the
others, and what is left of a group becomes sequences whose lengths are powers of two.
Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.byte_ids import byte_ids
from starloom.llm.common import small_batches, tokenizer_path

#: Ids that a task holds before it packs them, and documents of a group on average.
WINDOW_IDS = 4 << 20
GROUP_DOCS = 1024


class RoomTree:
    """Tournament tree of the free room of bins."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.tree = [room] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Take ``size`` from the first bin with that room; its number."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bin_ = node - self.leaves
        tree[node] -= size
        node //= 2
        while node:
            top = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == top:
                break
            tree[node] = top
            node //= 2
        return bin_


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """Item numbers of each bin, bins in the order of their opening; ties go by item number."""
    tree = RoomTree(max(1, len(sizes)), room)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = tree.place(sizes[item])
        if at == len(bins):
            bins.append([])
        bins[at].append(item)
    return bins


def pack_group(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document number, start, length) for documents of these lengths.

    Every sequence is full or has a power of two as its length.
    """
    sequences, rests = [], []
    for doc, n in enumerate(lengths):
        whole = n - n % room
        sequences += [[(doc, start, room)] for start in range(0, whole, room)]
        if n > whole:
            rests.append((doc, whole, n - whole))
    bins = [[rests[i] for i in items] for items in first_fit_decreasing([r[2] for r in rests], room)]
    full = [b for b in bins if sum(p[2] for p in b) == room]
    part = sorted((b for b in bins if sum(p[2] for p in b) < room), key=lambda b: -sum(p[2] for p in b))
    fill = [sum(p[2] for p in b) for b in part]
    low, high, loose = 0, len(part) - 1, []  # gaps are filled from the fullest bin on with pieces of the emptiest
    while low <= high:
        if fill[low] == room:
            low += 1
            continue
        if not loose:
            if low == high:
                break
            loose = part.pop()
            high -= 1
            fill.pop()
            continue
        doc, start, n = loose.pop()
        take = min(n, room - fill[low])
        part[low].append((doc, start, take))
        fill[low] += take
        if take < n:
            loose.append((doc, start + take, n - take))
    left = loose
    for b, n in zip(part, fill):
        if n == room:
            full.append(b)
        else:
            left = left + b
    sequences += full
    total = sum(p[2] for p in left)
    left = left[::-1]
    while total:
        size = room if total >= room else 1 << (total.bit_length() - 1)
        total -= size
        sequence = []
        while size:
            doc, start, n = left.pop()
            take = min(n, size)
            sequence.append((doc, start, take))
            size -= take
            if take < n:
                left.append((doc, start + take, n - take))
        sequences.append(sequence)
    return sequences


def _pack(docs: DataFrame, path: str | None, room: int, end_id: int, seed: int, schema: str, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    path = path or tokenizer_path("byte_bpe_50k.json")

    def packed(ids: list, arrays: list, partition: int, window: int, first: int) -> tuple[list, int]:
        draw = np.random.default_rng([seed, partition, window])
        order = draw.permutation(len(arrays))
        rows = []
        for group in np.array_split(order, max(1, round(len(order) / GROUP_DOCS))):
            for sequence in pack_group([len(arrays[k]) for k in group], room):
                offset = 0
                for doc, start, n in sequence:
                    own = arrays[group[doc]]
                    piece = own[start : start + n]
                    rows.append((ids[group[doc]], start, n, zlib.crc32(piece.tobytes()) if digest else piece.astype(np.int32), len(own), (partition << 36) + first, offset))
                    offset += n
                first += 1
        return rows, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, partition = byte_ids(path), TaskContext.get().partitionId()
        ids, arrays, held, window, first = [], [], 0, 0, 0
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in schema.split(", ")]

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal ids, arrays, held, window, first
            rows, first = packed(ids, arrays, partition, window, first)
            ids, arrays, held, window = [], [], 0, window + 1
            for k in range(0, len(rows), 4096):
                columns = zip(*rows[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                ids.append(doc_id)
                arrays.append(own)
                held += len(own)
                if held >= WINDOW_IDS:
                    yield from out()
        if arrays:
            yield from out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str | None = None, room: int = 1024, end_id: int = 0, seed: int = 7) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with equal or null doc_id are separate
    documents. Each id of each row lies in exactly one piece; a sequence's pieces lie at gapless
    offsets from 0. sequence_id holds the input partition in its upper bits, so it is unique
    and a retried task gives the same. An empty table gives no rows; columns besides doc_id and
    text are not read.
    """
    return _pack(docs, path, room, end_id, seed, "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long", False)


def packing_digest(docs: DataFrame, path: str | None = None, room: int = 1024, end_id: int = 0, seed: int = 7) -> DataFrame:
    """pack_documents with ids_crc32 (of little-endian unsigned 32-bit ids) in place of the ids."""
    return _pack(docs, path, room, end_id, seed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", True)
