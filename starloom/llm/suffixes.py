"""Removal of repeated passages by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else in the corpus.

1. The smallest hash among the short grams of a window is the same for equal windows, so
   windows are bucketed by it; consecutive windows with one smallest gram form a segment. Only buckets whose
   gram occurs at two places or more are looked at any further (a filter on hashes; it decides nothing).
2. Each bucket's distinct segments get a suffix array by two-stage sorting: suffixes smaller than
   their successors are sorted directly, all others are induced by scanning the buckets of first
   bytes; then the common prefixes of neighbours are computed (up to LENGTH bytes), and those of
   LENGTH are repeats. A segment that occurs twice as a whole counts twice.
3. A bucket of more than HOT_BYTES of distinct segments is split into blocks, each with a suffix array of
   its own. What repeats within a block is decided by it; the others compare what the arrays of different blocks
   hold, one entry for each distinct window of a block, by 128-bit hashes. So a passage that is
   in every document has one entry a block there, not one a document.
4. The covered ranges go back to their texts.

Texts are named by the first bits of their SHA-256, never by their row, so that a lost executor or another
split of the input changes nothing. Text is shuffled compressed, by that name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.llm.common import Scratch, small_batches, spread_join, stored

LENGTH = 200
GRAM = 32
#: Starts of windows in one segment at most, and in one piece of a long text.
LONGEST, PIECE = 4096, 1 << 18
#: Bytes of segments that share one suffix array, and of a bucket that isn't split; sorting takes some ten bytes for each.
ARRAY_BYTES, HOT_BYTES = 1 << 19, 1 << 20
#: Suffixes whose bytes are held at once while they are sorted; a bound on memory only.
SORTED = 1 << 14
#: Names of texts and segments that a task remembers; bounds on memory only.
REMEMBERED, HELD = 100_000, 10_000
#: So many names of large buckets are broadcast; more are shuffled.
BROADCAST = 200_000
BASE = 0x9E3779B97F4A7C15

_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        up = np.full(max(n, 1 << 16), np.uint64(BASE))
        down = np.full(len(up), np.uint64(pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of every GRAM bytes, from prefix sums."""
    up, down = _powers(len(data))
    whole = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=whole[1:])
    h = (whole[GRAM:] - whole[:-GRAM]) * down[: len(data) - GRAM + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours, by doubling."""
    size, now = 1, values
    while size * 2 <= width:
        now = np.minimum(now[: len(now) - size], now[size:])
        size *= 2
    n = len(values) - width + 1
    return np.minimum(now[:n], now[width - size : width - size + n])


def segments(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a text: first start, number of starts, hash, and whether its gram stands at several places of it."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    width = LENGTH - GRAM + 1
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        data = np.frombuffer(text[at : at + PIECE + LENGTH - 1], dtype=np.uint8)
        h = gram_hashes(data)
        low = least(h, width)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.append(first, len(low)))
        # how often the gram stands within the windows of its segment
        size = n + width - 1
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin - first, size)
        times = np.add.reduceat((h[place] == np.repeat(low[first], size)).astype(np.int64), begin)
        for column, value in zip(found, (first + at, n, low[first], times > 1)):
            column.append(value)
    if not found[0]:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, bool))
    first, n, low, many = (np.concatenate(c) for c in found)
    again = np.unique(low, return_inverse=True, return_counts=True)
    many |= again[2][again[1]] > 1
    if (n > LONGEST).any():
        parts = -(-n // LONGEST)
        which = np.repeat(np.arange(len(n)), parts)
        k = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n, low, many = first[which] + k * LONGEST, np.minimum(n[which] - k * LONGEST, LONGEST), low[which], many[which]
    return first, n, low, many


def two_stage_order(data: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``data`` by their first ``depth`` bytes; equal ones in any order."""
    t = np.frombuffer(data, dtype=np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, dtype=np.int64)
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)  # of runs of one byte
    runs = np.diff(np.concatenate([[-1], ends]))
    rises = np.append(t[ends[:-1]] < t[ends[:-1] + 1], False)
    small = np.repeat(rises, runs)  # suffixes smaller than their successors
    direct = np.flatnonzero(small)
    # by their first eight bytes all at once; then runs of about SORTED of them, none of which cuts equal eights, by all bytes
    ahead = np.concatenate([t, np.zeros(8, dtype=np.uint8)])
    eight = np.zeros(len(direct), dtype=np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | ahead[direct + k].astype(np.uint64)
    by = np.argsort(eight, kind="stable")
    direct, eight = direct[by], eight[by]
    fresh = np.flatnonzero(eight[1:] != eight[:-1]) + 1
    cuts = [0, *fresh[np.unique(np.searchsorted(fresh, np.arange(SORTED, len(direct), SORTED)).clip(max=max(len(fresh) - 1, 0)))].tolist(), len(direct)] if len(fresh) else [0, len(direct)]
    del ahead, eight, by, fresh
    for a, b in zip(cuts, cuts[1:]):
        keys = [data[i : i + depth] for i in direct[a:b].tolist()]
        direct[a:b] = direct[a:b][np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)]
    keys = None
    of_byte = np.concatenate([[0], np.cumsum(np.bincount(t[direct], minlength=256))])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))  # the last suffix follows the empty one
    out = []
    for byte in range(256):
        front = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            back = front[front > 0] - 1
            front = back[(t[back] == byte) & ~small[back]]
        bucket.append(direct[of_byte[byte] : of_byte[byte + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        back = whole[whole > 0] - 1
        back = back[t[back] > byte]
        if len(back):
            back = back[np.argsort(t[back], kind="stable")]
            cut = np.flatnonzero(np.diff(t[back])) + 1
            for part in np.split(back, cut):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each of these suffixes (of ``depth`` bytes at least) shares with the one before it, ``depth`` at most; 0 for the first."""
    out = np.zeros(len(order), dtype=np.int64)
    if len(order) < 2:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), depth)
    for k in range(1, len(order), 1 << 14):
        differ = windows[order[k - 1 : k - 1 + (1 << 14)][: len(order) - k]] != windows[order[k : k + (1 << 14)]]
        first = differ.argmax(axis=1)
        out[k : k + len(first)] = np.where(differ[np.arange(len(first)), first], first, depth)
    return out


def repeated_starts(parts: list[bytes], depth: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each part, which of its starts begin ``depth`` bytes that another start of any part begins too, and which are the first of their kind in the array."""
    data = b"".join(parts)
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    order = two_stage_order(data, depth)
    usable = np.zeros(len(data), dtype=bool)
    for b, n in zip(begin, sizes):
        usable[b : b + n - depth + 1] = True
    order = order[usable[order]]
    same = common_prefixes(data, order, depth) == depth
    found, first = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    found[order[same]] = found[order[:-1][same[1:]]] = True
    first[order[~same]] = True
    return tuple([x[b : b + n - depth + 1] for b, n in zip(begin, sizes)] for x in (found, first))


def covered(starts: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Ranges (begin, end) that windows at these (ascending) starts cover, joined where they meet."""
    if not len(starts):
        return np.zeros((0, 2), dtype=np.int32)
    cut = np.flatnonzero(np.diff(starts) > depth) + 1
    return np.stack([starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + depth], axis=1).astype(np.int32)


def join_ranges(ranges: np.ndarray) -> np.ndarray:
    """Ranges joined where they overlap or touch."""
    if not len(ranges):
        return ranges
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[first, 0], np.append(reach[:-1][first[1:]], reach[-1])], axis=1)


def name_of(text: bytes) -> tuple[int, int]:
    digest = hashlib.sha256(text).digest()
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:16], "big", signed=True)


PARTS = "kind string, h long, digest binary, key long, mark long, start int, n long, seg binary"


def repeated_ranges(work: Scratch, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, found) for the texts of ``docs``.

    texts: key, mark (name of the text), packed (compressed text, null for null) and row (a struct of all
    columns of ``docs`` but text). found, by key: rows (mark, whole, start, ranges) collected in ``marks``.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.col("text").cast("string").cast("binary").alias("text"), F.struct(*(others or [F.lit(0).alias("none")])).alias("row"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            names = [name_of(t or b"") for t in texts]
            columns = [pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([None if t is None else squeeze.compress(t) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["key", "mark", "size", "packed", "row"])

    texts = work.stored(rows.mapInArrow(packed, StructType.fromDDL("key long, mark long, size long, packed binary").add("row", rows.schema["row"].dataType)), "texts")
    plain = texts.where(F.col("size") >= LENGTH).select("packed")
    copies = texts.where(F.col("size") >= LENGTH).groupBy("key", "mark").count().where("count > 1")
    copies = work.stored(copies.select("key", "mark"), "copies")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], []]
            for data in batch.column(0).to_pylist():
                text = unpack.decompress(data)
                name = name_of(text)
                if name in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                _, _, low, many = segments(text)
                low, at = np.unique(low, return_index=True)
                out[0].append(low.view(np.int64))
                out[1].append(np.full(len(low), name[0], dtype=np.int64))
                out[2].append(many[at])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["h", "key", "many"])

    pairs = work.stored(plain.mapInArrow(grams, "h long, key long, many boolean"), "grams")
    shared = pairs.groupBy("h").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max("many").alias("many")).where("a < b or many").select("h")
    wanted = pairs.join(shared, "h").groupBy("key").agg(F.collect_set("h").alias("hs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: dict[bytes, list] = {}
        seen: set = set()
        types = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in PARTS.split(", ")]

        def out() -> Iterator[pa.RecordBatch]:
            rows = [("seg", h, digest, None, None, None, n, seg) for digest, (h, seg, n) in held.items()]
            held.clear()
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000]), types)], names)

        for batch in batches:
            rows = []
            for key, mark, data, whole, hs in zip(*(c.to_pylist() for c in batch.columns)):
                if whole:
                    if (key, mark) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((key, mark))
                text = unpack.decompress(data)
                if len(text) < LENGTH:
                    continue
                first, n, low, _ = segments(text)
                use = np.isin(low.view(np.int64), np.array(hs, dtype=np.int64))
                for s, size, h in zip(first[use].tolist(), n[use].tolist(), low[use].view(np.int64).tolist()):
                    seg = text[s : s + size + LENGTH - 1]
                    digest = hashlib.blake2b(seg, digest_size=16).digest()
                    if digest in held:
                        held[digest][2] += 1
                    else:
                        held[digest] = [h, seg, 1]
                    if not whole:
                        rows.append(("occ", None, digest, key, mark, s, None, None))
                if len(held) >= HELD:
                    yield from out()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        yield from out()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text that stands more than once comes once from each task."""
        seen: set = set()
        for batch in batches:
            keep = []
            for name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keep.append(name not in seen)
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
            yield batch.filter(pa.array(keep, pa.bool_()))

    # a text that stands more than once goes as a whole; it still shows its passages to the others
    marked = texts.where(F.col("size") >= LENGTH).select("key", "mark", "packed").mapInArrow(once, "key long, mark long, packed binary").join(wanted, "key")
    doubled = copies.select("key", F.lit(True).alias("whole"), F.col("mark").alias("m")).groupBy("key").agg(F.collect_set("m").alias("ms"))
    wide = marked.join(doubled, "key", "left").select("key", "mark", "packed", F.coalesce(F.array_contains("ms", F.col("mark")), F.lit(False)).alias("whole"), "hs")
    folder = f"{work.path}/parts"
    wide.mapInArrow(cut, PARTS).write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    both = spark.read.schema(PARTS).parquet(folder)
    segs = both.where("kind = 'seg'").select("h", "digest", "n", "seg")
    occurrences = both.where("kind = 'occ'").select("digest", "key", "mark", "start")

    # how many blocks a bucket takes, measured over its distinct segments
    large = work.stored(segs.groupBy("h").agg(F.sum(F.length("seg")).alias("size")).where(F.col("size") > HOT_BYTES).select("h"), "large")
    few = large.count() <= BROADCAST
    hot = segs.join(F.broadcast(large) if few else large, "h", "left_semi").groupBy("h", "digest").agg(F.max(F.length("seg")).alias("size"))
    hot = hot.groupBy("h").agg(F.sum("size").alias("size")).where(F.col("size") > HOT_BYTES).select("h", F.ceil(F.col("size") / ARRAY_BYTES).cast("int").alias("blocks"))
    hot = work.stored(hot, "hot")
    split = not hot.isEmpty()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, bucket = 0, None

        def out() -> pa.RecordBatch:
            digests, ranges, entries = [], [], []
            for (digest, (seg, n, shared)), found, first in zip(held.items(), *repeated_starts([seg for seg, _, _ in held.values()])):
                starts = np.arange(len(found)) if n > 1 else np.flatnonzero(found)
                # other blocks of the bucket have to know the windows of this one, and those still open here theirs
                own = [{"w": xxhash.xxh3_128_digest(seg[k : k + LENGTH]), "k": k if n == 1 and not found[k] else None} for k in np.flatnonzero(first).tolist()] if shared else None
                if len(starts) or own:
                    digests.append(digest)
                    ranges.append(covered(starts).tobytes() if len(starts) else None)
                    entries.append(own)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ranges, pa.binary()), pa.array(entries, pa.list_(pa.struct([("w", pa.binary()), ("k", pa.int32())])))], ["digest", "ranges", "entries"])

        for batch in batches:
            for h, block, digest, n, seg in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, block) != bucket and size >= ARRAY_BYTES:
                    yield out()
                    size = 0
                bucket = (h, block)
                if digest in held:
                    held[digest][1] += n
                else:
                    held[digest] = [seg, n, block >= 0]
                    size += len(seg)
        if held:
            yield out()

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = [covered(np.sort(np.array(k))).tobytes() for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranges, pa.binary())], ["digest", "ranges"])

    if split:
        segs = segs.join(F.broadcast(hot) if few else hot, "h", "left")
        block = F.coalesce(F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"), F.lit(-1))
    else:
        block = F.lit(-1)
    dealt = segs.select("h", block.alias("block"), "digest", "n", "seg").repartition("h", "block").sortWithinPartitions("h", "block", "digest")
    ranges = work.stored(dealt.mapInArrow(arrays, "digest binary, ranges binary, entries array<struct<w:binary,k:int>>"), "ranges")
    if split:
        entries = ranges.select("digest", F.explode("entries").alias("e")).select("e.w", "digest", "e.k")
        several = work.stored(entries.groupBy("w").count().where("count > 1").select("w"), "several")
        again = spread_join(work.stored(entries.where("k IS NOT NULL"), "open"), several, "w").groupBy("digest").agg(F.collect_set("k").alias("ks"))
        ranges = ranges.where("ranges IS NOT NULL").select("digest", "ranges").unionByName(again.mapInArrow(to_ranges, "digest binary, ranges binary"))
    else:
        ranges = ranges.select("digest", "ranges")
    hits = occurrences.join(ranges, "digest").select("key", F.struct("mark", F.lit(False).alias("whole"), "start", "ranges").alias("m"))
    wholes = copies.select("key", F.struct("mark", F.lit(True).alias("whole"), F.lit(0).alias("start"), F.lit(b"").cast("binary").alias("ranges")).alias("m"))
    return texts, work.stored(hits.unionByName(wholes).groupBy("key").agg(F.collect_list("m").alias("marks")), "marks")


def _kept(docs: DataFrame, schema: str, row) -> DataFrame:
    """A struct ``row`` of the columns of ``docs`` but text, and what ``row`` makes of (text bytes or None, ranges to remove)."""
    work = Scratch(docs.sparkSession, "suffixes")
    texts, marks = repeated_ranges(work, docs)
    made = StructType.fromDDL(schema)
    # the compressed text stays with its row; only the ranges of a text come to it
    joined = spread_join(texts, marks, "key", "left").select("mark", "packed", "marks", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[] for _ in made.names]
            for mark, data, marks in zip(*(batch.column(k).to_pylist() for k in range(3))):
                text = None if data is None else unpack.decompress(data)
                own = [m for m in marks or [] if m["mark"] == mark]
                if any(m["whole"] for m in own):
                    ranges = np.array([[0, len(text)]])
                else:
                    parts = [np.frombuffer(m["ranges"], dtype=np.int32).reshape(-1, 2).astype(np.int64) + m["start"] for m in own]
                    ranges = join_ranges(np.concatenate(parts)) if parts else np.zeros((0, 2), dtype=np.int64)
                for column, value in zip(out, row(text, ranges)):
                    column.append(value)
            kinds = {"bigint": pa.int64(), "string": pa.string()}
            columns = [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(out, made)]
            yield pa.RecordBatch.from_arrays([batch.column(3), *columns], ["row", *made.names])

    found = stored(joined.mapInArrow(run, StructType([texts.schema["row"], *made])), "suffixes-kept")
    work.drop()
    return found


def _without(text: bytes, ranges: np.ndarray) -> bytes:
    parts, last = [], 0
    for a, b in ranges.tolist():
        parts.append(text[last:a])
        last = b
    return b"".join([*parts, text[last:]])


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``.

    A null text counts as empty; texts shorter than LENGTH bytes lose nothing. A text that stands
    twice or more, repeated rows among them, is removed from each of its rows. Rows with equal or null
    doc_id are treated one by one. An empty table gives no rows. Columns besides doc_id and text are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def counts(text: bytes | None, ranges: np.ndarray) -> tuple:
        text = text or b""
        return len(text), int((ranges[:, 1] - ranges[:, 0]).sum()), len(ranges), hashlib.sha256(_without(text, ranges)).hexdigest()

    return _kept(rows, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", counts).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of text; n_chars, where there is one, follows a text that was cut.

    A character of which a byte is removed goes as a whole. A null text stays null. All other
    columns, whatever their names, come back as they are.
    """

    def cut(text: bytes | None, ranges: np.ndarray) -> tuple:
        return None if text is None else _without(text, ranges).decode("utf-8", "ignore"), len(ranges)

    found = _kept(docs, "kept string, n_spans long", cut)
    whole = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in whole:
        whole["n_chars"] = F.when(F.col("n_spans") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(whole["n_chars"])
    return found.select(*[whole[c].alias(c) for c in docs.columns])
