"""SimHash near copies, made complete: no two texts of ``similarity`` or more are missed.

1. SimHash: the fingerprint of a text's five-word shingles is split into pigeonhole blocks, joined on
   them, and links within three bits are verified (``simhash.linked``), here also by the exact
   similarity of the shingle sets.
2. Near copies further apart than three bits: every two sets with a Jaccard similarity of ``similarity``
   or more share one of the first hashes of both (about a fifth of each), whatever order all hashes
   are put in. So a text has one row for each hash of its prefix, and what shares a hash and can
   still reach the similarity from there on is compared exactly. Each set has PARITY longs of parities: how
   many bits two of them differ in is at most how many hashes only one of the sets has, so pairs with too many are
   not looked at; this too is a bound and loses no pair. Large sets fill so few bits, so what passes is held against as many
   parities as a set has hashes before whole sets are compared. Common hashes, estimated from a
   sample, come last in the order, the commonest at the end, so that few texts have them in their prefixes; the order
   decides what is compared and never what is a copy.

A common hash is no square of its texts: first every text is compared with a few neighbours under
each hash, in two turns, and once these links and those of SimHash have made clusters, only pairs of different
clusters are left. All of these are compared, a hash of many texts block against block.

Texts are compared with A-Z in lower case and white space as single blanks; texts equal in that
(by 128 bits of their SHA-256) are one node from the start, whatever the number of their copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, small_batches, spread_join, stored, text_bytes
from starloom.llm.docstats import BLANK
from starloom.llm.simhash import components, linked, majority

#: Texts under one hash that a task compares; more are split into blocks.
HOT_COMPONENT = 20_000
#: Neighbours that a text is compared with under each hash in two turns, before all pairs that are left.
NEIGHBOURS, MORE_NEIGHBOURS = 8, 16
#: Texts from which the common hashes are estimated, how many of them share a common hash, and the most that are kept.
SAMPLE, COMMON, MOST_COMMON = 5_000, 5, 100_000
#: So many texts' names are broadcast where their texts are looked up; more are shuffled.
BROADCAST = 200_000
#: Bytes of texts that are hashed in one go, and names of texts that a task remembers; bounds on memory only.
GROUP, REMEMBERED = 1 << 20, 100_000
#: Longs of parities for each text; more tell larger sets apart.
PARITY = 4
MIX = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """A hash of every word (A-Z in lower case) of each text, for about GROUP bytes of texts at once."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < GROUP):
            size += len(texts[end]) + 1
            end += 1
        data = np.frombuffer(b"\n".join(texts[at:end]).lower(), dtype=np.uint8)
        shown = ~BLANK[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], shown, [False]])))
        starts, sizes = edge[::2], edge[1::2] - edge[::2]
        if len(starts):
            begin = np.cumsum(sizes) - sizes
            offset = np.arange(int(sizes.sum())) - np.repeat(begin, sizes)
            powers = np.full(int(sizes.max()), np.uint64(MIX))
            powers[0] = 1
            powers = np.multiply.accumulate(powers)
            h = _mixed(np.add.reduceat((data[shown].astype(np.uint64) + np.uint64(1)) * powers[offset], begin))
        else:
            h = np.zeros(0, dtype=np.uint64)
        ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
        cut = np.searchsorted(starts, ends)
        for low, high in zip([0, *cut[:-1].tolist()], cut.tolist()):
            yield h[low:high]
        at = end


def shingle_hashes(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """For each text hashes of all shingles in their order; a shorter text is one shingle, none where it has no word."""
    for own in word_hashes(texts):
        width = min(words, len(own))
        n = len(own) - width + 1 if width else 0
        h = np.full(n, np.uint64(width))
        for k in range(width):
            h = h * np.uint64(MIX) + own[k : k + n]
        yield _mixed(h)


def shingle_sets(texts: list[bytes], words: int = 5) -> Iterator[np.ndarray]:
    """For each text the distinct hashes of all shingles in ascending order."""
    for own in shingle_hashes(texts, words):
        yield np.unique(own)


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes of a set; of sets of ``similarity`` or more one is shared.

    ``common`` hashes (in ascending order) come last, those of the smallest ``rank`` first.
    """
    if not len(own):
        return own
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        late = common[at] == own
        own = np.concatenate([own[~late], own[late][np.argsort(rank[at[late]], kind="stable")]])
    return own[: len(own) - ceil(similarity * len(own) - 1e-9) + 1]


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def text_name(column: str = "text") -> Column:
    """128 bits of the SHA-256 of a text; null counts as empty."""
    return F.unhex(F.substring(F.sha2(text_bytes(column), 256), 1, 32))


def name_of(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def reachable(n, pos, m, at, similarity: float, least=np.minimum):
    """Whether sets of ``n`` and ``m`` hashes whose first common one is at ``pos`` and ``at`` can be similar."""
    return least(n - pos, m - at) >= (n + m) * (similarity / (1 + similarity)) - 1e-6


def parities(own: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY classes of hashes whether an odd number of the set falls in it, as PARITY longs."""
    size = np.bincount((own >> np.uint64(32)) % np.uint64(64 * PARITY), minlength=64 * PARITY)
    return np.packbits(size & 1 == 1, bitorder="little").view("<i8")


def wide_parities(own: np.ndarray) -> bytes:
    """As ``parities``, with at least one bit for each hash of the set (a power of two of them, 256 at least)."""
    bits = max(64 * PARITY, 1 << max(0, len(own) - 1).bit_length())
    return np.packbits(np.bincount((own >> np.uint64(32)) % np.uint64(bits), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two wide parities differ, the longer one folded to the shorter."""
    a, b = (np.frombuffer(v, dtype=np.uint8) for v in (x, y))
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def close(differ, n, m, similarity: float):
    """Whether sets of ``n`` and ``m`` hashes whose parities ``differ`` in so many bits can be similar."""
    return differ <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6


ODD = [f"p{k}" for k in range(PARITY)]


def neighbours(work: Scratch, rows: DataFrame, similarity: float, most: int, *order: str) -> DataFrame:
    """Pairs (a, b) of different clusters among ``most`` neighbours under one hash, in an order by chance that depends on ``order``."""
    hot = rows.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > HOT_COMPONENT)
    salt = F.coalesce(F.pmod(F.xxhash64("node", F.lit(-1)), F.ceil(F.col("size") / (HOT_COMPONENT // 2))), F.lit(0))
    window = Window.partitionBy("h", "salt").orderBy(F.xxhash64(*order), "node")
    row = F.struct("node", "cluster", "n", "pos", *ODD)
    lags = F.array(*(F.lag(row, k).over(window) for k in range(1, most + 1)))
    found = rows.join(work.stored(hot, "hot"), "h", "left").withColumn("salt", salt).withColumn("o", lags)
    found = found.select("node", "cluster", "n", "pos", *ODD, F.explode("o").alias("o")).where("cluster <> o.cluster")
    found = found.where(reachable(F.col("n"), F.col("pos"), F.col("o.n"), F.col("o.pos"), similarity, F.least))
    differ = reduce(lambda x, y: x + y, (F.bit_count(F.col(p).bitwiseXOR(F.col(f"o.{p}"))) for p in ODD))
    found = found.where(close(differ, F.col("n"), F.col("o.n"), similarity))
    return found.select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()


def remaining(work: Scratch, rows: DataFrame, similarity: float) -> DataFrame:
    """All pairs (a, b) of different clusters that share a hash and can be similar.

    Texts of the largest cluster under a hash are compared with the others only, and these with
    each other, block against block: a block has at most about half of HOT_COMPONENT texts.
    """
    sizes = rows.groupBy("h", "cluster").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("h").agg(F.max(F.struct("size", "cluster")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("clusters")).where("clusters > 1")
    half = max(1, HOT_COMPONENT // 2)
    sizes = sizes.select("h", F.col("main.cluster").alias("main"), F.ceil(F.col("main.size") / half).alias("first"), F.ceil((F.col("size") - F.col("main.size")) / half).alias("second"))
    last = F.col("first") + F.col("second") - 1
    block = F.when(F.col("cluster") == F.col("main"), F.pmod(F.xxhash64("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("second")))
    others = F.when(F.col("block") < F.col("first"), F.sequence("first", last)).otherwise(F.sequence(F.lit(0).cast("long"), last))
    dealt = spread_join(rows, work.stored(sizes, "sizes"), "h").withColumn("block", block).withColumn("other", F.explode(others))
    dealt = dealt.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "cluster", F.col("n").cast("long"), F.col("pos").cast("long"), *ODD)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.concatenate([*found, np.zeros((0, 2), dtype=np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """Pairs within whole groups; rows are sorted by (h, i, j)."""
            h, i, j, block, node, cluster, n, pos, *odd = columns
            odd = np.stack(odd, axis=1).view(np.uint64)
            cut = np.flatnonzero((np.diff(h) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            found, count = [], 0
            for begin, end in zip([0, *cut.tolist()], [*cut.tolist(), len(h)]):
                own = np.arange(begin, end)
                x, y = own[block[begin:end] == i[begin]], own[block[begin:end] == j[begin]]
                one = i[begin] == j[begin]
                x, y = (x, y) if one or len(x) < len(y) else (y, x)
                for k, at in enumerate(x):
                    to = y[k + 1 :] if one else y
                    to = to[(cluster[to] != cluster[at]) & reachable(n[at], pos[at], n[to], pos[to], similarity)]
                    to = to[close(np.bitwise_count(odd[to] ^ odd[at]).sum(axis=1, dtype=np.int64), n[at], n[to], similarity)]
                    if len(to):
                        found.append(np.stack([np.full(len(to), node[at]), node[to]], axis=1))
                        count += len(to)
                    if count > 1 << 16:
                        yield batch_of(found)
                        found, count = [], 0
            yield batch_of(found)

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            ends = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]) | (columns[2] != columns[2][-1])) if len(columns[0]) else []
            before = held[-1] if held else None
            if before is not None and len(columns[0]) and any(before[c][-1] != columns[c][0] for c in range(3)):
                yield from out([np.concatenate(parts) for parts in zip(*held)])
                held = []
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                held.append([c[:whole] for c in columns])
                yield from out([np.concatenate(parts) for parts in zip(*held)])
                held = []
            if whole < len(columns[0]):
                held.append([c[whole:] for c in columns])
        if held:
            yield from out([np.concatenate(parts) for parts in zip(*held)])

    return dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(compared, "a long, b long").distinct()


def shingle_links(work: Scratch, texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join every two nodes of ``similarity`` or more, directly or through others.

    ``texts`` have (doc, name, text); ``nodes`` (node, called, fp, odd, wide, size, best): its number, its name, its
    fingerprint, its parities, few and wide, its number of hashes, and the place of one row of it.
    """

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node and text of some nodes, once for each of equal rows."""
        of = F.broadcast(wanted) if wanted.count() <= BROADCAST else wanted
        return texts.join(of, texts.doc.eqNullSafe(F.col("d")) & (texts.name == F.col("n"))).select("node", "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in shingle_sets(batch.column(0).to_pylist(), words):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["h"])

    step = max(1, nodes.count() // SAMPLE)
    some = texts.where(F.pmod(F.xxhash64("name", F.lit(7)), F.lit(step)) == 0).select("text").distinct()
    common = some.mapInArrow(hashes, "h long").groupBy("h").count().where(F.col("count") >= COMMON)
    found = common.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()
    common = np.array([r.h for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(common)
    common, rank = common[order], (len(found) - np.arange(len(found)))[order]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh, names, sets, first = {}, [], [], []
            for text in batch.column(0).to_pylist():
                name = name_of(normalised(text))
                if name not in seen:  # an exact copy has the same rows
                    fresh.setdefault(name, text)
            if len(seen) + len(fresh) > REMEMBERED:
                seen.clear()
            seen.update(fresh)
            for name, own in zip(fresh, shingle_sets(list(fresh.values()), words)):
                if len(own):
                    names.append(name)
                    sets.append(len(own))
                    first.append(prefix(own, common, rank, similarity))
            sizes = np.array([len(f) for f in first], dtype=np.int64)
            h = np.concatenate([*first, np.zeros(0, dtype=np.uint64)]).view(np.int64)
            called = np.repeat(np.frombuffer(b"".join(names), dtype=">i8").reshape(-1, 2).astype(np.int64), sizes, axis=0)
            n = np.repeat(np.array(sets, dtype=np.int32), sizes)
            pos = np.concatenate([*(np.arange(k, dtype=np.int32) for k in sizes), np.zeros(0, dtype=np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, called[:, 0].copy(), called[:, 1].copy(), n, pos)], ["h", "c0", "c1", "n", "pos"])

    # A hash that only exact copies of one text have is not shared.
    own = work.stored(texts.select("text").mapInArrow(prefixes, "h long, c0 long, c1 long, n int, pos int"), "prefixes")
    several = own.groupBy("h").agg(F.min("c0").alias("x"), F.max("c0").alias("y"), F.min("c1").alias("u"), F.max("c1").alias("v")).where("x <> y OR u <> v").select("h")
    half = lambda k: F.conv(F.hex(F.substring("called", k, 8)), 16, -10).cast("long")
    shared = own.join(several, "h").distinct().join(nodes.select(half(1).alias("c0"), half(9).alias("c1"), "node", *(F.col("odd")[k].alias(p) for k, p in enumerate(ODD))), ["c0", "c1"]).select("h", "node", "n", "pos", *ODD)
    shared = work.stored(shared, "shared")
    work.release(own)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [own.tobytes() for own in shingle_sets(batch.column(1).to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "hashes"])

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [close(differing(x, y), n, m, similarity) for x, y, n, m in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(c)] for c in (2, 3))
            good = pa.array([alike(p, q, similarity) for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    def both_sides(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
        """Stored ``pairs`` with what ``left`` says of a and ``right`` of b; nodes of many pairs are dealt on either side."""
        return spread_join(spread_join(pairs, left, "a"), right, "b", by="a")

    def checked(pairs: DataFrame) -> DataFrame:
        first = work.stored(pairs, "candidates")
        left = nodes.select(F.col("node").alias("a"), F.col("wide").alias("x"), F.col("size").alias("n"))
        right = nodes.select(F.col("node").alias("b"), F.col("wide").alias("y"), F.col("size").alias("m"))
        # the wide parities, some hundredths of a set's bytes, decide most pairs before any set travels
        pairs = work.stored(both_sides(first, left, right).select("a", "b", "x", "y", "n", "m").mapInArrow(possible, "a long, b long"), "pairs")
        of = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = work.stored(of.join(nodes, "node").select("node", F.col("best.doc_id").alias("d"), F.col("best.name").alias("n")), "wanted")
        held = work.stored(texts_of(wanted).groupBy("node").agg(F.first("text").alias("text")).mapInArrow(sets, "node long, hashes binary"), "sets")
        both = both_sides(pairs, held.select(F.col("node").alias("a"), F.col("hashes").alias("x")), held.select(F.col("node").alias("b"), F.col("hashes").alias("y")))
        found = work.stored(both.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "links")
        work.release(first, pairs, wanted, held)
        return found

    # SimHash: nodes of one fingerprint, and the first nodes of fingerprints within three bits
    some = nodes.where("fp IS NOT NULL")
    first = work.stored(some.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprints")
    equal = some.join(first.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = work.stored(linked(first.select("fp")), "near").join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    near = near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def clustered(links: DataFrame) -> DataFrame:
        found = shared.join(components(links), "node", "left").select("h", "node", "n", "pos", *ODD, F.coalesce("root", "node").alias("cluster"))
        return work.stored(found, "clusters")

    # one order for all hashes makes few pairs that join most of a group; one for each hash joins what still stands beside it
    first = neighbours(work, shared.withColumn("cluster", F.col("node")), similarity, NEIGHBOURS, "node")
    links = checked(equal.union(near).union(first).distinct())
    for turn in (lambda rows: neighbours(work, rows, similarity, MORE_NEIGHBOURS, "node", "h"), lambda rows: remaining(work, rows, similarity)):
        rows = clustered(links)
        links = links.union(checked(turn(rows)))
        work.release(rows)
    work.release(shared)
    return links


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns as they are.

    Texts are near copies if their sets of ``words``-word shingles have a Jaccard similarity of
    ``similarity`` or more; a group is what such links reach. The row with the smallest doc_id
    stays (a null one only where there is no other), at ties that with the smallest hash of its
    text; of equal rows one stays. Null and empty texts, and those of blanks, are copies of each
    other and of nothing else. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Scratch(spark, "near-copies")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_bytes().alias("text"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Names of the text as it is and normalised, the fingerprint and the parities of its shingles."""
        for batch in batches:
            names, called, fps, odd, wide, size = [], [], [], [], [], []
            whole = batch.column(1).to_pylist()
            for text, hashes in zip(whole, shingle_hashes(whole, words)):
                names.append(name_of(text))
                called.append(name_of(normalised(text)))
                fps.append(int(np.uint64(majority(hashes)).view(np.int64)) if len(hashes) else None)
                own = np.unique(hashes)
                odd.append(parities(own))
                wide.append(wide_parities(own))
                size.append(len(own))
            columns = [batch.column(0), pa.array(names, pa.binary()), pa.array(called, pa.binary()), pa.array(fps, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(wide, pa.binary()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "called", "fp", "odd", "wide", "size"])

    marks = texts.mapInArrow(described, "doc_id long, name binary, called binary, fp long, odd array<long>, wide binary, size int")
    same = [F.first(c).alias(c) for c in ("fp", "odd", "wide", "size")]
    counted = marks.groupBy("called", "doc_id", "name").agg(F.count("*").alias("copies"), *same)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name", "copies")
    nodes = counted.groupBy("called").agg(F.min(place).alias("best"), *same)
    nodes = work.stored(nodes.select(F.monotonically_increasing_id().alias("node"), "called", "fp", "odd", "wide", "size", "best"), "nodes")
    roots = components(shingle_links(work, texts.select("doc", text_name().alias("name"), "text"), nodes, words, similarity))
    of = nodes.select("node", "best").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("b"))
    kept = stored(of.select(F.col("b.doc_id").alias("doc"), F.col("b.name").alias("name"), F.col("b.copies").alias("copies")), "near-copies-kept")
    work.drop()

    # Columns of docs go through in a struct, so that no name can clash.
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), text_name().alias("name"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))

    def only(part: DataFrame) -> DataFrame:
        part = part.select(F.col("doc").alias("d"), F.col("name").alias("of"))
        return whole.join(part, F.col("doc").eqNullSafe(F.col("d")) & (F.col("name") == F.col("of")), "left_semi")

    single = only(kept.where("copies = 1")).select("row.*")
    more = kept.where("copies > 1")
    if more.isEmpty():
        return single
    return single.unionByName(only(more).groupBy("doc", "name").agg(F.first("row").alias("row")).select("row.*"))
