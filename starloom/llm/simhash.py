"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance.

A fingerprint of 64 bits is split into BLOCKS blocks. Two fingerprints that differ in at most
``distance`` bits agree on at least BLOCKS - distance blocks, so each is dealt once under every
choice of that many blocks (20 choices of about 32 bits for distance 3), and only fingerprints
of one group are compared. Equal fingerprints are one node from the start, a group gives a spanning forest of
its links rather than all pairs, and components grow by alternating stars on the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, small_batches, spread_join, stored, text_bytes

BLOCKS = 6
#: More than the number of any mask.
SERIES = 1000
#: A group of more fingerprints is split again by the bits its members don't share, before one task gets it.
HOT_GROUP = 200_000
#: Within a task a larger group is split by further blocks before its members are compared.
COMPARED = 1024
ALL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Majority of the bits of XXH64 over all shingles; of no word: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(whole, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
        starts = np.concatenate([[0], ends[:-words]])
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(whole[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row for each of ``docs``."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int, blocks: int, agree: int) -> list[int]:
    """Masks over every choice of ``agree`` of ``blocks`` blocks of the bits set in ``bits``."""
    places = [k for k in range(64) if bits >> k & 1]
    parts = [sum(1 << int(k) for k in part) for part in np.array_split(np.array(places, dtype=np.int64), blocks)]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: np.ndarray, free: int, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``distance`` among distinct fingerprints that share all bits but ``free``."""
    if len(fps) > COMPARED and bin(free).count("1") >= 2 * (distance + 1):
        found = []
        for mask in block_masks(free, distance + 1, 1):
            order = np.argsort(fps & np.uint64(mask), kind="stable")
            cuts = np.flatnonzero(np.diff((fps & np.uint64(mask))[order]) != 0) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    found += links(fps[part], free & ~mask, distance)
        return found
    rest, found = np.sort(fps), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                new = rest[near]
                rest = rest[~near]
                found += [(int(at), int(x)) for x in new]
                queue += list(new)
    return found


def linked(fps: DataFrame, distance: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """Links (s, a, b), a < b, that join every two of the distinct fingerprints ``fp`` of one ``s`` within ``distance``, directly or through others."""
    spark = fps.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    if "s" not in fps.columns:
        fps = fps.withColumn("s", F.lit(0))
    masks = block_masks(ALL, blocks, blocks - distance)
    seconds = [block_masks(ALL & ~m, distance + 1, 1) for m in masks]

    def keyed(rows: DataFrame, own: list[tuple[int, int]]) -> DataFrame:
        """One row for each mask; ``k``: number of the mask, and SERIES times that of the fingerprint's series."""
        choices = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in own])
        return rows.select("s", "fp", F.explode(choices).alias("c")).select((F.col("s") * SERIES + F.col("c.k")).alias("k"), "c.key", "fp")

    first = keyed(fps.select("s", "fp"), list(enumerate(masks)))
    hot = first.groupBy("k", "key").count().where(F.col("count") > HOT_GROUP).select("k", "key")
    hot = stored(hot, "simhash-hot")
    if hot.isEmpty():
        dealt = first
    else:
        cold = first.join(hot, ["k", "key"], "left_anti")
        again = first.join(hot, ["k", "key"], "left_semi")
        parts = [keyed(again.where(F.col("k") % SERIES == k).select((F.col("k") / SERIES).cast("int").alias("s"), "fp"), [(100 + 10 * k + j, m | masks[k]) for j, m in enumerate(seconds[k])]) for k in range(len(masks))]
        dealt = cold
        for part in parts:
            dealt = dealt.unionByName(part)
    free_of = {k: ALL & ~m for k, m in enumerate(masks)} | {100 + 10 * k + j: ALL & ~(m | masks[k]) for k in range(len(masks)) for j, m in enumerate(seconds[k])}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3

        def out(k: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """Compare within whole groups; rows are sorted by (k, key)."""
            cut = np.flatnonzero((np.diff(k) != 0) | (np.diff(key) != 0)) + 1
            begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(k)]])
            size = end - begin
            two = begin[size == 2]
            x, y = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.bitwise_count(x ^ y) <= distance
            found = list(zip(x[near].tolist(), y[near].tolist()))
            series = (k[two][near] // SERIES).tolist()
            for g in np.flatnonzero(size > 2):
                own = np.unique(fp[begin[g] : end[g]]).view(np.uint64)
                more = links(own, free_of[int(k[begin[g]]) % SERIES], distance)
                found += more
                series += [int(k[begin[g]]) // SERIES] * len(more)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(series, pa.int32()), pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["s", "a", "b"])

        for batch in batches:
            held = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns)]
            k, key, fp = held
            if not len(k):
                continue
            ends = np.flatnonzero((k != k[-1]) | (key != key[-1]))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield out(k[:whole], key[:whole], fp[:whole])
                held = [h[whole:] for h in held]
        if len(held[0]) > 1:
            yield out(*held)

    return dealt.repartition("k", "key").sortWithinPartitions("k", "key").mapInArrow(compared, "s int, a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b) that isn't a root itself.

    Alternating large and small stars; every round is written to the shared folder, so a lost
    executor costs one round, and nothing but two sums per round reaches the driver. Nodes with
    many edges are dealt to several tasks.
    """
    spark = edges.sparkSession

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return r.n, r.x

    last = Scratch(spark, "components")
    edges = last.stored(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct(), "edges")
    before = mark(edges)
    while before[0]:
        work = Scratch(spark, "components")
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = spread_join(both, least, "a", by="b", total=2 * before[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = spread_join(large, least, "a", by="b").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        following = Scratch(spark, "components")
        edges = following.stored(small, "edges")
        work.drop()
        last.drop()
        last = following
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``.

    component_id is the smallest doc_id among all rows reachable over links, the row itself
    included; a null doc_id never is the smallest, and a component of nulls only has none. Null
    and empty texts, and those of blanks, have fingerprint zero and are linked like any other.
    Repeated rows have equal fingerprints. An empty table gives no rows; columns besides doc_id
    and text are not read. A fingerprint of many rows is dealt to several tasks.
    """
    spark = docs.sparkSession
    own = stored(fingerprints(docs, words), "simhash")
    work = Scratch(spark, "simhash")
    nodes = work.stored(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(work.stored(linked(nodes, distance), "links"))
    roots = found.select(F.col("node").alias("fp"), "root")
    of = work.stored(nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    smallest = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(spread_join(of, smallest, "root").select("fp", "component_id"), "simhash-names")
    work.drop()
    return spread_join(own, named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str = "fp"):
    """A signed long as 16 lower-case hexadecimal digits of its unsigned value."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
