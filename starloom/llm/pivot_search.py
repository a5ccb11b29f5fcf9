"""Exact top-k inner products by a pivot-distance index.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, queries a zero; the
largest inner product is then the smallest distance. Every vector is keyed by its nearest pivot and its
distance from it, and lies in an annulus (pivot, ring). By the triangle inequality
|d(q, p) - d(x, p)| <= d(q, x) an annulus has a largest inner product that any of its vectors can reach with a query. Each
query expands over the annuli sorted by that bound, in turns that hold GROWTH times the vectors of
the turn before, and stops for itself where the bound falls below the score that its k best reach.

Equal vectors are one entry, which holds the k + 1 smallest ids: no answer needs more. Pivots grow with the
square root of the vectors; they and the rings come from a bounded sample. Every vector is
indexed, and the result is exact whatever the sample.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import spread_join, stored

#: Vectors of the sample for each pivot; the fewest and most pivots (one for every ROOT of the square root of the vectors); rings of a pivot.
SAMPLE, PIVOTS, MOST_PIVOTS, ROOT, RINGS = 128, 32, 512, 8, 64
#: Vectors of an index block and queries of a query block at most; blocks of an annulus that share a join key.
BLOCK, QUERIES, PART = 1024, 128, 8
#: Vectors that a query sees in its first turn at least, and by how much a turn grows.
FIRST, GROWTH = 4096, 8
#: Query blocks whose best scores a task remembers; only how many rows it sends on depends on it.
REMEMBERED = 64
SLACK = 1e-6


def integer_vectors(vectors: DataFrame, scale: int, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, vec: floor(scale * x) of each component as little-endian doubles (exact); invalid rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                x = np.floor(np.array(own, dtype=np.float64) * scale) + 0.0
                out.append(x.astype("<f8").tobytes() if np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    return rows.mapInArrow(run, "vec_id long, vec binary").where("vec is not null")


class Space:
    """Pivots and rings over vectors of ``size`` components (shorter ones end in zeros)."""

    def __init__(self, sample: list[bytes], size: int, largest: float, pivots: int = PIVOTS):
        self.size, self.largest = size, largest
        x = self.lifted(self.matrix(sample), True)
        draw = np.random.default_rng(17)
        pivots = x[draw.permutation(len(x))[:pivots]]
        for _ in range(5):
            near = self.distances(x, pivots).argmin(axis=1)
            pivots = np.stack([x[near == k].mean(axis=0) if (near == k).any() else p for k, p in enumerate(pivots)])
        self.pivots = pivots
        pivot, d = self.place(x)
        self.edges = [np.unique(np.quantile(d[pivot == k], np.linspace(0, 1, RINGS + 1)[1:-1])) if (pivot == k).any() else np.zeros(0) for k in range(len(pivots))]

    def matrix(self, vecs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(vecs), self.size))
        for k, v in enumerate(vecs):
            own = np.frombuffer(v, dtype="<f8")
            out[k, : len(own)] = own
        return out

    def lifted(self, x: np.ndarray, data: bool) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
        return np.concatenate([x, more[:, None]], axis=1)

    @staticmethod
    def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))

    def place(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(lifted, self.pivots)
        pivot = d.argmin(axis=1)
        return pivot, d[np.arange(len(d)), pivot]

    def reach(self, x: np.ndarray, pivot: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(query, annulus): the largest inner product that a vector of the annulus can have with the query."""
        d = self.distances(self.lifted(x, False), self.pivots)[:, pivot]
        squares = (x * x).sum(axis=1)[:, None] + self.largest**2
        gap = np.maximum(np.maximum(d - high, low - d) - SLACK * (1 + np.sqrt(squares)), 0)
        return (squares - gap * gap) / 2 * (1 + SLACK) + SLACK


def squeezed(x: np.ndarray) -> bytes:
    """A matrix of whole numbers in the smallest type that holds it, with the type's size in front."""
    top = np.abs(x).max() if x.size else 0
    kind = next((k for k in ("<i1", "<i2", "<i4") if top <= np.iinfo(k).max), "<f8")
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def spread_out(data: bytes, size: int) -> np.ndarray:
    kind = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}[data[0]]
    return np.frombuffer(data, dtype=kind, offset=1).reshape(-1, size).astype(np.float64)


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; doubles do where no sum can pass 2**53."""
    if exact:
        return q @ x.T
    return np.array([[int(a) for a in r] for r in q], dtype=object) @ np.array([[int(a) for a in r] for r in x], dtype=object).T


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query with all other vectors.

    ``is_query`` is a condition on vec_id. Ties go to the smaller vec_id; a query with fewer
    candidates has as many rows. Rows whose id is null, and vectors that are null or hold null or non-finite
    components, take no part. The candidates of a query are all rows but its own: rows that repeat are a candidate
    each, of one another too, and a query row that repeats is answered each time. Shorter vectors
    count as ending in zeros, the empty one as zeros. Scores are exact; one beyond 64 bits is an
    error. Without queries or candidates there are no rows.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    shape = "query_id long, rank int, vec_id long, score long"
    rows = integer_vectors(vectors, scale, id_column, vector_column)
    first = Window.partitionBy("vec").orderBy("vec_id")
    ids = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = stored(ids.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "pivot-entries")
    asked = stored(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "vec"), "pivot-queries")

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(v, dtype="<f8") for v in batch.column(0).to_pylist()]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([max(map(len, own))], pa.int32()), pa.array([max(float(np.sqrt(v @ v)) for v in own)])], ["size", "norm"])

    most = entries.select("vec").mapInArrow(norms, "size int, norm double").agg(F.max("size").alias("size"), F.max("norm").alias("norm")).first()
    if most.size is None or asked.isEmpty():
        return spark.createDataFrame([], shape)
    pivots = min(MOST_PIVOTS, max(PIVOTS, isqrt(entries.count()) // ROOT))
    sample = [bytes(r.vec) for r in entries.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(SAMPLE * pivots).collect()]
    space = Space(sample, max(most.size, 1), most.norm, pivots)
    exact = most.norm**2 < 2**52

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(0).to_pylist()
            if not vecs:
                continue
            pivot, d = space.place(space.lifted(space.matrix(vecs), True))
            ring = [int(np.searchsorted(space.edges[p], x)) for p, x in zip(pivot, d)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(d), *batch.columns], ["pivot", "ring", "d", *batch.schema.names])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one annulus, sorted by distance."""
        held, at = [], None

        def out() -> pa.RecordBatch:
            d = [h[0] for h in held]
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([min(d)]), pa.array([max(d)]), pa.array([len(held)], pa.int64()), pa.array([squeezed(space.matrix([h[1] for h in held]))], pa.binary()), pa.array([[h[2] for h in held]], pa.list_(pa.list_(pa.int64())))], ["pivot", "ring", "low", "high", "n", "data", "ids"])

        for batch in batches:
            for pivot, ring, d, vec, own in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (at != (pivot, ring) or len(held) >= BLOCK):
                    yield out()
                    held.clear()
                at = (pivot, ring)
                held.append((d, vec, own))
        if held:
            yield out()

    index = entries.mapInArrow(placed, "pivot int, ring int, d double, vec binary, ids array<bigint>").repartitionByRange("pivot", "d").sortWithinPartitions("pivot", "ring", "d")
    index = stored(index.mapInArrow(blocks, "pivot int, ring int, low double, high double, n long, data binary, ids array<array<bigint>>"), "pivot-index")
    # at most MOST_PIVOTS * RINGS rows, whatever the number of vectors
    rings = sorted((r.pivot, r.ring, r.low, r.high, r.n) for r in index.groupBy("pivot", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect())
    pivot, ring = (np.array([r[i] for r in rings], dtype=np.int64) for i in (0, 1))
    low, high, count = (np.array([r[i] for r in rings], dtype=np.float64) for i in (2, 3, 4))
    parts = np.ceil(count / (BLOCK * PART)).astype(np.int64)
    several = spark.createDataFrame([(int(p), int(r), int(n)) for p, r, n in zip(pivot, ring, parts)], "pivot int, ring int, parts int")
    keyed = index.join(F.broadcast(several), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("low", "high", "n"), F.col("parts")).cast("int")).drop("parts")

    def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries near one another share a block: (qb, vecs)."""
        held, n, base = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([held], pa.list_(pa.binary()))], ["qb", "vecs"])

        for batch in batches:
            for vec in batch.column("vec").to_pylist():
                held.append(vec)
                if len(held) >= QUERIES:
                    yield out()
                    held, n = [], n + 1
        if held:
            yield out()

    near = asked.select("vec").distinct().mapInArrow(placed, "pivot int, ring int, d double, vec binary").repartitionByRange("pivot", "d").sortWithinPartitions("pivot", "d")
    qblocks = stored(near.mapInArrow(query_blocks, "qb long, vecs array<binary>"), "pivot-query-blocks")

    visit_type = "pivot int, ring int, part int, qb long, qi array<int>, queries binary, least array<double>"

    def visits(turn: int):
        """The annuli that each query of a block sees in this turn; those of one annulus travel together."""
        seen_low, seen_high = (FIRST * GROWTH ** (turn - 1) if turn else 0), FIRST * GROWTH**turn

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qb, vecs, own, scores, enough in zip(*(c.to_pylist() for c in batch.columns)):
                    q = space.matrix(vecs)
                    reach = space.reach(q, pivot, low, high)
                    least = np.full(len(vecs), -np.inf)
                    for qi, score, n in zip(own or [], scores or [], enough or []):
                        if n > k:
                            least[qi] = score
                    order = np.argsort(-reach, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    now = (before >= seen_low) & (before < seen_high) & (np.take_along_axis(reach, order, axis=1) >= least[:, None])
                    wanted = np.zeros(now.shape, dtype=bool)
                    np.put_along_axis(wanted, order, now, axis=1)
                    out: list[list] = [[] for _ in range(7)]
                    for at in np.flatnonzero(wanted.any(axis=0)).tolist():
                        some = np.flatnonzero(wanted[:, at])
                        for part in range(int(parts[at])):
                            for column, value in zip(out, (int(pivot[at]), int(ring[at]), part, qb, some.tolist(), squeezed(q[some]), least[some].tolist())):
                                column.append(value)
                    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["pivot", "ring", "part", "qb", "qi", "queries", "least"])

        return run

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            for qb, of, queries, least, lo, hi, at, data, ids in zip(*(c.to_pylist() for c in batch.columns)):
                q, x, of = spread_out(queries, space.size), spread_out(data, space.size), np.array(of)
                own = best.pop(qb, None)
                if own is None:
                    own = np.full((QUERIES, k + 1), -np.inf)
                    if len(best) >= REMEMBERED:
                        best.popitem(last=False)
                floor = np.maximum(np.array(least), own[of, 0])
                best[qb] = own
                live = np.flatnonzero(space.reach(q, np.array([at]), np.array([lo]), np.array([hi]))[:, 0] >= floor)
                if not len(live):
                    continue
                s = products(q[live], x, exact)
                f = s.astype(np.float64)
                m = min(k + 1, f.shape[1])
                top = np.partition(f, f.shape[1] - m, axis=1)[:, f.shape[1] - m :]
                merged = np.sort(np.concatenate([own[of[live]], top], axis=1), axis=1)[:, -(k + 1) :]
                own[of[live]] = merged
                a, b = np.nonzero(f >= np.maximum(floor[live], merged[:, 0])[:, None])
                sizes = [len(ids[j]) for j in b]
                same = (q[live][a] == x[b]).all(axis=1)
                columns = [
                    pa.array(np.full(sum(sizes), qb), pa.int64()),
                    pa.array(np.repeat(of[live][a], sizes), pa.int32()),
                    pa.array([i for j in b for i in ids[j]], pa.int64()),
                    pa.array([v for v, n in zip((int(v) for v in s[a, b]), sizes) for _ in range(n)], pa.int64()),
                    pa.array(np.repeat(same, sizes), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["qb", "qi", "vec_id", "score", "same"])

    best_first = Window.partitionBy("qb", "qi").orderBy(F.desc("score"), "vec_id", F.desc("same"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("n", F.row_number().over(best_first)).where(F.col("n") <= k + 1).drop("n")

    state, turn = None, 0
    while True:
        if state is None:
            asking = qblocks.select("qb", "vecs", *(F.lit(None).cast(t).alias(n) for n, t in (("qi", "array<int>"), ("score", "array<bigint>"), ("n", "array<bigint>"))))
        else:
            reached = state.groupBy("qb", "qi").agg(F.min("score").alias("score"), F.count("*").alias("n"))
            reached = reached.groupBy("qb").agg(F.collect_list(F.struct("qi", "score", "n")).alias("r"))
            asking = qblocks.join(reached, "qb", "left").select("qb", "vecs", "r.qi", "r.score", "r.n")
        wanted = stored(asking.mapInArrow(visits(turn), visit_type), "pivot-visits")
        if wanted.isEmpty():  # annuli are sorted by what they can reach, so none that follows is wanted either
            break
        pairs = wanted.join(keyed, ["pivot", "ring", "part"]).select("qb", "qi", "queries", "least", "low", "high", "pivot", "data", "ids")
        found = best(pairs.mapInArrow(compared, "qb long, qi int, vec_id long, score long, same boolean"))
        state = stored(found if state is None else best(state.unionByName(found)), "pivot-best")
        if FIRST * GROWTH**turn >= count.sum():  # all have been seen
            break
        turn += 1

    # one row for each distinct query vector, its k + 1 best in order; the query's own row is left out
    lists = state.groupBy("qb", "qi").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", (~F.col("same")).alias("other")))).alias("best"))
    lists = qblocks.select("qb", F.posexplode("vecs").alias("qi", "vec")).join(lists, ["qb", "qi"]).select("vec", "best")
    mine = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("query_id")) & ~x["other"]), True)
    found = spread_join(asked, lists, "vec").withColumn("mine", mine)
    ranked = F.slice(F.filter("best", lambda x, i: i != F.col("mine") - 1), 1, k)
    out = found.select("query_id", F.posexplode(ranked).alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.place <> c.place
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
