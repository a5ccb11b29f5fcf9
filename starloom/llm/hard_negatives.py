"""Hard negatives: rows of another label whose score lies just below a positive's, by vantage-point trees.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, anchors a zero, so that
d^2 = |q|^2 + M^2 - 2 * score: high scores are near, and a window of scores is an annulus around the
anchor. A top tree over a bounded sample deals all vectors to leaves; the rows of a leaf, dealt to several tasks where
there are many, are cut into trees of at most TREE rows, built over all of them. Vantage points and the least and largest
distance of what lies under them bound, by the triangle inequality, the scores that a leaf can have with an anchor.

An anchor visits the leaves of the top tree nearest first, in turns that hold GROWTH times the vectors of the
turn before, and in each tree again the nearest leaves first; leaves wholly nearer than the annulus or farther than the k
best found so far are left out. First its own label's nearest rows are searched (an annulus without bounds), then, for the
windows that their scores give, the rows of other labels.

Rows of one vector and label are one entry with the k + 1 smallest ids: no answer needs more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, spread_join
from starloom.llm.pivot_search import products, spread_out, squeezed

#: Rows of a tree and of its leaves; leaves of the top tree at most, and vectors of the sample for each.
TREE, LEAF, MOST_LEAVES, SAMPLE = 4096, 64, 1024, 64
#: Trees that one task builds on average: the rows of a large leaf are dealt to several tasks.
DEALT = 8
#: Anchors of a block; vectors that an anchor sees in its first turn at least, and by how much a turn grows.
ANCHORS, FIRST, GROWTH = 128, 16_384, 16
#: Anchor blocks that meet one copy of a tree; a tree that more of them visit is copied.
VISITS = 32
SLACK = 1e-6
LEAST, MOST = -(2**63 - 1), 2**63 - 1


def labelled_vectors(vectors: DataFrame, scale: int, shift: int, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """vec_id, label, vec: floor(scale * x) of each component as little-endian doubles (exact); invalid rows are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(2).to_pylist():
                x = np.floor(np.array(own, dtype=np.float64) * scale) + 0.0
                out.append(x.astype("<f8").tobytes() if np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    vec_id, label = F.col(id_column).cast("long"), F.col(label_column).cast("long")
    shifted = F.when(vec_id % shift == 0, (label + 1) % 10).otherwise(label) if shift else label
    rows = vectors.select(vec_id.alias("vec_id"), shifted.alias("label"), F.col(vector_column).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull()))
    return rows.mapInArrow(run, "vec_id long, label long, vec binary").where("vec is not null")


def paths(depth: int) -> np.ndarray:
    """(leaf, level): the nodes above each leaf, in heap order."""
    return ((np.arange(2**depth)[:, None] + 2**depth) >> (depth - np.arange(depth))) - 1


class Vantage:
    """A vantage-point tree with ``depth`` levels over rows of ``x``: vantage points and medians by node, in heap order.

    A row goes left where its distance is at most the node's median, else right; leaf numbers are
    the paths. Equal rows stay together, whatever their number.
    """

    def __init__(self, x: np.ndarray, depth: int, seed: int):
        draw, nodes = np.random.default_rng([seed, len(x)]), 2**depth - 1
        self.depth = depth
        self.points = np.zeros((nodes, x.shape[1]))
        self.medians = np.full(nodes, -1.0)
        at = np.zeros(len(x), dtype=np.int64)
        for node in range(nodes):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            some = rows[draw.integers(len(rows), size=1)]
            self.points[node] = x[rows[distances(x[some], x[rows])[0].argmax()]]  # a far corner splits better than the middle
            d = distances(self.points[node][None], x[rows])[0]
            self.medians[node] = np.median(d)
            at[rows] = 2 * node + 1 + (d > self.medians[node])
        self.paths = paths(depth)

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and its distances to all vantage points."""
        d = distances(x, self.points)
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            at = 2 * at + 1 + (d[rows, at] > self.medians[at])
        return at - (2**self.depth - 1), d


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0))


def score_bounds(squares: np.ndarray, d: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf): the least and the largest score that a leaf can hold.

    ``squares``: |q|^2 + M^2; ``d`` (query, leaf, level): distance to the vantage points over a leaf; ``low``,
    ``high`` (leaf, level): those of the rows of the leaf. An empty leaf has high below low.
    """
    near = np.maximum(np.maximum(d - high, low - d), 0).max(axis=2, initial=0)
    far = (d + high).min(axis=2, initial=np.inf)
    slack = SLACK * (1 + np.sqrt(squares))[:, None]
    near, far = np.maximum(near - slack, 0), far + slack
    most = (squares[:, None] - near * near) / 2
    return (squares[:, None] - far * far) / 2 * (1 + SLACK) - np.abs(most) * SLACK - SLACK, most + np.abs(most) * SLACK + SLACK


class Space:
    """Vectors of ``size`` components (shorter ones end in zeros), the largest norm, and the top tree."""

    def __init__(self, size: int, largest: float):
        self.size, self.largest = size, largest
        self.exact = largest**2 < 2**52

    def matrix(self, vecs: list[bytes]) -> np.ndarray:
        out = np.zeros((len(vecs), self.size))
        for k, v in enumerate(vecs):
            own = np.frombuffer(v, dtype="<f8")
            out[k, : len(own)] = own
        return out

    def lifted(self, x: np.ndarray, data: bool = True) -> np.ndarray:
        more = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(axis=1), 0)) if data else np.zeros(len(x))
        return np.concatenate([x, more[:, None]], axis=1)

    def squares(self, q: np.ndarray) -> np.ndarray:
        return (q * q).sum(axis=1) + self.largest**2

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.asarray(products(q[None], x, self.exact)[0]).astype(np.int64)


class Tree:
    """The rows of one tree in the order of its leaves, as they are sent to those that visit it."""

    def __init__(self, space: Space, data: bytes, labels: list[int], starts: list[int], points: bytes, low: list[float], high: list[float]):
        self.x, self.labels = spread_out(data, space.size), np.array(labels, dtype=np.int64)
        self.starts = np.array(starts, dtype=np.int64)
        leaves = len(starts) - 1
        self.depth = leaves.bit_length() - 1
        self.points = np.frombuffer(points, dtype="<f8").reshape(-1, space.size + 1)
        self.low, self.high = (np.array(v).reshape(leaves, self.depth) for v in (low, high))
        self.paths = paths(self.depth)

    @staticmethod
    def build(space: Space, vecs: list[bytes], labels: list[int], seed: int) -> tuple[np.ndarray, tuple]:
        """The order of the rows, and what __init__ takes."""
        x = space.matrix(vecs)
        depth = max(0, (len(vecs) - 1) // LEAF).bit_length()
        lifted = space.lifted(x)
        tree = Vantage(lifted, depth, seed)
        leaf, d = tree.leaves(lifted)
        order = np.argsort(leaf, kind="stable")
        starts = np.searchsorted(leaf[order], np.arange(2**depth + 1))
        low, high = np.full((2**depth, depth), np.inf), np.full((2**depth, depth), -np.inf)
        for level in range(depth):
            own = d[np.arange(len(x)), tree.paths[leaf, level]]
            np.minimum.at(low[:, level], leaf, own)
            np.maximum.at(high[:, level], leaf, own)
        return order, (squeezed(x[order]), [labels[k] for k in order], starts.tolist(), tree.points.astype("<f8").tobytes(), low.ravel().tolist(), high.ravel().tolist())

    def bounds(self, space: Space, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(space.lifted(q, False), self.points)
        least, most = score_bounds(space.squares(q), d[:, self.paths], self.low, self.high)
        empty = self.starts[1:] == self.starts[:-1]
        most[:, empty] = -np.inf
        return least, most

    def search(self, space: Space, q: np.ndarray, label: int, same: bool, least: np.ndarray, most: np.ndarray, floors: np.ndarray, tops: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window floors <= score <= tops the rows with the k highest scores and their ties, nearest leaves first."""
        floors = floors.copy()
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)) for _ in floors]
        order, at, several = np.argsort(-most, kind="stable"), 0, 2
        while at < len(order):
            some = order[at : at + several]
            at, several = at + several, 2 * several
            # what the annuli still need: not wholly nearer than all of them, and not farther than the best found
            live = (most[some][:, None] >= floors) & (least[some][:, None] <= tops)
            if not live.any():
                if most[some[-1]] < floors.min():
                    break
                continue
            rows = np.concatenate([np.arange(self.starts[leaf], self.starts[leaf + 1]) for leaf in some[live.any(axis=1)]])
            rows = rows[(self.labels[rows] == label) == same]
            if not len(rows):
                continue
            s = space.scores(q, self.x[rows])
            down = np.argsort(-s, kind="stable")
            falling = -s[down]
            for w in range(len(floors)):
                begin, end = np.searchsorted(falling, -tops[w], side="left"), np.searchsorted(falling, -floors[w], side="right")
                if end > begin + k:
                    end = max(begin + k, min(end, np.searchsorted(falling, falling[begin + k - 1], side="right")))
                if end <= begin:
                    continue
                scores, places = (np.concatenate([a, b]) for a, b in zip(found[w], (-falling[begin:end], rows[down[begin:end]])))
                if len(scores) > k:
                    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
                    scores, places = scores[scores >= edge], places[scores >= edge]
                if len(scores) >= k:
                    floors[w] = max(floors[w], scores.min())
                found[w] = scores, places
        return found


VISIT = "qi array<int>, queries binary, labels array<long>, floors array<array<long>>, tops array<array<long>>"
CELL = "data binary, rows array<long>, starts array<int>, points binary, low array<double>, high array<double>, ids array<array<long>>"


class Index:
    """All entries in trees under the leaves of a top tree, stored in the shared folder."""

    def __init__(self, scratch: Scratch, entries: DataFrame, size: int, largest: float, total: int):
        spark = scratch.spark
        self.scratch, self.space = scratch, Space(size, largest)
        depth = min(MOST_LEAVES.bit_length() - 1, max(0, (total - 1) // TREE).bit_length())
        sample = [bytes(r.vec) for r in entries.orderBy(F.xxhash64("vec", "label"), "vec", "label").select("vec").limit(SAMPLE << depth).collect()]
        self.top = Vantage(self.space.lifted(self.space.matrix(sample)), depth, 17)
        placed = scratch.stored(entries.mapInArrow(self._placed(), "leaf int, vec binary, label long, ids array<long>"), "placed")
        dealt = F.broadcast(placed.groupBy("leaf").agg(F.ceil(F.count("*") / (TREE * DEALT)).cast("int").alias("parts")))  # a row for each of at most MOST_LEAVES leaves
        part = F.pmod(F.xxhash64("vec", "label"), F.col("parts")).cast("int")
        cells = placed.join(dealt, "leaf").select("leaf", part.alias("part"), "vec", "label", "ids").repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.xxhash64("vec"))
        shape = f"leaf int, tree long, n long, top_low array<double>, top_high array<double>, {CELL}"
        self.trees = scratch.stored(cells.mapInArrow(self._built(), shape), "trees")
        # a few numbers for each of at most MOST_LEAVES leaves
        width = self.trees.select("leaf", "tree", "n", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(max(depth, 1) - 1)).alias("level"), "top_low", "top_high")).alias("z"))
        ranges = width.groupBy("leaf", "z.level").agg(F.min("z.top_low").alias("low"), F.max("z.top_high").alias("high")).collect()
        # one row for each task that built trees, some 100 bytes for TREE * DEALT vectors
        sizes = self.trees.groupBy("leaf", F.shiftright("tree", 32).alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("trees")).collect()
        leaves = 2**depth
        self.low, self.high = np.full((leaves, depth), np.inf), np.full((leaves, depth), -np.inf)
        for r in ranges:
            if r.level < depth:
                self.low[r.leaf, r.level], self.high[r.leaf, r.level] = r.low, r.high
        self.count = np.zeros(leaves, dtype=np.int64)
        self.several: list[list[tuple[int, int]]] = [[] for _ in range(leaves)]  # (part, trees) of each leaf
        for r in sizes:
            self.count[r.leaf] += r.n
            self.several[r.leaf].append((r.part, r.trees))

    def _placed(self):
        space, top = self.space, self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    leaf, _ = top.leaves(space.lifted(space.matrix(batch.column(0).to_pylist())))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.columns], ["leaf", "vec", "label", "ids"])

        return run

    def _built(self):
        space, top = self.space, self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            at, number = None, 0

            def out() -> pa.RecordBatch:
                vecs, labels, ids = (list(c) for c in zip(*held))
                _, d = top.leaves(space.lifted(space.matrix(vecs)))
                over = d[:, top.paths[at[0]]] if top.depth else np.zeros((len(vecs), 1))
                order, (data, own, starts, points, low, high) = Tree.build(space, vecs, labels, number)
                row = {"leaf": [at[0]], "tree": [(at[1] << 32) + number], "n": [len(held)], "top_low": [over.min(axis=0).tolist()], "top_high": [over.max(axis=0).tolist()], "data": [data], "rows": [own], "starts": [starts], "points": [points], "low": [low], "high": [high], "ids": [[ids[k] for k in order]]}
                types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.list_(pa.int64()))]
                return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types)], list(row))

            for batch in batches:
                for leaf, part, vec, label, ids in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and (at != (leaf, part) or len(held) >= TREE):
                        yield out()
                        number = number + 1 if at == (leaf, part) else 0
                        held.clear()
                    at = (leaf, part)
                    held.append((vec, label, ids))
            if held:
                yield out()

        return run

    def _visits(self, turn: int, k: int):
        """The leaves that each anchor of a block sees in this turn, as one row for each tree and block."""
        space, top, low, high, count, several = self.space, self.top, self.low, self.high, self.count, self.several
        seen_low, seen_high = (FIRST * GROWTH ** (turn - 1) if turn else 0), FIRST * GROWTH**turn

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for qb, vecs, labels, floors, tops in zip(*(c.to_pylist() for c in batch.columns)):
                    q = space.matrix(vecs)
                    d = distances(space.lifted(q, False), top.points)[:, top.paths]
                    least, most = score_bounds(space.squares(q), d, low, high)
                    most[:, count == 0] = -np.inf
                    order = np.argsort(-most, axis=1, kind="stable")
                    before = np.cumsum(count[order], axis=1) - count[order]
                    now = (before >= seen_low) & (before < seen_high)
                    wanted = np.zeros(now.shape, dtype=bool)
                    np.put_along_axis(wanted, order, now, axis=1)
                    for i, (f, t) in enumerate(zip(floors, tops)):
                        needed = np.zeros(wanted.shape[1], dtype=bool)
                        for a, b in zip(f, t):
                            needed |= (most[i] >= a) & (least[i] <= b)
                        wanted[i] &= needed
                    wanted[:, count == 0] = False
                    out: list[list] = [[] for _ in range(8)]
                    for leaf in np.flatnonzero(wanted.any(axis=0)).tolist():
                        some = np.flatnonzero(wanted[:, leaf]).tolist()
                        for tree in ((part << 32) + number for part, trees in several[leaf] for number in range(trees)):
                            for column, value in zip(out, (leaf, tree, qb, some, squeezed(q[some]), [labels[i] for i in some], [floors[i] for i in some], [tops[i] for i in some])):
                                column.append(value)
                    nested = pa.list_(pa.list_(pa.int64()))
                    types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), nested, nested)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["leaf", "tree", "qb", "qi", "queries", "labels", "floors", "tops"])

        return run

    def _compared(self, same: bool, k: int):
        """Rows of one copy of a tree come before those that visit it."""
        space = self.space

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = ids = None
            for batch in batches:
                for qb, qi, queries, labels, floors, tops, data, rows, starts, points, low, high, own in zip(*(c.to_pylist() for c in batch.columns)):
                    if qb is None:
                        tree, ids = Tree(space, data, rows, starts, points, low, high), own
                        continue
                    q = spread_out(queries, space.size)
                    least, most = tree.bounds(space, q)
                    out: list[list] = [[] for _ in range(6)]
                    for i, at in enumerate(qi):
                        found = tree.search(space, q[i], labels[i], same, least[i], most[i], np.array(floors[i], dtype=np.int64), np.array(tops[i], dtype=np.int64), k)
                        for w, (scores, places) in enumerate(found):
                            for score, place in zip(scores.tolist(), places.tolist()):
                                equal = same and bool((tree.x[place] == q[i]).all())
                                for vec_id in ids[place][:k]:
                                    for column, value in zip(out, (qb, at, w, vec_id, score, equal)):
                                        column.append(value)
                    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["qb", "qi", "w", "vec_id", "score", "equal"])

        return run

    def nearest(self, blocks: DataFrame, same: bool, k: int) -> DataFrame:
        """qb, qi, w, vec_id, score, equal: for every window of every anchor its k highest scores among rows of the same
        (or of other) labels, ties to the smaller id. ``blocks``: qb, vecs, labels, floors, tops (lists by anchor)."""
        first = Window.partitionBy("qb", "qi", "w").orderBy(F.desc("score"), "vec_id", F.desc("equal"))

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).drop("place")

        state, turn, total = None, 0, int(self.count.sum())
        while True:
            asking = blocks
            if state is not None:  # windows with k rows end at the k-th score from now on
                reached = state.groupBy("qb", "qi", "w").agg(F.min("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= k)
                reached = reached.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("qi", "w"), "score"))).alias("reached"))
                raised = "transform(floors, (f, i) -> transform(f, (x, w) -> greatest(x, coalesce(try_element_at(reached, named_struct('qi', int(i), 'w', int(w))), x))))"
                asking = blocks.join(reached, "qb", "left").select("qb", "vecs", "labels", F.expr(raised).alias("floors"), "tops")
            visits = self.scratch.stored(asking.mapInArrow(self._visits(turn, k), f"leaf int, tree long, qb long, {VISIT}"), "visits")
            # a tree is copied for every VISITS blocks that visit it, so no task meets more
            copies = visits.groupBy("leaf", "tree").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("copies"))
            trees = self.trees.join(copies, ["leaf", "tree"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            dealt = visits.join(copies, ["leaf", "tree"]).withColumn("copy", F.pmod(F.xxhash64("qb"), F.col("copies")).cast("int"))
            both = trees.select("leaf", "tree", "copy", "data", "rows", "starts", "points", "low", "high", "ids")
            both = both.unionByName(dealt.drop("copies"), allowMissingColumns=True)
            both = both.repartition("leaf", "tree", "copy").sortWithinPartitions("leaf", "tree", "copy", F.asc_nulls_first("qb"))
            columns = [c.split()[0] for c in f"qb long, {VISIT}, {CELL}".split(", ")]
            found = best(both.select(*columns).mapInArrow(self._compared(same, k), "qb long, qi int, w int, vec_id long, score long, equal boolean"))
            state = self.scratch.stored(found if state is None else best(state.unionByName(found)), "best")
            if FIRST * GROWTH**turn >= total:
                return state
            turn += 1


def _window_floor(score: int) -> int:
    """The least whole score that is at least 80 of 100 parts of another."""
    return -((-4 * score) // 5)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, scale: int = 256, shift: int = 7, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the vectors floor(scale * x); the higher comes first, ties go to the smaller id. The
    positives of an anchor are its first rows of the same label, its own row left out. For each of them the first rows of
    other labels are returned whose score is at most the positive's and at least 80 % of it (none for a negative
    score). Where the id is divisible by ``shift`` (0: nowhere) the label first becomes (label + 1) % 10.

    ``is_anchor`` is a condition on vec_id. Rows whose id, label or vector is null, or whose vector holds null or
    non-finite components, take no part. Rows that repeat are rows each: candidates of one another, and answered each time
    as anchors. Shorter vectors count as ending in zeros. Scores are exact; one beyond 64 bits is an error. Without
    anchors there are no rows. Columns besides the three named are not read. The index and the
    states of the turns are kept in the shared folder while the result is read.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    scratch, k = Scratch(spark, "hard-negatives"), max(positives + 1, negatives)
    rows = labelled_vectors(vectors, scale, shift, id_column, vector_column, label_column)
    few = Window.partitionBy("vec", "label").orderBy("vec_id")
    ids = rows.withColumn("place", F.row_number().over(few)).where(F.col("place") <= k)
    entries = scratch.stored(ids.groupBy("vec", "label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    key = F.concat(F.unhex(F.lpad(F.hex("label"), 16, "0")), "vec")
    asked = scratch.stored(rows.where(is_anchor).select(F.col("vec_id").alias("anchor_id"), "label", "vec", key.alias("key")), "anchors")

    @F.pandas_udf("double")
    def norm(vecs: pd.Series) -> pd.Series:
        return vecs.map(lambda v: float(np.sqrt((np.frombuffer(v, dtype="<f8") ** 2).sum())))

    most = entries.agg(F.max(F.length("vec") / 8).cast("int").alias("size"), F.max(norm("vec")).alias("norm"), F.count("*").alias("n")).first()
    if not most.n or asked.isEmpty():
        return spark.createDataFrame([], shape)
    index = Index(scratch, entries, max(most.size, 1), most.norm, most.n)

    space, top = index.space, index.top

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf, _ = top.leaves(space.lifted(space.matrix(batch.column(0).to_pylist())))
                yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int32()), *batch.columns], ["leaf", "vec", "label", "key"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors near one another share a block."""
        held, n, base = [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            vecs, labels, keys = (list(c) for c in zip(*held))
            nested = pa.list_(pa.list_(pa.int64()))
            bounds = [pa.array([[[bound]] * len(held)], nested) for bound in (LEAST, MOST)]
            return pa.RecordBatch.from_arrays([pa.array([base + n], pa.int64()), pa.array([vecs], pa.list_(pa.binary())), pa.array([labels], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.binary())), *bounds], ["qb", "vecs", "labels", "keys", "floors", "tops"])

        for batch in batches:
            for _, vec, label, own in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((vec, label, own))
                if len(held) >= ANCHORS:
                    yield out()
                    held, n = [], n + 1
        if held:
            yield out()

    distinct = asked.select("vec", "label", "key").distinct().mapInArrow(near, "leaf int, vec binary, label long, key binary")
    distinct = distinct.repartitionByRange("leaf", F.xxhash64("key")).sortWithinPartitions("leaf", F.xxhash64("key"))
    asking = scratch.stored(distinct.mapInArrow(blocks, "qb long, vecs array<binary>, labels array<long>, keys array<binary>, floors array<array<long>>, tops array<array<long>>"), "blocks")

    alike = index.nearest(asking.drop("keys"), True, positives + 1)
    # anchors of one vector and label differ in which equal row is their own, not in the scores of their positives
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", (~F.col("equal")).alias("other"))))
    lists = scratch.stored(alike.groupBy("qb", "qi").agg(ordered.alias("best")), "positives")
    own = F.array_position(F.transform("best", lambda x: ~x["other"]), True)
    others = F.slice(F.filter("best", lambda x, i: (own == 0) | (i != own - 1)), 1, positives)
    scores = lists.select("qb", "qi", F.array_sort(F.array_distinct(F.transform(others, lambda x: -x["s"]))).alias("scores"))
    scores = scores.withColumn("scores", F.filter("scores", lambda x: x >= 0))  # 80 parts of a negative score lie above it
    by_block = scores.groupBy("qb").agg(F.map_from_entries(F.collect_list(F.struct("qi", "scores"))).alias("scores"))

    @F.pandas_udf("array<array<long>>")
    def floor_of(tops: pd.Series) -> pd.Series:
        return tops.map(lambda own: [[_window_floor(int(t)) for t in one] for one in own])

    tops = F.transform("vecs", lambda _, i: F.coalesce(F.try_element_at("scores", i.cast("int")), F.array().cast("array<bigint>")))
    windows = asking.drop("floors", "tops").join(by_block, "qb").withColumn("tops", tops).drop("scores")
    windows = scratch.stored(windows.withColumn("floors", floor_of("tops")), "windows")
    unlike = index.nearest(windows.select("qb", "vecs", "labels", "floors", "tops"), False, negatives)
    found = unlike.groupBy("qb", "qi", "w").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("negatives"))
    tops_of = windows.select("qb", F.posexplode("tops").alias("qi", "own")).select("qb", "qi", F.posexplode("own").alias("w", "top"))
    found = found.join(tops_of, ["qb", "qi", "w"]).groupBy("qb", "qi").agg(F.map_from_entries(F.collect_list(F.struct("top", "negatives"))).alias("by_score"))
    keys = asking.select("qb", F.posexplode("keys").alias("qi", "key"))
    results = keys.join(lists, ["qb", "qi"]).join(found, ["qb", "qi"]).select("key", "best", "by_score")

    mine = F.array_position(F.transform("best", lambda x: (x["vec_id"] == F.col("anchor_id")) & ~x["other"]), True)
    answered = spread_join(asked.select("anchor_id", "key"), results, "key").withColumn("mine", mine)
    kept = F.slice(F.filter("best", lambda x, i: i != F.col("mine") - 1), 1, positives)
    pairs = answered.select("anchor_id", "by_score", F.explode(kept).alias("p")).select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.s")).alias("positive_score"), "by_score")
    out = pairs.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.try_element_at("by_score", F.col("positive_score"))).alias("rank", "n"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.place AS anchor, a.vec_id AS anchor_id, c.place AS other, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.w, c.w) AS BIGINT) AS score
  FROM v a JOIN v c ON a.place <> c.place
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
