"""Packing of whole documents into sequences: linear grouping, configurations, best fit.

Only documents longer than a sequence are cut. The lengths of all pieces are counted in Spark; the
histogram (as many numbers as a sequence has tokens) is all that the driver needs, whatever the number
of documents:

1. Pieces longer than ``small`` are sorted by length and cut into groups of equal numbers; every
   group is rounded up to its largest length, so few sizes are left.
2. Configurations of these sizes (what one sequence may hold) are optimised: the linear programme
   that covers all groups by the fewest sequences, its columns generated by a knapsack over the dual
   prices. Each is used a whole number of times; what that leaves goes to step 4.
3. Actual pieces take the places of their groups, in the order of their lengths, so the room that
   rounding up had reserved is free again.
4. Those left over and the small ones go best-fit decreasing into the free room, then into new sequences.

No step handles pieces one by one: pieces are runs of places in the order of lengths, sequences are runs
of equal room, and the plan is a list of ``Run`` whose number depends on the lengths and groups only. A
piece finds its place from its length and its number among the pieces of that length,
which Spark gives by counts of the parts of a stored table.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.byte_ids import byte_ids
from starloom.llm.common import Scratch, small_batches, tokenizer_path

#: Groups that the large lengths are rounded to; lengths of at most room / SMALL are small.
GROUPS, SMALL = 128, 16
#: Shares of a sequence that the actual pieces of a configuration have to fill, else its pieces go to best fit; each is tried.
FULL = (0.98, 0.99, 0.993, 0.995, 0.997, 0.999)
#: The linear programme ends within GAP of its best, or after ROUNDS of up to BATCH new columns; its inverse is made anew after REFRESH pivots.
GAP, ROUNDS, BATCH, REFRESH, EPSILON = 1e-3, 1500, 48, 64, 1e-9


class Run(NamedTuple):
    """``count`` pieces from place ``first`` on go to sequences from ``sequence`` on, ``each`` to one, the first of them at ``offset``."""

    first: int
    count: int
    sequence: int
    each: int
    offset: int
    length: int


def linear_groups(histogram: np.ndarray, smallest: int, groups: int) -> list[tuple[int, int, int]]:
    """(size, first place, number) of each group of the pieces of at least ``smallest`` that leave some room, longest first; equal sizes are one group."""
    lengths = np.arange(len(histogram))[::-1]
    upto = np.cumsum(histogram[::-1])
    whole = int(histogram[-1])
    total = int(histogram[smallest:].sum()) - whole
    if total <= 0:
        return []
    starts = whole + np.unique(np.arange(min(groups, total)) * total // min(groups, total))
    sizes = lengths[np.searchsorted(upto, starts, side="right")]
    found: list[tuple[int, int, int]] = []
    for first, end, size in zip(starts.tolist(), [*starts[1:].tolist(), whole + total], sizes.tolist()):
        if found and found[-1][0] == size:
            found[-1] = (size, found[-1][1], end - found[-1][1])
        else:
            found.append((size, first, end - first))
    return found


def best_patterns(sizes: np.ndarray, prices: np.ndarray, room: int, most: int) -> list[tuple[float, np.ndarray]]:
    """Multisets of sizes within ``room``, dearest first: the dearest of all, and the dearest that hold a given size.

    One table of the unbounded knapsack serves for all of them.
    """
    value, took = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    small_first, own = sizes[order], prices[order]
    fitting = np.searchsorted(small_first, np.arange(room + 1), side="right").tolist()
    for r in range(int(small_first[0]), room + 1):
        gains = value[r - small_first[: fitting[r]]]
        gains += own[: fitting[r]]
        best = gains.argmax()
        if gains[best] > value[r - 1]:
            value[r], took[r] = gains[best], order[best]
        else:
            value[r] = value[r - 1]
    found, seen = [], set()
    with_size = value[room - sizes] + prices
    for start in np.argsort(-with_size, kind="stable")[:most].tolist():
        if with_size[start] <= 1 + EPSILON:
            break
        pattern, r = np.zeros(len(sizes)), room - int(sizes[start])
        pattern[start] += 1
        while r > 0:
            if took[r] < 0:
                r -= 1
            else:
                pattern[took[r]] += 1
                r -= int(sizes[took[r]])
        if (key := pattern.tobytes()) not in seen:
            seen.add(key)
            found.append((float(with_size[start]), pattern))
    return found


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with the largest pivot of each column; no threads of a numeric library take part."""
    n = len(matrix)
    work = np.concatenate([matrix, np.eye(n)], axis=1)
    for k in range(n):
        top = k + int(np.abs(work[k:, k]).argmax())
        if top != k:
            work[[k, top]] = work[[top, k]]
        work[k] /= work[k, k]
        rest = work[:, k].copy()
        rest[k] = 0
        work -= np.outer(rest, work[k])
    return work[:, n:]


def configurations(sizes: list[int], numbers: list[int], room: int) -> list[tuple[dict[int, int], int]]:
    """Configurations (group: how many in a sequence) with the whole number of times that each is used.

    The basis starts with sequences of one size each and is improved by columns of negative reduced
    cost, until the dual bound shows that it is within GAP of the best. Times are rounded down, so
    a few pieces of a group may stay without a place.
    """
    size, need = np.array(sizes), np.array(numbers, dtype=np.float64)
    m = len(size)
    basis = np.diag(np.maximum(room // size, 1).astype(np.float64))
    inverse = np.diag(1 / np.diag(basis))
    cost, times, steps = np.ones(m), inverse @ need, 0

    def pivot(column: np.ndarray, price: float = 1) -> None:
        nonlocal inverse, times, steps
        way = inverse @ column
        up = way > EPSILON
        if not up.any():
            return
        ratio = np.full(m, np.inf)
        ratio[up] = times[up] / way[up]
        out = int(ratio.argmin())
        basis[:, out], cost[out] = column, price
        steps += 1
        if steps % REFRESH == 0:
            inverse = inverted(basis)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
        times = np.maximum(inverse @ need, 0)

    for _ in range(ROUNDS):
        prices = cost @ inverse
        worst = int(prices.argmin())
        if prices[worst] < -EPSILON:  # a column that gives back one piece of a group costs nothing
            back = np.zeros(m)
            back[worst] = -1
            pivot(back, 0)
            continue
        found = best_patterns(size, np.maximum(prices, 0), room, BATCH)
        if not found or found[0][0] <= 1 + GAP:
            break
        for _, column in found:
            if cost @ inverse @ column > 1 + GAP:
                pivot(column)
    found, left = [], np.array(numbers, dtype=np.int64)
    for column, often in zip(basis.T.astype(np.int64), times):
        if (column < 0).any() or not (column > 0).any():
            continue
        used = np.flatnonzero(column)
        whole = min(int(often + 1e-6), int((left[used] // column[used]).min()))
        if whole > 0:
            left -= whole * column
            found.append(({int(k): int(column[k]) for k in used}, whole))
    return found


class Rooms:
    """Runs of sequences by their free room: a heap of (first sequence, number) for each amount of room."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, free: int, first: int, number: int) -> None:
        if free <= 0 or number <= 0:
            return
        if free not in self.runs:
            self.runs[free] = []
            insort(self.sizes, free)
        heapq.heappush(self.runs[free], (first, number))

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size``."""
        at = bisect_left(self.sizes, size)
        return self.sizes[at] if at < len(self.sizes) else None

    def take(self, free: int) -> tuple[int, int]:
        run = heapq.heappop(self.runs[free])
        if not self.runs[free]:
            del self.runs[free]
            self.sizes.remove(free)
        return run


def best_fit(pieces: list[tuple[int, int, int]], rooms: Rooms, room: int, sequences: int) -> tuple[list[Run], int]:
    """Runs for pieces (length, first place, number), longest first, each into the tightest room; the sequences after that."""
    runs = []
    for length, first, number in sorted(pieces, key=lambda p: (-p[0], p[1])):
        while number:
            free = rooms.tightest(length)
            if free is None:
                each = room // length
                rooms.add(room, sequences, -(-number // each))
                sequences += -(-number // each)
                continue
            start, several = rooms.take(free)
            each = free // length  # what is left of a room is tighter than any other, so the next piece goes there too
            whole = min(several, number // each)
            if whole:
                runs.append(Run(first, whole * each, start, each, room - free, length))
                rooms.add(free - each * length, start, whole)
                first, number, start, several = first + whole * each, number - whole * each, start + whole, several - whole
            if several and number and number < each:
                runs.append(Run(first, number, start, number, room - free, length))
                rooms.add(free - number * length, start, 1)
                first, number, start, several = first + number, 0, start + 1, several - 1
            rooms.add(free, start, several)
    return runs, sequences


def substituted(groups: list[tuple[int, int, int]], found: list[tuple[dict[int, int], int]], histogram: np.ndarray, full: float) -> tuple[list[Run], list[tuple[int, int, int]], Rooms, int]:
    """Actual pieces in the places of their groups: runs, pieces (length, first place, number) without a place, free rooms, sequences.

    The pieces of a group are taken in the order of their lengths. Configurations that actual
    pieces would fill to less than ``full`` of a sequence on average are given up, their pieces are left over.
    """
    room = len(histogram) - 1
    lengths = np.arange(len(histogram))[::-1]
    upto = np.cumsum(histogram[::-1])
    tokens = np.concatenate([[0], np.cumsum(histogram[::-1] * lengths)])
    ends = np.concatenate([[0], upto])

    def mass(place: np.ndarray) -> np.ndarray:
        """Tokens of all pieces before a place."""
        at = np.searchsorted(upto, place, side="right")
        return tokens[at] + (place - ends[at]) * lengths[np.minimum(at, room)]

    mean = [float(mass(np.array([f + n]))[0] - mass(np.array([f]))[0]) / n for _, f, n in groups]
    kept = [(p, often) for p, often in found if sum(mean[g] * a for g, a in p.items()) >= full * room]
    taken = [first for _, first, _ in groups]
    runs, rooms, sequences = [], Rooms(), 0
    for pattern, often in kept:
        starts = []
        for g in sorted(pattern):
            for _ in range(pattern[g]):
                starts.append(taken[g])
                taken[g] += often
        cuts = {0, often}
        for start in starts:  # where the length of the piece in this place changes
            a, b = np.searchsorted(upto, [start, start + often - 1], side="right")
            cuts |= {int(x) - start for x in upto[a:b]}
        cuts = sorted(cuts)
        for low, high in zip(cuts, cuts[1:]):
            offset = 0
            for start in starts:
                length = int(lengths[np.searchsorted(upto, start + low, side="right")])
                runs.append(Run(start + low, high - low, sequences + low, 1, offset, length))
                offset += length
            rooms.add(room - offset, sequences + low, high - low)
        sequences += often
    left = []
    for (_, first, number), start in zip(groups, taken):
        end = first + number
        while start < end:
            at = int(np.searchsorted(upto, start, side="right"))
            stop = min(end, int(upto[at]))
            left.append((int(lengths[at]), start, stop - start))
            start = stop
    return runs, left, rooms, sequences


def packing_plan(histogram: np.ndarray, groups: int = GROUPS, small: int = SMALL) -> tuple[list[Run], int]:
    """The runs, sorted by place, that give every piece its sequence and offset, and the number of sequences.

    ``histogram``: pieces of each length from 0 to the room. Places are in the order of falling lengths. Of the shares
    in FULL that which leads to the fewest sequences is taken.
    """
    histogram = np.asarray(histogram, dtype=np.int64)
    room = len(histogram) - 1
    smallest = room // small + 1
    sizes = linear_groups(histogram, smallest, groups)
    found = configurations([g[0] for g in sizes], [g[2] for g in sizes], room) if sizes else []
    before = np.cumsum(histogram[::-1])[::-1] - histogram
    rest = [(n, int(before[n]), int(histogram[n])) for n in (room, *range(smallest - 1, 0, -1)) if histogram[n]]
    plans = []
    for full in FULL:
        runs, left, rooms, sequences = substituted(sizes, found, histogram, full)
        more, sequences = best_fit(left + rest, rooms, room, sequences)
        plans.append((sequences, runs + more))
    sequences, runs = min(plans, key=lambda p: p[0])
    return sorted(runs), sequences


PIECES = "doc_id long, piece int, start long, length long, {}, part int, number long"


def _pieces(docs: DataFrame, path: str, room: int, end_id: int, digest: bool) -> DataFrame:
    """All pieces, each with its task and its number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = byte_ids(path), TaskContext.get().partitionId(), [0] * (room + 1)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if digest else pa.list_(pa.int32()), pa.int32(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids", "part", "number"]
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
            rows.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(ids) - room * ((len(ids) - 1) // room), len(ids) + 1, room)]
                for k, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    own = ids[start:end]
                    rows.append((doc_id, k, start, end - start, zlib.crc32(own.tobytes()) if digest else own.astype(np.int32), part, seen[end - start]))
                    seen[end - start] += 1
                    if len(rows) >= 4096:
                        yield out()
        if rows:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES.format("ids_crc32 long" if digest else "ids array<int>"))


def _packed(docs: DataFrame, path: str | None, room: int, end_id: int, groups: int, digest: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "best-fit")
    pieces = scratch.stored(_pieces(docs, path or tokenizer_path("byte_bpe_50k.json"), room, end_id, digest), "pieces")
    counts = scratch.stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(room + 1, dtype=np.int64)  # as many numbers as a sequence has tokens
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r.length] = r.n
    runs, _ = packing_plan(histogram, groups)
    columns = [np.array([r[i] for r in runs], dtype=np.int64) for i in range(6)]
    longer = np.cumsum(histogram[::-1])[::-1] - histogram

    def places(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        first, _, sequence, each, offset, size = columns
        for length, number in batches:
            place = longer[length.to_numpy()] + number.to_numpy()
            run = np.searchsorted(first, place, side="right") - 1
            k = place - first[run]
            yield pd.DataFrame({"sequence_id": sequence[run] + k // each[run], "offset": offset[run] + k % each[run] * size[run]})

    # the number of a piece among all of its length: those of the parts before, and its own in its part
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before.hint("merge"), ["length", "part"])  # this table grows with the input: never broadcast
    placed = numbered.withColumn("at", F.pandas_udf(places, "sequence_id long, offset long")(F.col("length"), F.col("before") + F.col("number")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32" if digest else "ids", "at.sequence_id", "at.offset")


def pack_best_fit(docs: DataFrame, path: str | None = None, room: int = 1024, end_id: int = 2, groups: int = GROUPS) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids, sequence_id, offset.

    Documents of at most ``room`` ids (the end id counts) are one piece; longer ones are cut into pieces
    of ``room`` ids, of which only the first may be shorter. The pieces of a sequence lie at gapless offsets
    from 0 and are ``room`` ids together at most. A null or empty text is the end id alone. Rows with
    equal or null doc_id are separate documents; an empty table gives no rows; columns besides doc_id and
    text are not read. The pieces are kept in the shared folder while the result is read.
    """
    return _packed(docs, path, room, end_id, groups, False)


def best_fit_digest(docs: DataFrame, path: str | None = None, room: int = 1024, end_id: int = 2, groups: int = GROUPS) -> DataFrame:
    """pack_best_fit with ids_crc32 (of little-endian unsigned 32-bit ids) in place of the ids."""
    return _packed(docs, path, room, end_id, groups, True)
