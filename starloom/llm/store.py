"""Content-addressed store of token ids.

Layout of a store, all Parquet:

* ``stage/kind=chunk``: digest (SHA-256 of data), data (ids as little-endian unsigned 16- or
  32-bit integers). A rolling hash over the last WINDOW ids cuts the streams, so equal passages
  give equal chunks wherever they stand, and each is stored once.
* ``recipes``: one row for each document in ascending doc_id order (part, pos): n_tokens, the
  digests of its chunks and their lengths, the Merkle root over the digests.
* ``manifest``: one row for each part of the recipes: documents, tokens, tokens before it, the
  Merkle root over its documents' roots.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.byte_ids import byte_ids
from starloom.llm.common import small_batches, spread_join, stored, tokenizer_path

#: The rolling hash spans so many ids; a cut falls where its upper bits are zero.
WINDOW = 8
#: Lengths of chunks in ids: the shortest, the mean beyond it (a power of two), the longest.
SHORTEST, MEAN, LONGEST = 64, 512, 4096
#: Digests that a task remembers in order not to send a chunk twice; a bound on memory only.
REMEMBERED = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def rolling_cuts(ids: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash allows a cut."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(ids), dtype=np.uint64)
    for back in range(min(WINDOW, len(ids))):
        total[back:] += mixed[: len(ids) - back] * np.uint64(pow(0xD6E8FEB86659FD93, back, 1 << 64))
    total *= MIX
    return np.flatnonzero((total >> np.uint64(64 - MEAN.bit_length() + 1)) == 0) + 1


def chunk_ends(*streams: np.ndarray) -> list[list[int]]:
    """Where the chunks of each stream end; the last is the length of the stream.

    The streams are hashed in one go. A window that reaches back into the stream before ends
    earlier than the shortest chunk, so what it says is never used.
    """
    sizes = np.array([len(s) for s in streams])
    first = np.cumsum(sizes) - sizes
    cuts = rolling_cuts(np.concatenate(streams)) if len(streams) else np.zeros(0, dtype=np.int64)
    low, high = np.searchsorted(cuts, first, side="right"), np.searchsorted(cuts, first + sizes)
    out = []
    for start, n, a, b in zip(first.tolist(), sizes.tolist(), low.tolist(), high.tolist()):
        ends, last = [], 0
        for cut in [*(cuts[a:b] - start).tolist(), n]:
            while cut - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if cut - last >= SHORTEST or cut == n > last:
                ends.append(cut)
                last = cut
        out.append(ends)
    return out


def merkle_root(hashes: list[bytes]) -> bytes:
    """SHA-256 root over hashes in pairs; an odd one moves up as it is; of nothing: of the empty string."""
    if not hashes:
        return hashlib.sha256(b"").digest()
    while len(hashes) > 1:
        up = [hashlib.sha256(a + b).digest() for a, b in zip(hashes[::2], hashes[1::2])]
        hashes = up + hashes[len(up) * 2 :]
    return hashes[0]


def _matrix_square(m: np.ndarray) -> np.ndarray:
    return crc_times(m, m)


def crc_times(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where((crc >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def shift_matrices() -> list[np.ndarray]:
    """Matrix k moves a CRC-32 over 2**k zero bytes."""
    one_bit = np.array([0xEDB88320, *(1 << b for b in range(31))], dtype=np.uint32)
    m = one_bit
    for _ in range(3):
        m = _matrix_square(m)
    found = [m]
    for _ in range(47):
        found.append(m := _matrix_square(m))
    return found


SHIFTS = shift_matrices()


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 values moved over n_bytes bytes that follow; CRCs of parts, so moved, XOR to that of the whole."""
    crc = crc.astype(np.uint32)
    for k, matrix in enumerate(SHIFTS):
        rows = (n_bytes >> k) & 1 == 1
        if rows.any():
            crc[rows] = crc_times(matrix, crc[rows])
    return crc


CHUNK_ROWS = "kind string, route long, doc_id long, n_tokens long, root binary, digests binary, lengths array<int>, data binary"


def write_store(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0) -> str:
    """Encode whole texts, append the end id, write the store into ``folder``; returns the folder.

    A null or empty text is the end id alone. Rows with equal doc_id follow one another, ordered
    by their content's root; rows with a null doc_id come first. An empty table makes a store
    without documents. Columns besides doc_id and text are not read. The one shuffle of ids goes
    by chunk digest; a task sends each chunk it meets once, so a passage that a third of all
    documents share reaches its reducer as often as there are tasks, not documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or tokenizer_path("byte_bpe_50k.json")

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_ids(path)
        kind = "<u2" if encode.size <= 1 << 16 else "<u4"
        seen: set[bytes] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            streams = [np.append(encode(t), np.uint32(end_id)) for t in batch.column(1).to_pylist()]
            for doc_id, ids, ends in zip(batch.column(0).to_pylist(), streams, chunk_ends(*streams)):
                data, digests, last = ids.astype(kind), [], 0
                for end in ends:
                    raw = data[last:end].tobytes()
                    digest = hashlib.sha256(raw).digest()
                    digests.append(digest)
                    last = end
                    if digest not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest)
                        for column, value in zip(out, ("chunk", int.from_bytes(digest[:8], "little", signed=True), None, None, None, digest, None, raw)):
                            column.append(value)
                root = merkle_root(digests)
                for column, value in zip(out, ("recipe", int.from_bytes(root[:8], "little", signed=True) ^ (doc_id or 0), doc_id, len(ids), root, b"".join(digests), np.diff([0, *ends]).astype(np.int32), None)):
                    column.append(value)
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [f.split()[0] for f in CHUNK_ROWS.split(", ")])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for kind, digest in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()):
                keep.append(kind != "chunk" or digest != last)
                last = digest if kind == "chunk" else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(chunked, CHUNK_ROWS).repartition("route").sortWithinPartitions("kind", "digests")
    stage = f"{folder}/stage"
    dealt.mapInArrow(once, CHUNK_ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(stage)

    staged = spark.read.schema(CHUNK_ROWS).parquet(stage).where("kind = 'recipe'")
    recipes = staged.select("doc_id", "n_tokens", "root", "digests", "lengths", F.monotonically_increasing_id().alias("tie"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = start = 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            ends = start + np.cumsum(n)
            columns = [*batch.columns[:5], pa.array(np.arange(pos, pos + len(n))), pa.array(ends - n), batch.column("part")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "root", "digests", "lengths", "pos", "local_start", "part"])
            pos += len(n)
            start = int(ends[-1]) if len(n) else start

    ordered = recipes.repartitionByRange("doc_id", "root", "tie").sortWithinPartitions("doc_id", "root", "tie")
    ordered = ordered.select("doc_id", "n_tokens", "root", "digests", "lengths", F.spark_partition_id().alias("part"))
    ordered.mapInArrow(numbered, "doc_id long, n_tokens long, root binary, digests binary, lengths array<int>, pos long, local_start long, part int").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    _write_manifest(spark, folder)
    return folder


def _write_manifest(spark: SparkSession, folder: str) -> None:
    """One row for each part: the roots of its runs combine in an executor, so the driver gets a row a part."""
    recipes = spark.read.parquet(f"{folder}/recipes")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The root of each run of rows of one part in a batch."""
        for batch in batches:
            parts, pos = batch.column("part").to_pylist(), batch.column("pos").to_pylist()
            own, root = batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist()
            at = 0
            while at < len(parts):
                end = at + 1
                while end < len(parts) and parts[end] == parts[at]:
                    end += 1
                yield pa.RecordBatch.from_pydict({"part": pa.array([parts[at]], pa.int32()), "pos": [pos[at]], "docs": [end - at], "tokens": [sum(own[at:end])], "root": [merkle_root(root[at:end])]})
                at = end

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each part from its runs, which are sorted by (part, pos)."""
        part, docs, tokens, held = None, 0, 0, []
        names = ["part", "docs", "tokens", "root"]

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, docs, tokens, merkle_root(held)), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names)

        for batch in batches:
            for at, _, n, own, root in zip(*(c.to_pylist() for c in batch.columns)):
                if held and at != part:
                    yield whole()
                    docs, tokens, held = 0, 0, []
                part, docs, tokens = at, docs + n, tokens + own
                held.append(root)
        if held:
            yield whole()

    runs = recipes.select("part", "pos", "n_tokens", "root").mapInArrow(roots, "part int, pos long, docs long, tokens long, root binary")
    found = runs.repartition("part").sortWithinPartitions("part", "pos").mapInArrow(combined, "part int, docs long, tokens long, root binary").orderBy("part").collect()
    before, rows = 0, []
    for r in found:
        rows.append((r.part, r.docs, r.tokens, before, bytes(r.root)))
        before += r.tokens
    spark.createDataFrame(rows, "part int, docs long, tokens long, tokens_before long, root binary").coalesce(1).write.parquet(f"{folder}/manifest")


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """Recipes with ``start``, the ids of all documents before; the manifest is a row per part."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("part", "tokens_before")
    recipes = spark.read.parquet(f"{folder}/recipes").join(F.broadcast(manifest), "part")
    return recipes.withColumn("start", F.col("tokens_before") + F.col("local_start"))


def _references(recipes: DataFrame) -> DataFrame:
    """A row for each chunk of each document, after its Merkle root has been verified."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, start, n, part, pos, root, digests, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = [digests[k : k + 32] for k in range(0, len(digests), 32)]
                if merkle_root(hashes) != root or sum(lengths) != n or len(hashes) != len(lengths):
                    raise ValueError(f"recipe of document {doc_id} is damaged")
                done = 0
                for k, (digest, own) in enumerate(zip(hashes, lengths)):
                    done += own
                    for column, value in zip(rows, (doc_id, start, n, part, pos, k, digest, n - done)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()])], ["doc_id", "start", "n_tokens", "part", "pos", "k", "digest", "after"])

    columns = recipes.select("doc_id", "start", "n_tokens", "part", "pos", "root", "digests", "lengths")
    return columns.mapInArrow(opened, "doc_id long, start long, n_tokens long, part int, pos long, k int, digest binary, after long")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CHUNK_ROWS).parquet(f"{folder}/stage").where("kind = 'chunk'").select(F.col("digests").alias("digest"), "data")


def read_documents(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """The ids of every document, rebuilt from the store: doc_id, start, n_tokens, ids (bytes).

    ``width``: bytes of a stored id. A chunk that doesn't match its digest raises an error.
    """
    ref = _references(read_recipes(spark, folder))
    data = _chunks(spark, folder).withColumn("data", F.when(F.sha2("data", 256) == F.lower(F.hex("digest")), F.col("data")).otherwise(F.raise_error(F.lit("damaged chunk")).cast("binary")))
    whole = spread_join(stored(ref, "references"), data, "digest", "left").groupBy("doc_id", "start", "n_tokens", "part", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "data"))).alias("chunks"))
    ids = F.concat(F.array_join(F.transform("chunks", lambda c: F.hex(c["data"])), ""))
    return whole.select("doc_id", "start", "n_tokens", F.unhex(ids).alias("ids"))


def verify_documents(spark: SparkSession, folder: str, width: int = 2) -> DataFrame:
    """Read every file back; per document doc_id, start, n_tokens and ids_crc32 of 32-bit ids.

    Each chunk is read once, held against its digest and reduced to its CRC; the CRCs of a
    document's chunks, moved by the bytes that follow them, combine to that of the whole, so no
    ids are shuffled. A missing or damaged chunk raises an error.
    """
    small_batches(spark)
    kind = {2: "<u2", 4: "<u4"}[width]

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, crcs, sizes = batch.column(0), [], []
            for digest, data in zip(digests.to_pylist(), batch.column(1).to_pylist()):
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                ids = np.frombuffer(data, dtype=kind)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([digests, pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "crc", "size"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = batch.column("crc")
            if crc.null_count:
                raise ValueError("a chunk is missing")
            out = crc_shift(crc.to_numpy(), batch.column("after").to_numpy() * 4)
            yield batch.set_column(batch.schema.get_field_index("crc"), "crc", pa.array(out.astype(np.int64)))

    chunks = _chunks(spark, folder).mapInArrow(reduced, "digest binary, crc long, size long")
    # a passage that a third of all documents share is one digest, dealt to several tasks
    found = spread_join(stored(_references(read_recipes(spark, folder)), "references"), chunks, "digest", "left")
    found = found.select("doc_id", "start", "n_tokens", "part", "pos", "after", "crc", "size").mapInArrow(moved, "doc_id long, start long, n_tokens long, part int, pos long, after long, crc long, size long")
    whole = found.groupBy("part", "pos", "doc_id", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("size"))
    checked = F.when(F.col("size") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document's chunks don't make its length")).cast("long"))
    return whole.select("doc_id", "start", checked.alias("n_tokens"), "ids_crc32")
