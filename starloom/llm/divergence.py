"""Audit of how the vocabularies of sources differ within a language.

Tasks count terms by language and source; the counts are dealt to shards by language and term, and within
a shard, in runs of whole terms, DuckDB sums them, keeps the terms of enough documents, and makes the
partial sums of pairs and the partial rankings. Spark merges those.

Counts are sparse, so a pair (g, h) is not summed over all kept terms. With z the value p of a term that a
group lacks,

    sum f(p, q) = sum over terms of both [f(p, q) - f(p, z_h) - f(z_g, q) + f(z_g, z_h)]
                + sum over terms of g f(p, z_h) + sum over terms of h f(z_g, q)
                + (kept - terms of g - terms of h) * f(z_g, z_h)

and the two middle sums need only how many terms a group has with each count. Whole numbers throughout, so
the order of the sums does not matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import Scratch, small_batches, spread_join, text_bytes

#: Distinct terms that a task counts before it sends them on, and rows of one run of a shard.
HELD_TERMS, SHARD_ROWS = 300_000, 500_000
#: Groups that are broadcast at most, as (lang, source) and four numbers; beyond it they are joined with hot ones dealt.
MOST_GROUPS = 50_000
#: Memory of a task's DuckDB, which may not spill to a disk.
ENGINE = {"threads": 1, "memory_limit": "700MB", "temp_directory": ""}
SCALE = 1_000_000_000

#: ASCII letters lower-cased, other ASCII as blanks, bytes of other characters as they are.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(LETTERS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, source, n (occurrences), docs (documents with it), summed over some rows of the task."""
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            some, terms = docs[lang, source], list(own)
            for k in range(0, len(terms), 16_384):
                part = terms[k : k + 16_384]
                columns = [
                    pa.array([lang] * len(part), pa.string()),
                    pa.array([t.decode("utf-8", "replace") for t in part], pa.string()),
                    pa.array([source] * len(part), pa.string()),
                    pa.array([own[t] for t in part], pa.int64()),
                    pa.array([some[t] for t in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "n", "docs"])
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            terms = terms_of(text)
            if not terms:
                continue
            own, some = counts.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            before = len(own)
            own.update(terms)
            some.update(set(terms))
            held += len(own) - before
            if held >= HELD_TERMS:
                yield from out()
                held = 0
    yield from out()


def _runs(batches: Iterator[pa.RecordBatch], folded, most: int) -> Iterator[pa.Table]:
    """Tables of whole terms from rows sorted by lang and term; a term with more rows than a run is ``folded``."""
    held: list[pa.Table] = []
    rows, limit = 0, most
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
        if rows < limit:
            continue
        whole = pa.concat_tables(held)
        last = pc.and_(pc.equal(whole["lang"], whole["lang"][-1]), pc.equal(whole["term"], whole["term"][-1]))
        rows = pc.sum(last).as_py()
        cut = whole.num_rows - rows
        if cut:
            yield whole.slice(0, cut)
            held, limit = [whole.slice(cut)], max(most, 2 * rows)
        else:
            held = [folded(whole)]
            rows = held[0].num_rows
            limit = max(most, 2 * rows)
    if held:
        yield pa.concat_tables(held)


def _batches(engine, sql: str, shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in engine.sql(sql).to_arrow_reader(65_536):
        yield from pa.Table.from_batches([batch]).cast(shape).to_batches()


COUNTS = """
WITH g AS (SELECT lang, term, source, sum(n) AS n, sum(docs) AS docs FROM part GROUP BY ALL),
k AS (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS found, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS leads FROM g)
SELECT lang, term, source, CAST(n AS BIGINT) AS n, leads FROM k WHERE found >= {least}
"""
FOLDED = "SELECT lang, term, source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM part GROUP BY ALL"
SHARES = f"""
CREATE OR REPLACE TEMP TABLE shares AS
SELECT lang, term, source, n,
  CAST(1 + ({SCALE}::HUGEINT * (n + 2)) // (n_all + 2 * kept) AS BIGINT) AS p,
  CAST(1 + ({SCALE}::HUGEINT * 2) // (n_all + 2 * kept) AS BIGINT) AS z,
  CAST(1 + ({SCALE}::HUGEINT * (sum(n) OVER (PARTITION BY lang, term) + 2)) // (lang_n + 2 * kept) AS BIGINT) AS q
FROM part
"""
PARTIALS = """
SELECT 'pair' AS kind, a.lang, a.source, b.source AS item, 0::BIGINT AS n,
  CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p) - (a.p - b.z) * (a.p - b.z) // (a.p + b.z)
    - (a.z - b.p) * (a.z - b.p) // (a.z + b.p) + (a.z - b.z) * (a.z - b.z) // (a.z + b.z)) AS BIGINT) AS value
FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL
UNION ALL
SELECT 'count', lang, source, '', n, count(*) FROM shares GROUP BY ALL
UNION ALL
SELECT * FROM (
  SELECT 'term' AS kind, lang, source, term AS item, 0::BIGINT AS n, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE p > q
  QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top})
"""


def _engine():
    return duckdb.connect(":memory:", config=ENGINE)


def _kept_counts(least: int, most: int):
    shape = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("leads", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine()

        def folded(rows: pa.Table) -> pa.Table:
            engine.register("part", rows)
            return pa.Table.from_batches(_batches(engine, FOLDED, rows.schema), rows.schema)

        for rows in _runs(batches, folded, most):
            engine.register("part", rows)
            yield from _batches(engine, COUNTS.format(least=least), shape)

    return run


def _partials(top: int, most: int):
    shape = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("n", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engine()
        for rows in _runs(batches, lambda rows: rows, most):  # a term has one row for each source here
            engine.register("part", rows)
            engine.execute(SHARES)
            yield from _batches(engine, PARTIALS.format(top=top), shape)

    return run


def _share(n: str, n_all: str, kept: str) -> str:
    """1 + floor(SCALE * (n + 2) / (n_all + 2 * kept)) of longs, as SQL."""
    return f"1 + (cast({n} + 2 as decimal(20, 0)) * {SCALE} div cast({n_all} + 2 * {kept} as decimal(20, 0)))"


def _differ(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) of longs, as SQL."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def _with_totals(counts: DataFrame, groups: DataFrame, most_groups: int) -> DataFrame:
    if groups.count() <= most_groups:
        return counts.join(F.broadcast(groups), ["lang", "source"])
    key = F.struct("lang", "source")
    return spread_join(counts.withColumn("key", key), groups.withColumn("key", key).drop("lang", "source"), "key").drop("key")


def divergence(docs: DataFrame, least: int = 10, top: int = 10, most_groups: int = MOST_GROUPS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language differ, and by which terms.

    A term is a run of letters A-Z and of characters beyond ASCII, only A-Z lower-cased; a language keeps the terms in at
    least ``least`` of its documents (V of them). A group (lang, source) or a whole language with N occurrences of kept terms
    gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)); two values differ by f = floor((p - q)^2 / (p + q)).

    part ``pair``: for each other source of the language, f summed over all kept terms (0 where V = 0); all ranks.
    part ``term``: for each kept term that the group has and for which its p is above that of the language, f of
    the two; the first ``top``. Ranks go by falling value, then by the item in UTF-8 order.

    Null text, lang and source are read as ''. Every group that occurs takes part, also one without terms; a language of
    one source has no pairs, an empty table no rows. Rows with equal or null doc_id are documents each; other
    columns are not read. The output holds all pairs of a language's sources, so it grows with their square.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "divergence")
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counted = docs.select(*group, text_bytes().alias("text")).mapInArrow(_counted, "lang string, term string, source string, n long, docs long")
    shards = counted.repartition("lang", "term").sortWithinPartitions("lang", "term")
    kept = scratch.stored(shards.mapInArrow(_kept_counts(least, shard_rows), "lang string, term string, source string, n long, leads boolean"), "kept")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("*").alias("terms"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum(F.col("leads").cast("long")).alias("kept"))
    groups = docs.select(*group).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = scratch.stored(groups.fillna(0, ["n_all", "terms", "lang_n", "kept"]), "groups")

    wide = _with_totals(kept.drop("leads"), groups.drop("terms"), most_groups).repartition("lang", "term").sortWithinPartitions("lang", "term")
    found = wide.select("lang", "term", "source", "n", "n_all", "kept", "lang_n").mapInArrow(_partials(top, shard_rows), "kind string, lang string, source string, item string, n long, value long")
    found = scratch.stored(found, "partials")

    per_count = found.where("kind = 'count'").groupBy("lang", "source", "n").agg(F.sum("value").alias("times"))
    per_count = scratch.stored(_with_totals(per_count, groups.select("lang", "source", "n_all", "kept"), most_groups).withColumn("p", F.expr(_share("n", "n_all", "kept"))), "counts")
    absent = F.when(F.col("kept") > 0, F.expr(_share("0", "n_all", "greatest(kept, 1)")))
    other = groups.select("lang", F.col("source").alias("item"), absent.alias("z"), F.col("terms").alias("other_terms"))
    own = spread_join(per_count.select("lang", "source", "p", "times"), other.drop("other_terms"), "lang").where("source <> item")
    own = own.groupBy("lang", "source", "item").agg(F.expr(f"sum(times * {_differ('p', 'z')})").alias("value"))
    lacked = spread_join(groups.select("lang", "source", "terms", "kept", absent.alias("own_z")), other, "lang").where("source <> item")
    lacked = lacked.select("lang", "source", "item", F.expr(f"coalesce((kept - terms - other_terms) * {_differ('own_z', 'z')}, 0)").alias("value"))
    both = found.where("kind = 'pair'").select("lang", "source", "item", "value")

    def mirrored(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))

    pairs = lacked.unionByName(mirrored(own)).unionByName(mirrored(both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(first).cast("int")
    terms = found.where("kind = 'term'").select("lang", "source", "item", "value").withColumn("rank", rank).where(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 10
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS kept FROM k GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = s.lang AND c.source = s.source), 0) AS n_all FROM (SELECT DISTINCT lang, source FROM d) s
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + CAST(1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT) // (g.n_all + 2 * v.kept) AS BIGINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT t.lang, t.term, 1 + CAST(1000000000 * CAST(t.n + 2 AS HUGEINT) // (l.n_all + 2 * v.kept) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) t JOIN (SELECT lang, sum(n) AS n_all FROM c GROUP BY ALL) l USING (lang) JOIN v USING (lang)
), s AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
