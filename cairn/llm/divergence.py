"""Source divergence audit: how far the term shares of the sources of a language lie apart.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. Each language keeps
the terms of at least ``LEAST_DOCS`` of its documents. A (language, source) group gives a kept term the share
``p = 1 + floor(SCALE * (count + 1) / (N + V))``, N being the group's count of all kept terms and V their number;
a language gives shares alike. The divergence of shares p from q is the sum of ``floor((p - q)^2 / q)``.

Count-level bitmaps: kept terms get a place in blocks of 64 places, close to terms that are about as common.
For each group, block and count one word holds the bits of the terms with that count. The AND of two words
and its popcount give the number of terms with a count here and another there (a joint cell), which is
multiplied by the cell's divergence. Terms that a group lacks have no bits: with f as a cell's divergence,
n as a cell's terms and 0 as the count of absent terms, the sum over all terms is

    sum n(c, d) (f(c, d) - f(c, 0) - f(0, d) + f(0, 0)) + sum n(c) (f(c, 0) - f(0, 0))
        + sum n(d) (f(0, d) - f(0, 0)) + V f(0, 0)

so blocks in which a group has no term, and cells with a zero, follow from the sizes of the levels by
complement. Everything is integer arithmetic.

A task counts terms in two dictionaries of bounded size and passes on what it has when they are full. Sums follow by
(language, source, term) and then by (language, term). A block has at most 64 words of a source and is
worked on one source at a time. Level sizes meet the other sources over salted keys.

Edge cases: null text, language and source read as empty text. A group without terms and a language
without kept terms (V = 0, all divergences 0) count; a language with one source has no pairs. Texts are
read whole, repeated rows count repeatedly, ties rank by the UTF-8 order of the item, an empty table gives
an empty result, and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Different terms in a task's dictionaries before they are passed on.
HELD = 300_000
#: Terms of one numbering window on average, before they are parted by language and band.
SLICE = 1 << 14
SALTS = 16
LEVEL = "lang string, source string, block bigint, count bigint, p bigint, p0 bigint, bits bigint"


def _letters() -> bytes:
    """Byte table: A-Z become a-z, bytes of terms stay, all others become spaces."""
    one = lambda b: b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20
    return bytes(map(one, range(256)))


LETTERS = _letters()


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row with a null term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in counts.items():
                keys = [None, *n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(keys), pa.binary()).cast(pa.string()),
                        pa.array([source] * len(keys), pa.binary()).cast(pa.string()),
                        pa.array(keys, pa.binary()).cast(pa.string()),
                        pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *map(seen.__getitem__, n)], pa.int64()),
                    ],
                    names=["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            lang, source, text = (batch.column(k).cast(pa.binary()) for k in range(3))
            for at in range(batch.num_rows):
                key = lang[at].as_py(), source[at].as_py()
                if key not in counts:
                    counts[key] = Counter(), Counter()
                found = terms(text[at].as_py())
                n, seen = counts[key]
                n.update(found)
                seen.update(set(found))
            if sum(len(n) for n, _ in counts.values()) > HELD:
                yield from out()
                counts.clear()
        yield from out()

    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    made = read.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact for any counts; null without kept terms."""
    wide = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", wide, (total + kept).cast("decimal(20,0)")) + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(counts: DataFrame) -> DataFrame:
    """(lang, term, n, block, bit) of the terms kept, with the language's count and the place of each.

    Places are numbered inside windows of at most about ``SLICE`` terms that have counts of the same power of two.
    """
    kept = (
        counts.filter(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= LEAST_DOCS)
        .select("lang", "term", "n", F.length(F.bin("n")).alias("band"))
    )
    kept = cut_lineage(kept)
    slices = max(1, -(-kept.count() // SLICE))
    sliced = kept.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)))
    place = F.row_number().over(W.partitionBy("lang", "band", "slice").orderBy("n", "term")) - 1
    block = F.xxhash64("band", "slice", F.floor(F.col("place") / 64))
    return sliced.withColumn("place", place).select(
        "lang", "term", "n", block.alias("block"), (F.col("place") % 64).cast("int").alias("bit")
    )


def block_sums(levels: DataFrame) -> DataFrame:
    """(lang, source, item, value) from the joint cells of every block; a pair may have several rows."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def pairs(sources: list[str], starts: np.ndarray, p: np.ndarray, p0: np.ndarray, bits: np.ndarray):
        """Sums of one block; rows are ordered by source, ``starts`` are the first rows of the sources."""
        ends = np.r_[starts[1:], len(p)]
        for k, (a, b) in enumerate(zip(starts, ends)):
            n = np.bitwise_count(bits[a:b, None] & bits[None, :]).astype(np.int64)
            here, there, zero = p[a:b, None], p[None, :], p0[a]
            cell = f(here, there) - f(here, p0[None, :]) - f(zero, there) + f(zero, p0)[None, :]
            sums = np.add.reduceat((n * cell).sum(0), starts)
            for other in range(len(sources)):
                if other != k:
                    yield sources[k], sources[other], int(sums[other])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole blocks one by one; the rows come ordered by language, block and source."""
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            block, lang = rows["block"].to_numpy(), rows["lang"].combine_chunks().dictionary_encode()
            code = (lang.chunk(0) if isinstance(lang, pa.ChunkedArray) else lang).indices.to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (code[1:] != code[:-1])) + 1
            for a, b in zip(np.r_[0, cuts[:-1]], cuts):
                yield rows.slice(a, b - a)
            rest = rows.slice(cuts[-1] if len(cuts) else 0)
        if rest is not None and rest.num_rows:
            yield rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}

        def out() -> pa.RecordBatch:
            keys = list(sums)
            columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(list(sums.values()), pa.int64())], names=["lang", "source", "item", "value"]
            )

        for block in blocks(batches):
            lang, source = block["lang"][0].as_py(), block["source"].to_pylist()
            starts = np.array([k for k in range(len(source)) if k == 0 or source[k] != source[k - 1]])
            p, p0, bits = (block[c].to_numpy() for c in ("p", "p0", "bits"))
            for a, b, value in pairs([source[k] for k in starts], starts, p, p0, bits.view(np.uint64)):
                sums[lang, a, b] = sums.get((lang, a, b), 0) + value
            if len(sums) > HELD:
                yield out()
                sums.clear()
        yield out()

    ordered = levels.repartition("lang", "block").sortWithinPartitions("lang", "block", "source")
    return ordered.mapInArrow(run, "lang string, source string, item string, value bigint")


def ranked(rows: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """Ranks of (lang, source, item, value) within each group; with ``top``, of slices of a group first."""
    best = [F.desc("value"), F.asc("item")]
    if top:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(64)))
        first = F.row_number().over(W.partitionBy("lang", "source", "salt").orderBy(*best))
        rows = rows.withColumn("first", first).filter(F.col("first") <= top)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*best)))
    if top:
        rows = rows.filter(F.col("rank") <= top)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def pair_values(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """(lang, source, item, value): divergence of each group from every other source of its language."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    others = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"), "kept")
    sizes = levels.groupBy("lang", "source", "count", "p", "p0").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n"))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("source", "count"), F.lit(SALTS)).cast("int"))
    met = salted.join(others.withColumn("salt", salts), ["lang", "salt"]).filter("source <> other")
    p, p0, q0, n = (F.col(c) for c in ("p", "p0", "q0", "n"))
    lone = lambda a, b: n * (a - b)
    # Both directions of a pair come from one row of the join, as sums by (lang, source, other).
    sides = met.groupBy("lang", "source", "other").agg(
        F.sum(lone(divergence(p, q0), divergence(p0, q0))).alias("gives"),
        F.sum(lone(divergence(q0, p), divergence(q0, p0))).alias("takes"),
    )
    gives = sides.select("lang", "source", F.col("other").alias("item"), F.col("gives").alias("value"))
    takes = sides.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), F.col("takes").alias("value"))
    mine = groups.select("lang", "source", "p0").withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    base = mine.join(others.withColumn("salt", salts), ["lang", "salt"]).filter("source <> other").select(
        "lang",
        "source",
        F.col("other").alias("item"),
        F.coalesce(F.col("kept") * divergence(p0, q0), F.lit(0)).cast("bigint").alias("value"),
    )
    parts = base.union(block_sums(levels)).union(gives).union(takes)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and the terms that stand out in a group."""
    counts = cut_lineage(term_counts(docs))
    kept = cut_lineage(kept_terms(counts))
    used = counts.join(kept.select("lang", "term", F.col("n").alias("whole"), "block", "bit"), ["lang", "term"])
    used = cut_lineage(used.select("lang", "source", "term", F.col("n").alias("count"), "whole", "block", "bit"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total"))
    sums = used.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = (
        counts.filter("term IS NULL")
        .select("lang", "source")
        .join(langs, "lang", "left")
        .join(sums, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), "total", F.coalesce("n", F.lit(0)).alias("n"))
        .withColumn("p0", share(F.lit(0), F.col("n"), F.col("kept")))
    )
    groups = cut_lineage(groups)
    # Sums and totals are per group: Spark broadcasts them if they are small, else a hot group's rows are split.
    shares = used.join(groups, ["lang", "source"]).withColumns(
        {
            "p": share(F.col("count"), F.col("n"), F.col("kept")),
            "q": share(F.col("whole"), F.col("total"), F.col("kept")),
        }
    )
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit")))
    levels = shares.groupBy("lang", "source", "block", "count", "p", "p0").agg(word.alias("bits"))
    levels = cut_lineage(levels)
    standing = shares.filter("p > q").select(
        "lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")
    )
    return ranked(pair_values(groups, levels), "pair").unionByName(ranked(standing, "term", TOP))


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
t AS (
  SELECT i, lang, source, unnest(list_transform(
           regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS whole FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
l AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (coalesce(s.n, 0) + l.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.whole + 1) // (l.total + l.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang
  LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
