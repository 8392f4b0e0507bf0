"""Prefix trie of conversations, built by halving depths.

Every node is a sequence of first turns (role and text). A block of depths ``(start, start + 2^k)`` is cut at its
middle: the prefixes that reach the cut get names, and these are the nodes of that depth. Above the cut
one sequence of each name goes on, with the number of conversations behind it; below it every sequence
goes on under the name of its cut prefix. Both halves of all blocks are worked on together, so a trie of depth D
takes about log2 D rounds, equal prefixes are merged at their first cut, and no conversation has to
fit in a task. Names are digests of the cut above and of the half block of turns, and those of half blocks come from pairs
of smaller ones.

Totals are grafted in the same blocks. First, from small blocks to large ones, a cut takes up what hangs
directly below it in its lower block. Then, from large blocks to small ones, it takes up the whole totals of
the nodes at the lower end of its block: the sequence that stands for such a node above its cut has met,
on its way down, exactly the cuts whose blocks end there. Each node is sent once in the first pass and at most once a
round in the second one.

``forest`` takes any sequences; ``rebuilt`` makes those of the query: a conversation's first turns are
replaced by those of the first conversation of its twenty.

Edge cases: a null role or text is empty text, a null turn comes first, rows with equal turns are ordered by
a digest of role and text (exact repeats are turns of their own), and rows without ``conv_id`` are left
out. A conversation may end up without turns and is then a member of the root only. Long texts are read
whole, an empty table gives no node, not even a root, and other columns aren't read. Sequences are
compared by 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import table, words
from cairn.operators.joins import attach
from cairn.operators.ordering import order_bucket, positions
from cairn.sources.scratch import cut_lineage

#: Conversations of one piece of a list of ends.
PIECE = 4096
ROOT = "name of the root"
#: Conversations of one group share the first turns of its first one; at most so many less one are shared.
GROUP, SHARED = 20, 4


def short(value: Column) -> Column:
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def joined(kind: str, a: Column, b: Column) -> Column:
    return short(F.concat(F.lit(kind).cast("binary"), a, b))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, token, words) of each turn, positions from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    token = short(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)).cast("binary"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", token.alias("token"), F.size(words(text)).alias("words")
    )
    rows = cut_lineage(rows)
    return positions(rows, ["turn", "token"], order_bucket(rows, "turn"), ["conv_id"]).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, pos, token, words) with shared beginnings, and their lengths (conv_id, length)."""
    own = cut_lineage(numbered(turns))
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    sizes = cut_lineage(sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % GROUP, "share": share}))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(bases, "base", "left").withColumn(
        "lent", F.least("share", F.coalesce("base_n", F.lit(0))).cast("int")
    )
    convs = cut_lineage(convs.select("conv_id", "n", "base", "share", "lent"))
    first = own.filter(F.col("pos") < SHARED).withColumnRenamed("conv_id", "base")
    lead = convs.filter("lent > 0").join(first, "base").filter("pos < lent").select("conv_id", "pos", "token", "words")
    tail = own.join(convs, "conv_id").filter("pos >= share")
    tail = tail.select("conv_id", (F.col("pos") - F.col("share") + F.col("lent")).alias("pos"), "token", "words")
    length = (F.col("lent") + F.greatest(F.col("n") - F.col("share"), F.lit(0))).alias("length")
    return lead.union(tail), convs.select("conv_id", length)


def halves(sequences: DataFrame, levels: int) -> list[DataFrame]:
    """For each k below ``levels``, digests (conv_id, at, half) of the whole stretches of 2^k turns."""
    found = [sequences.select("conv_id", F.col("pos").alias("at"), F.col("token").alias("half"))]
    even = F.col("at") % 2 == 0
    for _ in range(levels - 1):
        pairs = found[-1].groupBy("conv_id", F.floor(F.col("at") / 2).alias("at")).agg(
            F.max(F.when(even, F.col("half"))).alias("left"), F.max(F.when(~even, F.col("half"))).alias("right")
        )
        whole = pairs.filter("left IS NOT NULL AND right IS NOT NULL")
        found.append(cut_lineage(whole.select("conv_id", "at", joined("half", F.col("left"), F.col("right")).alias("half"))))
    return found


def name_cuts(sequences: DataFrame, lengths: DataFrame, levels: int) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """Nodes and jumps of each level from 1, and (name, conv_id) of the sequences' ends below the root.

    Nodes are (name, above, depth, conv_id, n_convs); ``above`` names the cut at the start of their block. Jumps are
    (below, name): the node ``below`` stands at the end of the block of the cut ``name``.
    """
    stretch = halves(sequences, levels)
    none = F.lit(None).cast("binary")
    rows = lengths.filter("length > 0").select(
        F.lit(0).cast("bigint").alias("start"),
        short(F.lit(ROOT).cast("binary")).alias("above"),
        "conv_id",
        F.lit(1).cast("bigint").alias("n"),
        F.col("length").alias("last"),
        none.alias("below"),
    )
    nodes, jumps, ends = [], [], None
    for k in range(levels, 0, -1):
        half = 1 << (k - 1)
        cut = F.col("start") + half
        left = stretch[k - 1].filter(F.col("at") % 2 == 0).select("conv_id", (F.col("at") * half).alias("start"), "half")
        reach = rows.filter(F.col("last") >= cut).join(left, ["conv_id", "start"])
        named = cut_lineage(reach.withColumn("name", joined("cut", F.col("above"), F.col("half"))).drop("half"))
        found = named.groupBy("name").agg(
            F.first("above").alias("above"),
            F.first(cut).alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n").alias("n_convs"),
        )
        found = cut_lineage(found)
        nodes.append(found)
        jumps.append(named.filter("below IS NOT NULL").select("below", "name"))
        ended = named.filter((F.col("last") == cut) & F.col("below").isNull()).select("name", "conv_id")
        ends = ended if ends is None else ends.union(ended)
        if k > 1:
            upper = found.select(
                (F.col("depth") - half).alias("start"),
                "above",
                "conv_id",
                F.col("n_convs").alias("n"),
                (F.col("depth") - 1).alias("last"),
                F.col("name").alias("below"),
            )
            lower = named.filter(F.col("last") > cut).select(
                cut.alias("start"), F.col("name").alias("above"), "conv_id", "n", "last", "below"
            )
            rows = cut_lineage(rows.filter(F.col("last") < cut).unionByName(upper).unionByName(lower))
    return nodes[::-1], jumps[::-1], ends


def grafted(own: DataFrame, jumps: list[DataFrame], levels: int) -> DataFrame:
    """``own`` (name, above, level, above_level, leaves, saved, ...) with the last two summed over subtrees."""

    def plus(rows: DataFrame, more: DataFrame) -> DataFrame:
        added = more.groupBy("name").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        both = rows.join(added, "name", "left").withColumns(
            {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaves", "saved")}
        )
        return cut_lineage(both.select(*rows.columns))

    def every(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    level = lambda k: own.filter(F.col("level") == k)
    hung = [level(1)]
    for k in range(2, levels + 2):
        below = every(hung).filter(F.col("above_level") == k)
        hung.append(plus(level(k), below.select(F.col("above").alias("name"), "leaves", "saved")))
    whole = hung[levels - 1 :]
    for k in range(levels - 1, 0, -1):
        ends = every(whole).select(F.col("name").alias("below"), "leaves", "saved")
        whole.append(plus(hung[k - 1], jumps[k - 1].join(ends, "below").drop("below")))
    return every(whole)


def end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) over the ascending decimal ids of each name, comma-joined.

    Ids become text in pieces; a digest runs over a name's pieces in order, one piece in memory.
    """
    piece = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")))
    pieces = ends.groupBy("name", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(piece.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            names, found = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        names.append(now)
                        found.append(digest.hexdigest())
                    now, digest = name, hashlib.sha256()
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(found, pa.string())], names=["name", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["name", "ends_sha256"])

    ordered = pieces.repartition("name").sortWithinPartitions("name", "piece").select("name", "ids")
    return ordered.mapInArrow(run, "name binary, ends_sha256 string")


def forest(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each node of the trie over (conv_id, pos, token, words) with (conv_id, length).

    (conv_id, depth) tells a node: the smallest member and the number of turns.
    """
    sequences, lengths = cut_lineage(sequences), cut_lineage(lengths)
    deepest = lengths.agg(F.max("length")).first()[0] or 0
    levels = deepest.bit_length()
    root = short(F.lit(ROOT).cast("binary"))
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select(root.alias("name"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs")
    nodes, jumps, ends = [top], [], lengths.filter("length = 0").select(root.alias("name"), "conv_id")
    if levels:
        named, jumps, ended = name_cuts(sequences, lengths, levels)
        nodes, ends = [*named, top], ended.union(ends)
    every = nodes[0].withColumn("level", F.lit(1))
    for k, more in enumerate(nodes[1:], 2):
        every = every.unionByName(more.withColumn("level", F.lit(k)))
    parents = every.limit(0).select(F.col("name").alias("child"), "name")
    if levels:
        # A cut of a block of two stands on the cut above; every other node's sequence met its parent last.
        parents = nodes[0].select(F.col("name").alias("child"), F.col("above").alias("name"))
        parents = parents.union(jumps[0].select(F.col("below").alias("child"), "name"))
    children = parents.groupBy("name").agg(F.count("*").alias("n_children"))
    last = sequences.select("conv_id", (F.col("pos") + 1).alias("depth"), "words")
    # The depth of the cut above is this depth without its lowest bit, whose place is the level.
    start = F.col("depth") - F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level") - 1)
    ruler = F.when(start > 0, F.length(F.bin(start.bitwiseAND(-start)))).otherwise(F.lit(levels + 1))
    own = (
        every.join(children, "name", "left")
        .join(last, ["conv_id", "depth"], "left")
        .withColumns(
            {
                "above_level": F.when(F.col("depth") > 0, ruler),
                "n_children": F.coalesce("n_children", F.lit(0)),
                "leaves": F.col("n_children").isNull().cast("bigint"),
                "saved": (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0)),
            }
        )
        .drop("words")
    )
    own = cut_lineage(own)
    totals = grafted(own, jumps, levels)
    stats = own.select("name", F.col("conv_id").alias("parent_conv_id"), "n_children")
    above = attach(parents, stats, ["name"], "n_children", ["parent_conv_id"])
    above = above.select(F.col("child").alias("name"), "parent_conv_id")
    return (
        totals.join(above, "name", "left")
        .join(end_digests(ends), "name", "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.col("n_children").cast("bigint").alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            F.col("saved").cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return forest(*rebuilt(table(spark, sf_dir, "conversations")))


OP12_SQL = r"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
           4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
c AS (
  SELECT h.conv_id, base, h, count(o.i) AS b
  FROM h LEFT JOIN o ON o.conv_id = h.base AND o.i <= h.h GROUP BY h.conv_id, base, h),
r AS (
  SELECT c.conv_id, i AS p, role, text FROM c JOIN o ON o.conv_id = c.base AND i <= h
  UNION ALL
  SELECT c.conv_id, i - h + b, role, text FROM c JOIN o ON o.conv_id = c.conv_id AND i > h),
s AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY p) AS seq FROM r GROUP BY conv_id),
p AS (
  SELECT c.conv_id, unnest(range(0, coalesce(len(seq), 0) + 1)) AS d, coalesce(seq, []) AS seq
  FROM c LEFT JOIN s ON c.conv_id = s.conv_id),
q AS (SELECT conv_id, d, array_to_string(seq[1:d], '/') AS pre, d = len(seq) AS ends FROM p),
n AS (
  SELECT d, pre, min(conv_id) AS id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM q GROUP BY d, pre),
w AS (
  SELECT n.id, n.d, n.n_convs, n.ends_sha256,
         (n.n_convs - 1) * coalesce(len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')), 0) AS saved
  FROM n LEFT JOIN r ON r.conv_id = n.id AND r.p = n.d),
t AS (SELECT q.conv_id, n.id, n.d FROM q JOIN n ON q.d = n.d AND q.pre = n.pre),
e AS (SELECT DISTINCT a.id, a.d, b.id AS child FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.d = a.d + 1),
k AS (SELECT id, d, count(*) AS n_children FROM e GROUP BY id, d),
x AS (SELECT DISTINCT a.id, a.d, b.id AS id2, b.d AS d2 FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.d >= a.d),
g AS (
  SELECT x.id, x.d, sum(CASE WHEN k.id IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(w.saved) AS saved
  FROM x JOIN w ON w.id = x.id2 AND w.d = x.d2 LEFT JOIN k ON k.id = x.id2 AND k.d = x.d2 GROUP BY x.id, x.d)
SELECT w.id AS conv_id, w.d AS depth, e.id AS parent_conv_id, w.n_convs, coalesce(k.n_children, 0) AS n_children,
       CAST(g.n_leaves AS BIGINT) AS n_leaves, CAST(g.saved AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN g ON g.id = w.id AND g.d = w.d LEFT JOIN k ON k.id = w.id AND k.d = w.d
LEFT JOIN e ON e.child = w.id AND e.d = w.d - 1
"""
