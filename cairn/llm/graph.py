"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.scratch import cut_lineage, discard, passing


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node reached.

    Each round hangs every larger neighbour on the smallest one, then every smaller neighbour; the
    number of rounds grows with the logarithm of the longest path. Only links move, minima are
    combined before the shuffle, and each round is written to the shared folder, where it replaces the last.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    pairs = cut_lineage(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(pairs)
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        with passing() as kept:
            # Written, so that the join shuffles both sides afresh and a node with very many links can be split.
            least = cut_lineage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
            large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = cut_lineage(large.filter("u <> v").distinct())
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(
                F.explode(
                    F.array(
                        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                        F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    )
                ).alias("x")
            )
            later = kept(small.select("x.u", "x.v").filter("u <> v").distinct())
        discard(pairs)
        pairs = later
        now = _mark(pairs)
        if now == mark:
            break
        mark = now
    root = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(pairs: DataFrame) -> tuple:
    row = pairs.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]
