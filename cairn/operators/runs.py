"""Masks as runs: one row ``(*keys, y, x0, x1)`` for the covered pixels x0..x1 of an image row.

Masks stay runs through union, intersection and area; only :func:`pixels` makes a row of each pixel. The runs
of one image row are merged by their order. Runs of two masks meet on shared tiles of a row, cut at the
tiles' edges, so a row's runs are never all compared with each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

TILE = 64  # pixels


def merged(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal disjoint runs: overlapping and adjoining ones become one. A union of masks is the merge of their rows."""
    line = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    reach = F.max("x1").over(line.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce(F.col("x0") > reach + 1, F.lit(True)).cast("int")
    islands = runs.withColumn("_new", begins).withColumn("_island", F.sum("_new").over(line))
    return islands.groupBy(*keys, "y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_island")


def tiled(runs: DataFrame, tile: int = TILE, name: str = "tile") -> DataFrame:
    """Runs cut at the edges of tiles, with the number of their tile."""
    tiles = F.sequence(F.floor(F.col("x0") / tile), F.floor(F.col("x1") / tile))
    cut = runs.withColumn(name, F.explode(tiles))
    return cut.withColumns(
        {
            "x0": F.greatest("x0", (F.col(name) * tile).cast("int")),
            "x1": F.least("x1", (F.col(name) * tile + tile - 1).cast("int")),
        }
    )


def intersected(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that two masks of disjoint runs share, cut at the edges of tiles.

    Spark's size estimate doesn't know how many runs a polygon's ``explode`` makes: the join asks for a merge,
    so that neither mask is collected and broadcast.
    """
    other = tiled(b).withColumnsRenamed({"x0": "_x0", "x1": "_x1"})
    met = tiled(a).join(other.hint("merge"), [*keys, "y", "tile"])
    both = met.withColumns({"x0": F.greatest("x0", "_x0"), "x1": F.least("x1", "_x1")})
    return both.filter("x0 <= x1").select(*keys, "y", "x0", "x1")


def area(runs: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Pixels of disjoint runs for each value of ``by``."""
    return runs.groupBy(*by).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("bigint").alias(name))


def overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Pixels shared, covered by either, and their quotient (null without any) for each value of ``by``."""
    parts = [(a, 1, 0), (b, 1, 0), (intersected(a, b, keys), -1, 1)]
    rows = [
        r.select(*by, *[((F.col("x1") - F.col("x0") + 1) * w).alias(n) for n, w in (("either", e), ("both", s))])
        for r, e, s in parts
    ]
    return (
        rows[0].union(rows[1]).union(rows[2]).groupBy(*by)
        .agg(F.sum("both").cast("bigint").alias("both"), F.sum("either").cast("bigint").alias("either"))
        .withColumn("jaccard", F.try_divide("both", "either"))
    )


def pixels(runs: DataFrame) -> DataFrame:
    """One row ``(..., y, x)`` for each pixel of disjoint runs."""
    return runs.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")
