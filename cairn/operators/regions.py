"""Connected regions of sparse masks, with holes, on two levels.

All work is on runs of neighbouring pixels. Foreground runs connect through corners (8-neighbours), the
gaps between runs through sides only (4-neighbours); a gap component that never reaches the outside of
the mask is a hole. Tiles of bounded size are labelled inside one task each; label propagation in
rounds joins the components that meet at tile edges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from cairn.operators.joins import HOT_ROWS, attach
from cairn.operators.runs import merged, tiled
from cairn.sources.scratch import cut_lineage

STRIP, WIDTH = 64, 4096  # rows and pixels of a tile


def runs(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Maximal horizontal runs ``(*keys, y, x0, x1)`` of a mask of pixels."""
    return merged(mask.select(*keys, "y", F.col("x").alias("x0"), F.col("x").alias("x1")), keys)


def gaps(run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Background between two neighbouring runs of the same row."""
    line = W.partitionBy(*keys, "y").orderBy("x0")
    return (
        run.withColumn("_next", F.lead("x0").over(line))
        .filter(F.col("_next").isNotNull())
        .select(*keys, "y", (F.col("x1") + 1).alias("x0"), (F.col("_next") - 1).alias("x1"))
    )


def with_id(run: DataFrame, keys: Sequence[str], kind: str = "r") -> DataFrame:
    """Every run named by its kind, key, row and start."""
    return run.withColumn("id", F.concat_ws("|", F.lit(kind), *[F.col(c).cast("string") for c in (*keys, "y", "x0")]))


def linked(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, corner: int) -> np.ndarray:
    """For each run of a tile, ordered by row and start, the first run of its component."""
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    starts = np.flatnonzero(np.r_[True, y[1:] != y[:-1]]) if len(y) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(y)]
    for k in range(1, len(starts)):
        if y[starts[k]] != y[starts[k - 1]] + 1:
            continue
        i, j = starts[k - 1], starts[k]
        while i < ends[k - 1] and j < ends[k]:
            if x0[j] <= x1[i] + corner and x1[j] >= x0[i] - corner:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if x1[i] < x1[j]:
                i += 1
            else:
                j += 1
    return np.array([find(i) for i in range(len(y))], int)


def tile_roots(pieces: DataFrame, keys: Sequence[str], corner: int) -> DataFrame:
    """Pieces with ``local``: the least id of their component within one tile, found inside one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x0", "ascending")])
        first = linked(*(table[c].to_numpy() for c in ("y", "x0", "x1")), corner)
        least: dict[int, str] = {}
        ids = table["id"].to_pylist()
        for at, name in zip(first.tolist(), ids):
            least[at] = min(least.get(at, name), name)
        return table.append_column("local", pa.array([least[at] for at in first.tolist()], pa.string()))

    schema = T.StructType([*pieces.schema.fields, T.StructField("local", T.StringType())])
    return pieces.groupBy(*keys, "strip", "tile").applyInArrow(run, schema)


def border_links(pieces: DataFrame, keys: Sequence[str], corner: int, strip: int, width: int) -> DataFrame:
    """Pairs ``(a, b)`` of tiles' components that are one across a tile's edge."""
    side = lambda p, n: p.select(*keys, "y", "x0", "x1", "tile", F.col("local").alias(n))
    above = side(pieces.filter(F.col("y") % strip == strip - 1), "a").withColumn("y", F.col("y") + 1)
    below = side(pieces.filter(F.col("y") % strip == 0), "b").withColumnsRenamed({"x0": "_x0", "x1": "_x1"})
    over = above.join(below, [*keys, "y", "tile"]).filter(
        (F.col("_x0") <= F.col("x1") + corner) & (F.col("_x1") >= F.col("x0") - corner)
    )
    # A run that was cut is one node; its parts carry its id.
    links = over.select("a", "b").union(pieces.filter("cut").select(F.col("id").alias("a"), F.col("local").alias("b")))
    if corner:
        left = side(pieces.filter((F.col("x1") + 1) % width == 0), "a").withColumn("x0", F.col("x1") + 1).drop("x1", "tile")
        right = side(pieces.filter(F.col("x0") % width == 0), "b").drop("x1", "tile")
        for step in (-1, 1):
            links = links.union(left.withColumn("y", F.col("y") + step).join(right, [*keys, "y", "x0"]).select("a", "b"))
    return links.filter("a <> b").distinct()


def pieces_of(run: DataFrame, strip: int, width: int) -> DataFrame:
    """Runs cut at the edges of tiles, with their tile and whether they were cut."""
    whole = run.withColumn("cut", F.floor(F.col("x0") / width) < F.floor(F.col("x1") / width))
    return tiled(whole, width).withColumn("strip", F.floor(F.col("y") / strip))


def components(pairs: DataFrame, floor: int = HOT_ROWS) -> DataFrame:
    """Smallest reachable id for every id that occurs in ``pairs``: rows ``(id, root)``.

    Alternates two steps until nothing changes: every node sends its larger neighbours to the smallest
    node it knows, then its smaller ones. The number of rounds grows with the logarithm of the largest
    component. Nodes with very many neighbours are salted by the join, and each round is checkpointed
    to the shared folder, so a lost executor costs one round at most.
    """
    edges = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while (mark := _mark(edges)) != seen:
        seen = mark
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"), floor)
        edges = cut_lineage(_star(large, F.lit(True), floor))
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Size and order-free checksum of an edge set; equal marks mean that a round changed nothing."""
    hashes = [F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))]
    return tuple(edges.agg(F.count("*"), *hashes).first())


def _star(edges: DataFrame, moved, floor: int) -> DataFrame:
    """Point neighbours of each node ``u`` (those that ``moved`` selects) at its smallest neighbour or itself."""
    best = edges.groupBy("u").agg(F.count("*").alias("_n"), F.least(F.min("v"), F.first("u")).alias("m"))
    sent = attach(edges, best, ["u"], "_n", ["m"], floor).filter(moved).select(F.col("v").alias("p"), "m")
    own = best.select(F.col("u").alias("p"), "m")
    out = sent.unionByName(own).filter(F.col("p") != F.col("m"))
    return out.select(F.greatest("p", "m").alias("u"), F.least("p", "m").alias("v")).distinct()


def label(run: DataFrame, gap: DataFrame, keys: Sequence[str], strip: int = STRIP, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Pieces of runs and of gaps with the id of their component in ``root``.

    Whole tiles are labelled in one task each; rounds run over the components at tile edges only, of both
    kinds together.
    """
    sides = []
    for side, kind, corner in ((run, "r", 1), (gap, "g", 0)):
        pieces = pieces_of(with_id(side, keys, kind), strip, width)
        sides.append((cut_lineage(tile_roots(pieces, keys, corner)), corner))
    links = [border_links(side, keys, corner, strip, width) for side, corner in sides]
    links = cut_lineage(links[0].union(links[1]))
    if links.isEmpty():
        return tuple(side.withColumn("root", F.col("local")) for side, _ in sides)
    roots = cut_lineage(components(links)).withColumnRenamed("id", "local")
    return tuple(side.join(roots, "local", "left").withColumn("root", F.coalesce("root", "local")) for side, _ in sides)


def _summary(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys, "root").agg(
        F.sum(F.col("x1") - F.col("x0") + 1).alias("area"),
        F.min("x0").alias("min_x"),
        F.max("x1").alias("max_x"),
        F.min("y").alias("min_y"),
        F.max("y").alias("max_y"),
    )


def mask_regions(mask: DataFrame, keys: Sequence[str], min_area: int = 10) -> DataFrame:
    """:func:`run_regions` of a mask of pixels."""
    return run_regions(runs(mask, list(keys)), keys, min_area)


def run_regions(
    run: DataFrame, keys: Sequence[str], min_area: int = 10, strip: int = STRIP, width: int = WIDTH
) -> DataFrame:
    """Outer regions and holes of at least ``min_area`` pixels; a hole names the region around it."""
    keys = list(keys)
    run = cut_lineage(run)
    fore, back = label(run, gaps(run, keys), keys, strip, width)
    outer = _summary(fore, keys).withColumn("kind", F.lit("outer")).withColumn("parent", F.lit(None).cast("string"))

    leaks = _leaks(back, run, keys)
    holes = back.join(leaks, "root", "left_anti")
    left = fore.select(*keys, "y", (F.col("x1") + 1).alias("x0"), F.col("root").alias("around"))
    parents = holes.join(left, [*keys, "y", "x0"]).groupBy("root").agg(F.min_by("around", F.struct("y", "x0")).alias("parent"))
    inner = _summary(holes, keys).withColumn("kind", F.lit("hole")).join(parents, "root", "left")
    both = outer.unionByName(inner.select(*outer.columns))
    return both.filter(F.col("area") >= min_area).withColumnRenamed("root", "region")


def _leaks(back: DataFrame, run: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Components of gaps that reach the outside: past the ends of a neighbouring row, or an empty row."""
    ends = run.groupBy(*keys, "y").agg(F.min("x0").alias("first"), F.max("x1").alias("last"))
    near = back.select(*keys, "root", "x0", "x1", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"))
    beyond = F.col("first").isNull() | (F.col("x0") < F.col("first")) | (F.col("x1") > F.col("last"))
    return near.join(ends, [*keys, "y"], "left").filter(beyond).select("root").distinct()
