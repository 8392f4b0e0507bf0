"""Polygons, masks and bands as tables.

Masks are sparse: runs ``(image, class, y, x0, x1)``, or one row ``(image, class, y, x)`` per covered pixel. A pixel belongs to a polygon when
its centre is inside by the even-odd rule; edges are half open, so polygons sharing an edge never share
a pixel. Several polygons of one class form a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.joins import attach, join_dimension
from cairn.operators.ordering import fit_row
from cairn.operators.runs import merged, pixels
from cairn.operators.selection import group_stats

#: Crossings of edges and raster rows that a task sorts, about.
CROSSINGS = 1_000_000

RING = r"\(([^()]+)\)"


def wkt_rings(df: DataFrame, wkt: str = "MultipolygonWKT") -> DataFrame:
    """One row per ring: ``poly`` and ``ring`` count from 0 and ring 0 is the outer one.

    ``points`` is the ring as an array of ``(x, y)``. All parsing happens inside the row.
    """
    number = r"[^ ,()]+ +[^ ,()]+"
    one_poly = rf"\(\s*\(\s*{number}[^()]*\)(?:\s*,\s*\([^()]*\))*\s*\)"
    polys = F.regexp_extract_all(F.col(wkt), F.lit(f"({one_poly})"), F.lit(1))

    def point(text: Column) -> Column:
        xy = F.split(F.trim(text), r"\s+")
        return F.struct(F.get(xy, F.lit(0)).cast("double").alias("x"), F.get(xy, F.lit(1)).cast("double").alias("y"))

    per_poly = df.select("*", F.posexplode(polys).alias("poly", "_text")).drop(wkt)
    rings = F.regexp_extract_all(F.col("_text"), F.lit(RING), F.lit(1))
    per_ring = per_poly.select("*", F.posexplode(rings).alias("ring", "_ring")).drop("_text")
    return per_ring.withColumn("points", F.transform(F.split("_ring", ","), point)).drop("_ring")


def ring_vertices(rings: DataFrame) -> DataFrame:
    """One row per vertex, numbered from 0."""
    return rings.select("*", F.posexplode("points").alias("vertex", "_p")).select(
        *[c for c in rings.columns if c != "points"], "vertex", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")
    )


def ring_edges(rings: DataFrame) -> DataFrame:
    """One row per edge; built inside each ring's row, so a long ring needs no shuffle or sort."""
    starts = F.slice(F.col("points"), F.lit(1), F.size("points") - 1)
    ends = F.slice(F.col("points"), F.lit(2), F.size("points") - 1)
    edges = F.zip_with(
        starts,
        ends,
        lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")),
    )
    kept = [c for c in rings.columns if c != "points"]
    return rings.filter(F.size("points") > 1).select(*kept, F.posexplode(edges).alias("edge", "_e")).select(
        *kept, "edge", "_e.x0", "_e.y0", "_e.x1", "_e.y1"
    )


def to_raster(rings: DataFrame, grid: DataFrame, height: int, width: int, image: str = "ImageId") -> DataFrame:
    """World to raster coordinates, rounded half to even."""
    xf = F.lit(width * width / (width + 1.0)) / F.col("Xmax")
    yf = F.lit(height * height / (height + 1.0)) / F.col("Ymin")
    joined = join_dimension(rings, grid, image).withColumn("_xf", xf).withColumn("_yf", yf)
    moved = F.transform(
        "points",
        lambda p: F.struct(F.rint(p["x"] * F.col("_xf")).alias("x"), F.rint(p["y"] * F.col("_yf")).alias("y")),
    )
    return joined.withColumn("points", moved).drop("_xf", "_yf", "Xmax", "Ymin")


def edge_rows(edges: DataFrame, height: int) -> DataFrame:
    """Raster rows whose centre line ``y + 0.5`` each edge crosses, with the crossing ``at_x``."""
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first = F.greatest(F.ceil(low - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil(high - 0.5) - 1, F.lit(height - 1)).cast("int")
    rows = F.when(first <= last, F.sequence(first, last))
    t = (F.col("line") + 0.5 - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return (
        edges.filter(F.col("y0") != F.col("y1"))
        .withColumn("line", F.explode(rows))
        .withColumn("at_x", F.col("x0") + t * (F.col("x1") - F.col("x0")))
    )


def fill_polygons(
    crossings: DataFrame, width: int, keys: Sequence[str], poly: Sequence[str], tasks: int | None = None
) -> DataFrame:
    """Runs of covered pixels ``(*keys, y, x0, x1)``: sorted crossings of a polygon and row pair up into spans.

    The unit of work is one raster row of one polygon, however many vertices the polygon has. Spans of
    one key and row are merged where they overlap or adjoin, in ``tasks`` tasks if given.
    """
    ordered = crossings.groupBy(*keys, *poly, F.col("line").alias("y")).agg(
        F.array_sort(F.collect_list("at_x")).alias("_at")
    )
    pairs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("_at") / 2).cast("int")),
        lambda i: F.struct(
            F.greatest(F.ceil(F.element_at("_at", i * 2 - 1) - 0.5), F.lit(0)).cast("int").alias("x0"),
            F.least(F.ceil(F.element_at("_at", i * 2) - 0.5) - 1, F.lit(width - 1)).cast("int").alias("x1"),
        ),
    )
    spans = ordered.filter(F.size("_at") > 1).select(*keys, "y", F.inline(pairs)).filter("x0 <= x1")
    return merged(spans.repartition(tasks, *keys, "y") if tasks else spans, keys)


def polygon_runs(
    polygons: DataFrame, grid: DataFrame, height: int, width: int, keys: Sequence[str] = ("ImageId", "ClassType")
) -> DataFrame:
    """Mask of every image and class as runs, holes cut out of their own polygon.

    Rings are short and make many crossings, which Spark's sizes don't tell: they are spread over tasks
    by the crossings that polygons of their number and length of text make.
    """
    size = fit_row(polygons, {"n": F.count("*"), "chars": F.sum(F.length("MultipolygonWKT"))})
    tasks = -(-(size["n"] * 2 * height + (size["chars"] or 0) // 8) // CROSSINGS)
    tasks = max(tasks, polygons.sparkSession.sparkContext.defaultParallelism)
    rings = to_raster(wkt_rings(polygons), grid, height, width).repartition(tasks, *keys, "PolyId")
    crossings = edge_rows(ring_edges(rings), height)
    return fill_polygons(crossings, width, list(keys), ["PolyId", "poly"], tasks)


def polygon_mask(
    polygons: DataFrame, grid: DataFrame, height: int, width: int, keys: Sequence[str] = ("ImageId", "ClassType")
) -> DataFrame:
    """Mask pixels of every image and class."""
    return pixels(polygon_runs(polygons, grid, height, width, keys))


def mask_channels(mask: DataFrame, classes: Sequence[int], image: str = "ImageId", label: str = "ClassType") -> DataFrame:
    """One 0/1 column per class for every pixel covered by any of them."""
    return (
        mask.filter(F.col(label).isin(*classes))
        .groupBy(image, "y", "x")
        .agg(*[F.max((F.col(label) == c).cast("int")).alias(f"mask_{c}") for c in classes])
    )


def labelled_pixels(mask: DataFrame, pixels: DataFrame, image: str = "ImageId") -> DataFrame:
    """Band values of masked pixels, labelled by class.

    Either side may have far more rows than Spark's size estimate, which doesn't know how many rows an
    ``explode`` makes: the join asks for a merge, so that neither side is collected and broadcast.
    """
    return mask.join(pixels.hint("merge"), [image, "y", "x"])


def pixel_vectors(pixels: DataFrame, bands: int, image: str = "ImageId") -> DataFrame:
    """One row per pixel with its band values in band order."""
    return pixels.groupBy(image, "y", "x").agg(
        F.array(*[F.max(F.when(F.col("band") == b, F.col("value"))) for b in range(bands)]).alias("bands")
    )


def band_composite(vectors: DataFrame, red: int = 4, green: int = 2, blue: int = 1, image: str = "ImageId") -> DataFrame:
    picks = {"r": red, "g": green, "b": blue}
    return vectors.select(image, "y", "x", *[F.get("bands", F.lit(b)).alias(n) for n, b in picks.items()])


def band_percentiles(pixels: DataFrame, lower: float, higher: float, image: str = "ImageId") -> DataFrame:
    """Exact lower and upper percentile of each band of each image, with the band's pixel count."""
    cuts = {"p_lo": ("value", lower / 100), "p_hi": ("value", higher / 100)}
    return group_stats(pixels, [image, "band"], cuts, rows="n_rows")


def stretch(
    pixels: DataFrame, cuts: DataFrame, top: float, whole: bool, image: str = "ImageId"
) -> DataFrame:
    """Band values moved from the percentile range to ``[0, top]``; ``whole`` cuts the fraction."""
    joined = attach(pixels, cuts, [image, "band"], "n_rows", ["p_lo", "p_hi"])
    span = F.nullif(F.col("p_hi") - F.col("p_lo"), F.lit(0.0))
    t = F.least(F.greatest((F.col("value") - F.col("p_lo")) * top / span, F.lit(0.0)), F.lit(float(top)))
    t = F.when(span.isNotNull(), t)
    return joined.withColumn("value", F.floor(t).cast("int") if whole else t).drop("p_lo", "p_hi")
