"""Polygons, masks and bands."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from cairn.operators import raster as G, regions, runs as R
from cairn.operators.selection import percentiles
from cairn.plans import views as V
from cairn.plans.q_stats import rounded, settled
from cairn.plans.registry import query

KEYS = ["ImageId", "ClassType"]

VERTEX_SQL = r"""rings AS (SELECT PolyId, ImageId, ClassType, 0 AS poly, (unnest(range(0, len(r))))::int AS ring, unnest(r) AS t
    FROM (SELECT *, regexp_extract_all(MultipolygonWKT, '\(([^()]+)\)', 1) AS r FROM polygons)),
  vertices AS (SELECT PolyId, ImageId, ClassType, poly, ring, (unnest(range(0, len(v))))::int AS vertex,
      string_split(trim(unnest(v)), ' ') AS xy FROM (SELECT *, string_split(t, ',') AS v FROM rings)),
  world AS (SELECT * EXCLUDE (xy), xy[1]::double AS x, xy[2]::double AS y FROM vertices)"""
EDGE_SQL = """edges AS (SELECT * FROM (SELECT PolyId, ImageId, ClassType, poly, ring, vertex AS edge, x AS x0, y AS y0,
    lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM {source} WINDOW w AS (PARTITION BY PolyId, poly, ring ORDER BY vertex))
    WHERE x1 IS NOT NULL)"""
PLACED_SQL = """placed AS (SELECT w.* EXCLUDE (x, y), round_even(x * (41.0::double * 41 / 42 / Xmax), 0) AS x,
    round_even(y * (41.0::double * 41 / 42 / Ymin), 0) AS y FROM world w JOIN grid USING (ImageId))"""
CROSS_SQL = """crossings AS (SELECT e.*, r.r::int AS line, x0 + (r.r + 0.5 - y0) / (y1 - y0) * (x1 - x0) AS at_x
    FROM edges e JOIN range(0, 41) r(r) ON least(y0, y1) <= r.r + 0.5 AND r.r + 0.5 < greatest(y0, y1))"""
MASK_SQL = f"""{VERTEX_SQL}, {PLACED_SQL}, {EDGE_SQL.format(source='placed')}, {CROSS_SQL},
  paired AS (SELECT *, row_number() OVER (PARTITION BY PolyId, poly, line ORDER BY at_x) AS rn,
    lead(at_x) OVER (PARTITION BY PolyId, poly, line ORDER BY at_x) AS nxt FROM crossings),
  mask AS (SELECT DISTINCT ImageId, ClassType, line AS y, c.c::int AS x FROM paired JOIN range(0, 41) c(c)
    ON rn % 2 = 1 AND at_x <= c.c + 0.5 AND c.c + 0.5 < nxt)"""
VIEWS = ("polygons", "grid")


def runs_of(spark, d, polygons=None):
    return G.polygon_runs(V.polygons(spark, d) if polygons is None else polygons, V.grid(spark, d), V.RASTER, V.RASTER)


def mask_of(spark, d):
    return R.pixels(runs_of(spark, d))


@query("wkt_to_vertices", V.sql(f"WITH {VERTEX_SQL} SELECT * FROM world", *VIEWS))
def wkt_to_vertices(spark, d):
    return G.ring_vertices(G.wkt_rings(V.polygons(spark, d)))


@query("ring_edges", V.sql(f"WITH {VERTEX_SQL}, {EDGE_SQL.format(source='world')} SELECT * FROM edges", *VIEWS))
def ring_edges(spark, d):
    return G.ring_edges(G.wkt_rings(V.polygons(spark, d)))


@query("world_to_raster", V.sql(f"WITH {VERTEX_SQL}, {PLACED_SQL} SELECT * FROM placed", *VIEWS))
def world_to_raster(spark, d):
    rings = G.wkt_rings(V.polygons(spark, d))
    return G.ring_vertices(G.to_raster(rings, V.grid(spark, d), V.RASTER, V.RASTER))


@query(
    "edge_row_range_join",
    V.sql(
        f"""WITH {VERTEX_SQL}, {PLACED_SQL}, {EDGE_SQL.format(source='placed')}, {CROSS_SQL}
        SELECT PolyId, ImageId, poly, ring, edge, line, round(at_x, 6) AS at_x FROM crossings""",
        *VIEWS,
    ),
)
def edge_row_range_join(spark, d):
    """Which raster rows each polygon edge covers: rows are generated per edge, never compared with all edges."""
    rings = G.to_raster(G.wkt_rings(V.polygons(spark, d)), V.grid(spark, d), V.RASTER, V.RASTER)
    rows = G.edge_rows(G.ring_edges(rings), V.RASTER)
    return rounded(rows.select("PolyId", "ImageId", "poly", "ring", "edge", "line", "at_x"), ["at_x"])


@query("polygon_fill_mask", V.sql(f"WITH {MASK_SQL} SELECT * FROM mask", *VIEWS))
def polygon_fill_mask(spark, d):
    return mask_of(spark, d)


@query(
    "mask_channels",
    V.sql(
        f"""WITH {MASK_SQL} SELECT ImageId, y, x, max((ClassType=4)::int) AS mask_4, max((ClassType=2)::int) AS mask_2,
             max((ClassType=1)::int) AS mask_1 FROM mask WHERE ClassType IN (4, 2, 1) GROUP BY 1, 2, 3""",
        *VIEWS,
    ),
)
def mask_channels(spark, d):
    return G.mask_channels(mask_of(spark, d), (4, 2, 1))


BANDS_SQL = """vec AS (SELECT ImageId, y, x, list(value ORDER BY band) AS bands FROM pixels GROUP BY 1, 2, 3)"""


@query(
    "labelled_pixels",
    V.sql(f"WITH {MASK_SQL} SELECT * FROM mask JOIN pixels USING (ImageId, y, x)", *VIEWS, "pixels"),
)
def labelled_pixels(spark, d):
    """Values of all bands under every class mask."""
    return G.labelled_pixels(mask_of(spark, d), V.pixels(spark, d))


@query(
    "pixels_per_class",
    V.sql(f"WITH {MASK_SQL} SELECT ClassType, count(*) AS n FROM mask GROUP BY 1", *VIEWS),
)
def pixels_per_class(spark, d):
    return R.area(runs_of(spark, d), ["ClassType"])


def _sided(side: str) -> str:
    """The mask tables of the polygons with even or odd ids, under names of their own."""
    body = MASK_SQL.replace("FROM polygons", f"FROM polygons WHERE PolyId % 2 = {int(side == 'odd')}")
    return re.sub(r"\b(rings|vertices|world|placed|edges|crossings|paired|mask)\b", rf"{side}_\1", body)


@query(
    "mask_overlap",
    V.sql(
        f"""WITH {_sided('even')}, {_sided('odd')},
          m AS (SELECT ImageId, ClassType, y, x, count(*) AS sides FROM
            (SELECT * FROM even_mask UNION ALL SELECT * FROM odd_mask) GROUP BY 1, 2, 3, 4)
        SELECT ClassType, count(*) FILTER (sides = 2) AS "both", count(*) AS either,
          round(count(*) FILTER (sides = 2) / count(*)::double, 9) AS jaccard FROM m GROUP BY 1""",
        *VIEWS,
    ),
)
def mask_overlap(spark, d):
    """Overlap of two sets of polygons (even and odd ids) per class, without a row per pixel."""
    polygons = V.polygons(spark, d)
    even, odd = (runs_of(spark, d, polygons.filter(F.col("PolyId") % 2 == k)) for k in (0, 1))
    return R.overlap(even, odd, KEYS, ["ClassType"]).withColumn("jaccard", F.round("jaccard", 9))


@query(
    "union_class_blocks",
    V.sql(
        " UNION ALL ".join(
            f"SELECT PolyId, ImageId, {c} AS label FROM polygons WHERE ClassType = {c}" for c in V.CLASSES
        ),
        "polygons",
    ),
)
def union_class_blocks(spark, d):
    """The class blocks set under each other; one labelled pass gives the same rows as a union per class."""
    rows = V.polygons(spark, d).filter(F.col("ClassType").isin(*V.CLASSES))
    return rows.select("PolyId", "ImageId", F.col("ClassType").alias("label"))


@query(
    "band_percentiles",
    V.sql(
        """SELECT ImageId, band, round(quantile_cont(value::double, 0.02), 6) AS p2, round(quantile_cont(value::double, 0.98), 6) AS p98,
             round(quantile_cont(value::double, 0.05), 6) AS p5, round(quantile_cont(value::double, 0.95), 6) AS p95
           FROM pixels GROUP BY 1, 2""",
        "pixels",
    ),
)
def band_percentiles(spark, d):
    cuts = {"p2": 0.02, "p98": 0.98, "p5": 0.05, "p95": 0.95}
    wanted = {n: ("value", q) for n, q in cuts.items()}
    return rounded(percentiles(V.pixels(spark, d), ["ImageId", "band"], wanted), list(cuts))


STRETCH_SQL = """q AS (SELECT ImageId, band, quantile_cont(value::double, {lo}) AS p_lo,
  quantile_cont(value::double, {hi}) AS p_hi FROM pixels GROUP BY 1, 2)"""


@query(
    "stretch_8bit",
    V.sql(
        f"""WITH {STRETCH_SQL.format(lo=0.02, hi=0.98)}
        SELECT ImageId, y, x, band, floor(round(least(greatest((value - p_lo) * 255 / (p_hi - p_lo), 0), 255), 6))::int AS value
        FROM pixels JOIN q USING (ImageId, band)""",
        "pixels",
    ),
)
def stretch_8bit(spark, d):
    pixels = V.pixels(spark, d)
    out = G.stretch(pixels, G.band_percentiles(pixels, 2, 98), 255, whole=False)
    return out.withColumn("value", F.floor(F.round("value", 6)).cast("int"))


@query(
    "stretch_unit",
    V.sql(
        f"""WITH {STRETCH_SQL.format(lo=0.05, hi=0.95)}
        SELECT ImageId, y, x, band, round(least(greatest((value - p_lo) / (p_hi - p_lo), 0), 1) + 1e-9::double, 6) AS value
        FROM pixels JOIN q USING (ImageId, band)""",
        "pixels",
    ),
)
def stretch_unit(spark, d):
    pixels = V.pixels(spark, d)
    return settled(G.stretch(pixels, G.band_percentiles(pixels, 5, 95), 1, whole=False), ["value"])


@query("band_composite", V.sql(f"WITH {BANDS_SQL} SELECT ImageId, y, x, bands[5] AS r, bands[3] AS g, bands[2] AS b FROM vec", "pixels"))
def band_composite(spark, d):
    return G.band_composite(G.pixel_vectors(V.pixels(spark, d), V.BANDS))


@query("pixels_to_vectors", V.sql(f"WITH {BANDS_SQL} SELECT * FROM vec", "pixels"))
def pixels_to_vectors(spark, d):
    return G.pixel_vectors(V.pixels(spark, d), V.BANDS)


REGION_SQL = f"""WITH RECURSIVE {MASK_SQL},
  ends AS (SELECT ImageId, ClassType, y, min(x) AS a, max(x) AS b FROM mask GROUP BY 1, 2, 3),
  inside AS (SELECT ImageId, ClassType, y, x.x::int AS x FROM ends JOIN range(0, 41) x(x) ON x.x BETWEEN a AND b),
  cells AS (SELECT i.*, CASE WHEN m.x IS NULL THEN 'g' ELSE 'r' END AS kind
    FROM inside i LEFT JOIN mask m USING (ImageId, ClassType, y, x)),
  part AS (SELECT *, min(x) OVER (PARTITION BY ImageId, ClassType, kind, y, run) AS x0 FROM (SELECT *,
    x - row_number() OVER (PARTITION BY ImageId, ClassType, kind, y ORDER BY x) AS run FROM cells)),
  steps AS (SELECT dy::int AS dy, dx::int AS dx, kind FROM range(-1, 2) a(dy), range(-1, 2) b(dx), (VALUES ('r'), ('g')) k(kind)
    WHERE (dy <> 0 OR dx <> 0) AND (kind = 'r' OR dy * dx = 0)),
  seeds AS (SELECT ImageId, ClassType, kind, y, x FROM cells c WHERE NOT EXISTS (
    SELECT 1 FROM steps s JOIN cells n ON n.ImageId = c.ImageId AND n.ClassType = c.ClassType AND n.kind = c.kind
      AND n.y = c.y + s.dy AND n.x = c.x + s.dx WHERE s.kind = c.kind AND (s.dy < 0 OR s.dy = 0 AND s.dx < 0))),
  reach AS (SELECT ImageId, ClassType, kind, y * 41 + x AS seed, y, x FROM seeds
    UNION SELECT n.ImageId, n.ClassType, n.kind, r.seed, n.y, n.x FROM reach r JOIN steps s ON s.kind = r.kind
      JOIN cells n ON n.ImageId = r.ImageId AND n.ClassType = r.ClassType AND n.kind = r.kind
        AND n.y = r.y + s.dy AND n.x = r.x + s.dx),
  rooted AS (SELECT ImageId, ClassType, kind, y, x, min(seed) AS seed FROM reach GROUP BY 1, 2, 3, 4, 5),
  named AS (SELECT *, min(concat_ws('|', kind, ImageId, ClassType, y, x0)) OVER (PARTITION BY ImageId, ClassType, kind, seed)
    AS region FROM rooted JOIN part USING (ImageId, ClassType, kind, y, x)),
  leaks AS (SELECT DISTINCT g.region FROM named g, (VALUES (-1), (1)) v(d) WHERE g.kind = 'g' AND NOT EXISTS (
    SELECT 1 FROM cells n WHERE n.ImageId = g.ImageId AND n.ClassType = g.ClassType AND n.y = g.y + v.d AND n.x = g.x)),
  around AS (SELECT g.region, min_by(r.region, g.y * 41 + g.x0) AS parent FROM named g JOIN named r ON r.kind = 'r'
    AND r.ImageId = g.ImageId AND r.ClassType = g.ClassType AND r.y = g.y AND r.x = g.x0 - 1 WHERE g.kind = 'g' GROUP BY 1)
SELECT ImageId, ClassType, region, count(*) AS area, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
  CASE kind WHEN 'r' THEN 'outer' ELSE 'hole' END AS kind, parent
FROM named LEFT JOIN around USING (region) WHERE region NOT IN (SELECT region FROM leaks)
GROUP BY ImageId, ClassType, region, named.kind, parent HAVING count(*) >= 10"""


@query("mask_regions", V.sql(REGION_SQL, *VIEWS))
def mask_regions(spark, d):
    """Connected regions and holes of every class mask with at least ten pixels."""
    return regions.run_regions(runs_of(spark, d), KEYS, min_area=10)
