"""Polygon filling and region labelling against brute force."""

import random
from collections import deque

import pytest

from pyspark.sql import functions as F

from cairn.operators import raster as G, regions as R, runs as M


def inside(px, py, rings):
    hit = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if (y0 <= py < y1) or (y1 <= py < y0):
                if px >= x0 + (py - y0) / (y1 - y0) * (x1 - x0):
                    hit = not hit
    return hit


def wkt(polys):
    text = ", ".join("(" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in ring) + ")" for ring in p) + ")" for p in polys)
    return f"MULTIPOLYGON ({text})"


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]
HOLE = [(3, 3), (6, 3), (6, 6), (3, 6), (3, 3)]
CONCAVE = [(12, 1), (19, 1), (15, 9), (19, 18), (12, 18), (14, 9), (12, 1)]
SHARES = [(10, 0), (12, 0), (12, 10), (10, 10), (10, 0)]


def fill(spark, polys, size=20):
    rows = [(i, "a", 1, wkt(p)) for i, p in enumerate(polys)]
    df = spark.createDataFrame(rows, "PolyId int, ImageId string, ClassType int, MultipolygonWKT string")
    scale = size / (size + 1.0)
    grid = spark.createDataFrame([("a", size * scale, size * scale)], "ImageId string, Xmax double, Ymin double")
    return {(r["y"], r["x"]) for r in G.polygon_mask(df, grid, size, size).collect()}


@pytest.mark.parametrize("polys", [[[[SQUARE, HOLE]]], [[[CONCAVE]]], [[[SQUARE, HOLE], [CONCAVE]]], [[[SQUARE]], [[HOLE]]]])
def test_fill_equals_point_in_polygon(spark, polys):
    want = {
        (y, x)
        for y in range(20)
        for x in range(20)
        for multi in polys
        for p in multi
        if inside(x + 0.5, y + 0.5, p)
    }
    assert fill(spark, polys) == want


def test_shared_edge_is_not_counted_twice(spark):
    a, b = fill(spark, [[[SQUARE]]]), fill(spark, [[[SHARES]]])
    assert not a & b and len(a) == 100 and len(b) == 20


def brute(mask, near):
    left, out = set(mask), []
    while left:
        todo, seen = deque([left.pop()]), set()
        while todo:
            y, x = todo.popleft()
            seen.add((y, x))
            for dy, dx in near:
                p = (y + dy, x + dx)
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(seen)
    return out


EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
FOUR = [(0, 1), (1, 0), (0, -1), (-1, 0)]


@pytest.mark.parametrize("seed,density,tile", [(1, 0.45, (64, 4096)), (1, 0.45, (4, 16)), (2, 0.75, (5, 7)), (3, 0.6, (1, 1))])
def test_regions_equal_flood_fill(spark, seed, density, tile):
    rng = random.Random(seed)
    height, width = 24, 150
    mask = {(y, x) for y in range(height) for x in range(width) if rng.random() < density}
    df = spark.createDataFrame([("a", 1, y, x) for y, x in mask], "i string, c int, y int, x int")
    got = R.run_regions(R.runs(df, ["i", "c"]), ["i", "c"], 1, *tile).collect()
    starts = {r["region"] for r in got if r["kind"] == "outer"}
    first = lambda c: min(f"r|a|1|{y}|{x}" for y, x in c if (y, x - 1) not in mask)
    assert starts == {first(c) for c in brute(mask, EIGHT)}
    outer = sorted(len(c) for c in brute(mask, EIGHT))
    assert sorted(r["area"] for r in got if r["kind"] == "outer") == outer
    empty = {(y, x) for y in range(-1, height + 1) for x in range(-1, width + 1)} - mask
    holes = sorted(len(c) for c in brute(empty, FOUR) if (-1, -1) not in c)
    assert sorted(r["area"] for r in got if r["kind"] == "hole") == holes
    names = {r["region"] for r in got if r["kind"] == "outer"}
    assert all(r["parent"] in names for r in got if r["kind"] == "hole")


def test_corner_pixels_are_one_region_and_small_ones_go(spark):
    df = spark.createDataFrame([("a", 1, 0, 0), ("a", 1, 1, 1), ("a", 1, 5, 5)], "i string, c int, y int, x int")
    got = R.mask_regions(df, ["i", "c"], min_area=2).collect()
    assert [(r["kind"], r["area"], r["min_x"], r["max_y"]) for r in got] == [("outer", 2, 0, 1)]


def test_empty_mask_has_no_regions(spark):
    df = spark.createDataFrame([], "i string, c int, y int, x int")
    assert R.mask_regions(df, ["i", "c"]).count() == 0


def test_runs_merge_meet_and_count_as_pixels(spark):
    rng = random.Random(6)

    def spans(n):
        return [("a" if rng.random() < 0.9 else None, rng.randrange(3), x := rng.randrange(300), x + rng.randrange(150)) for _ in range(n)]

    sides = []
    for n in (40, 50):
        rows = spans(n)
        df = spark.createDataFrame(rows, "k string, y int, x0 int, x1 int").filter("k IS NOT NULL")
        runs = M.merged(df, ["k"])
        want = {(k, y, x) for k, y, a, b in rows if k for x in range(a, b + 1)}
        assert {(r["k"], r["y"], r["x"]) for r in M.pixels(runs).collect()} == want
        found = sorted((r["y"], r["x0"], r["x1"]) for r in runs.collect())
        assert all(a[0] < b[0] or a[2] + 1 < b[1] for a, b in zip(found, found[1:]))
        sides.append((runs, want))
    (a, x), (b, y) = sides
    assert {(r["k"], r["y"], r["x"]) for r in M.pixels(M.intersected(a, b, ["k"])).collect()} == x & y
    got = M.overlap(a, b, ["k"], ["k"]).first()
    assert (got["both"], got["either"]) == (len(x & y), len(x | y))
    none = M.overlap(a.limit(0), b.limit(0), ["k"], ["k"])
    assert none.count() == 0 and M.area(a, ["k"]).first()["n"] == len(x)
    assert M.overlap(a, b.limit(0), ["k"], ["k"]).agg(F.sum("jaccard")).first()[0] == 0


def exploded(spark):
    """A mask and pixels whose rows Spark's size estimate doesn't know."""
    runs = spark.createDataFrame([("a", 1, 0, 2, 5), ("a", 2, 1, 0, 1)], "ImageId string, ClassType int, y int, x0 int, x1 int")
    lines = spark.range(4).selectExpr("'a' AS ImageId", "CAST(id AS int) AS y")
    cells = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return M.pixels(runs), cells.withColumn("value", F.col("y") * 10 + F.col("x"))


def merge_only(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "SortMergeJoin" in plan and "Broadcast" not in plan


def test_labelled_pixels_broadcast_no_side(spark):
    got = G.labelled_pixels(*exploded(spark))
    assert merge_only(got)
    want = {(1, 0, x, x) for x in range(2, 6)} | {(2, 1, x, 10 + x) for x in range(2)}
    assert {(r.ClassType, r.y, r.x, r.value) for r in got.collect()} == want


def test_shared_runs_broadcast_no_side(spark):
    """Neither mask is collected, however small Spark takes it for."""
    a, b = (
        M.merged(spark.createDataFrame(rows, "k string, y int, x0 int, x1 int"), ["k"])
        for rows in ([("a", 1, 0, 200), ("b", 1, 3, 4)], [("a", 1, 60, 70), ("a", 1, 199, 300), ("a", 2, 0, 9)])
    )
    assert merge_only(M.intersected(a, b, ["k"])) and merge_only(M.overlap(a, b, ["k"], ["k"]))
    assert {(r.k, r.both, r.either) for r in M.overlap(a, b, ["k"], ["k"]).collect()} == {("a", 13, 311), ("b", 0, 2)}


def test_vectors_under_a_mask_broadcast_no_side(spark):
    mask, values = exploded(spark)
    bands = values.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(1))))
    got = G.labelled_pixels(mask, G.pixel_vectors(bands.withColumn("value", F.col("value") + F.col("band")), 2))
    assert merge_only(got)
    want = {(1, x, (x, x + 1)) for x in range(2, 6)} | {(2, x, (10 + x, 11 + x)) for x in range(2)}
    assert {(r.ClassType, r.x, tuple(r.bands)) for r in got.collect()} == want


def test_rings_spread_by_the_crossings_they_make(spark, monkeypatch):
    rows = [(i, "a", i % 2, wkt([[SQUARE, HOLE], [CONCAVE]])) for i in range(30)]
    polygons = spark.createDataFrame(rows, "PolyId int, ImageId string, ClassType int, MultipolygonWKT string")
    scale = 20 / 21.0
    grid = spark.createDataFrame([("a", 20 * scale, 20 * scale)], "ImageId string, Xmax double, Ymin double")
    want = sorted(map(str, G.polygon_runs(polygons, grid, 20, 20).collect()))
    monkeypatch.setattr(G, "CROSSINGS", 10)
    many = G.polygon_runs(polygons, grid, 20, 20)
    tasks = -(-(30 * 40 + sum(len(r[3]) for r in rows) // 8) // 10)
    assert "PolyId#" in (plan := many._jdf.queryExecution().executedPlan().toString()) and f", {tasks})" in plan
    assert sorted(map(str, many.collect())) == want


def test_pixel_tasks_grow_with_the_images(spark, tmp_path, monkeypatch):
    from cairn.plans import views as V

    parts = spark.range(1200).selectExpr("id AS p_partkey", "CAST(id % 50 AS int) AS p_size")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    rows = 36 * V.RASTER * V.RASTER * V.BANDS
    assert V.pixels(spark, str(tmp_path)).count() == rows
    monkeypatch.setattr(V, "PIXEL_ROWS", rows // 24)
    pixels = V.pixels(spark, str(tmp_path))
    assert pixels.rdd.getNumPartitions() == 24 and pixels.count() == rows
