"""Exact nearest-neighbour regression without comparing every pair.

Training rows go to the nearest of a few pivots. The distances of a cell's rows to its pivot bound, by
the triangle inequality, how near they can be to a query, so a query visits only the cells that can hold
one of its neighbours. How near its neighbours are at most, a query learns first from the cell it lies in.
Large cells are cut by that distance into slices, of which a query again visits only
those that can matter, and large slices into chunks of bounded size: a hot cell becomes many small groups,
each of which returns at most ``k`` rows per query. Inside a group the rows lie in small blocks with boxes around them,
and a query is compared with the rows of those blocks only that its bound reaches, so the cells may grow. The pivots grow with the root of the training rows; they lie in
cells of their own around a root of them, and the same inequality leads a row to the few cells of pivots that matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions.columns import hash_unit
from cairn.sources.scratch import cut_lineage

TRAIN_CHUNK = 20_000  # training rows per group
QUERY_CHUNK = 5_000  # queries per group
SLICES = 64  # radius slices of a cell; larger cells are also split by hash
BLOCK = 4_000_000  # distances held at once inside a task
LEAF = 32  # rows of a block inside a group, at least k
SLACK = 1e-12  # of a distance, for its rounding


def _matrix(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return pdf[list(columns)].to_numpy(dtype="float64")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return total


def pivot_cells(pivots: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """About a root of the pivots as centres, and the numbers of the pivots nearest to each."""
    centres = pivots[:: max(1, round(len(pivots) ** 0.5))]
    own = np.concatenate([_squared(part, centres).argmin(axis=1) for part in _blocks(pivots, len(centres))])
    return centres, [np.flatnonzero(own == g) for g in range(len(centres))]


def _blocks(rows: np.ndarray, width: int) -> list[np.ndarray]:
    step = max(1, BLOCK // max(1, width))
    return [rows[i : i + step] for i in range(0, len(rows), step)]


def nearest_pivot(x: np.ndarray, pivots: np.ndarray, centres: np.ndarray, members: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's nearest pivot (the first of equals) and the distance to it."""
    to_centre = np.sqrt(_squared(x, centres))
    wide = np.array([np.sqrt(_squared(pivots[m], centres[g : g + 1]).max()) if len(m) else -np.inf for g, m in enumerate(members)])
    best, at = np.full(len(x), np.inf), np.zeros(len(x), int)
    home = np.where(np.isfinite(wide), to_centre, np.inf).argmin(axis=1)
    for rest in (False, True):
        for g, m in enumerate(members):
            if rest:
                asks = np.flatnonzero((home != g) & (to_centre[:, g] - wide[g] <= best * (1 + 1e-9) + 1e-9))
            else:
                asks = np.flatnonzero(home == g)
            if len(asks) and len(m):
                d = np.sqrt(_squared(x[asks], pivots[m]))
                k = d.argmin(axis=1)
                found, number = d[np.arange(len(asks)), k], m[k]
                better = (found < best[asks]) | ((found == best[asks]) & (number < at[asks]))
                best[asks[better]], at[asks[better]] = found[better], number[better]
    return at, best


def assign_cells(df: DataFrame, features: Sequence[str], pivots: np.ndarray) -> DataFrame:
    """Nearest pivot of each row and the distance to it."""
    centres, members = pivot_cells(pivots)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cell, radius = nearest_pivot(_matrix(pdf, features), pivots, centres, members)
            yield pdf.assign(cell=cell.astype("int32"), radius=radius)

    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInPandas(assign, f"{fields}, cell int, radius double")


def cell_summary(cells: DataFrame, key: str, k: int) -> list:
    """Per cell: rows, largest distance to the pivot and the ``k`` smallest ones (a few numbers per pivot)."""
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("far"))
    rank = F.row_number().over(W.partitionBy("cell").orderBy("radius", key))
    # Spark limits each map task to k rows per cell before the shuffle
    near = cells.select("cell", key, "radius").withColumn("_rank", rank).filter(F.col("_rank") <= k)
    near = near.groupBy("cell").agg(F.array_sort(F.collect_list("radius")).alias("near"))
    return sizes.join(near, "cell").collect()


def pivot_count(rows: int) -> int:
    return int(max(1, 4 * rows**0.5))


def reachable(
    x: np.ndarray, k: int, centres: np.ndarray, members: list[np.ndarray], pivots: np.ndarray, far: np.ndarray, near: list,
    known: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, bounds, distances to the pivots) of the cells that can hold one of the ``k`` nearest of a row.

    ``members`` are the cells of pivots, ``far`` and ``near`` the greatest and the least radii of each cell.
    The bound is ``known`` where that is finite, else the k-th least way over a pivot to one of its near rows, by the
    nearest cells of pivots that hold enough.
    """
    to_centre = np.sqrt(_squared(x, centres))
    # How far a row of such a cell can lie from the centre.
    wide = np.array([(np.sqrt(_squared(pivots[m], centres[g : g + 1]))[:, 0] + far[m]).max() for g, m in enumerate(members)])
    bound = np.full(len(x), np.inf) if known is None else known.copy()
    open_ = np.flatnonzero(~np.isfinite(bound))
    if len(open_):
        bound[open_] = way_bounds(x[open_], to_centre[open_], k, members, pivots, near)
    for g, m in enumerate(members):
        asks = np.flatnonzero(to_centre[:, g] - wide[g] <= bound + SLACK * (to_centre[:, g] + wide[g]))
        if len(asks):
            d = np.sqrt(_squared(x[asks], pivots[m]))
            q, c = np.nonzero(d - far[m] <= bound[asks, None] + SLACK * (d + far[m]))
            yield asks[q], m[c], bound[asks[q]] + SLACK * d[q, c], d[q, c]


def way_bounds(
    x: np.ndarray, to_centre: np.ndarray, k: int, members: list[np.ndarray], pivots: np.ndarray, near: list
) -> np.ndarray:
    """How far the ``k``-th nearest row of each query can be, by the ways over pivots to their near rows."""
    held = np.array([sum(len(near[c]) for c in m) for m in members])
    order = np.argsort(to_centre, axis=1)
    enough = (np.cumsum(held[order], axis=1) < k).sum(axis=1) + 1  # cells of pivots that hold k rows
    places = np.argsort(order, axis=1)
    bound = np.full(len(x), np.inf)
    reach = [np.zeros((0, 2))]
    for g, m in enumerate(members):
        asks = np.flatnonzero(places[:, g] < enough)
        if len(asks):
            d = np.sqrt(_squared(x[asks], pivots[m]))
            owner = np.repeat(np.arange(len(m)), [len(near[c]) for c in m])
            ways = d[:, owner] + np.concatenate([near[c] for c in m])
            ways = np.sort(ways, axis=1)[:, :k]
            reach.append(np.column_stack([np.repeat(asks, ways.shape[1]), ways.ravel()]))
    ways = np.concatenate(reach)
    ways = ways[np.lexsort((ways[:, 1], ways[:, 0]))]
    row = ways[:, 0].astype(int)
    first = np.searchsorted(row, np.arange(len(x)))
    last = np.searchsorted(row, np.arange(len(x)), "right")
    full = last - first >= k
    bound[full] = ways[first[full] + k - 1, 1] * (1 + 1e-9) + 1e-9
    return bound


def visit_plan(
    queries: DataFrame, features: Sequence[str], pivots: np.ndarray, summary: list, k: int, known: str | None = None
) -> DataFrame:
    """One row per query and cell that can hold one of its ``k`` nearest rows.

    The column ``known``, if named, holds how far they can be, infinite where that isn't known.
    """
    cells = np.array([r["cell"] for r in summary])
    far = np.array([r["far"] for r in summary])
    near = [np.asarray(r["near"]) for r in summary]
    own = pivots[cells]
    centres, members = pivot_cells(own)
    kept = [g for g, m in enumerate(members) if len(m)]
    centres, members = centres[kept], [members[g] for g in kept]
    widest = max(max(sum(len(near[c]) for c in m) for m in members), len(members))

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, BLOCK // widest)
        for whole in parts:
            for start in range(0, len(whole), step):
                pdf = whole.iloc[start : start + step].copy()
                limit = pdf.pop(known).to_numpy(dtype="float64") if known else None
                for q, c, bound, d in reachable(_matrix(pdf, features), k, centres, members, own, far, near, limit):
                    yield pdf.iloc[q].assign(cell=cells[c].astype("int32"), bound=bound, to_pivot=d)

    fields = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes if n != known)
    return queries.mapInPandas(plan, f"{fields}, cell int, bound double, to_pivot double")


def radius_cuts(cells: DataFrame, summary: list) -> dict[int, tuple[np.ndarray, int]]:
    """Per cell above a chunk: ascending radii that cut it into slices of about a chunk, and hash parts of a slice."""
    large = {r["cell"]: r["n"] for r in summary if r["n"] > TRAIN_CHUNK}
    if not large:
        return {}
    shares = [i / SLICES for i in range(1, SLICES)]
    these = cells.sparkSession.createDataFrame([(int(c),) for c in large], "cell int")
    radii = cells.join(these, "cell").groupBy("cell").agg(F.percentile_approx("radius", shares, 2000).alias("r"))
    out = {}
    for cell, found in radii.collect():
        slices = min(SLICES, -(-large[cell] // TRAIN_CHUNK))
        cuts = np.unique([found[SLICES * i // slices - 1] for i in range(1, slices)])
        out[cell] = (cuts, -(-large[cell] // (slices * TRAIN_CHUNK)))
    return out


def _slices(cell: np.ndarray, value: np.ndarray, cuts: dict[int, tuple[np.ndarray, int]]) -> np.ndarray:
    """The slice of each value in its cell; cells without cuts have one slice."""
    at = np.zeros(len(cell), int)
    for c in np.unique(cell):
        if c in cuts:
            mine = cell == c
            at[mine] = np.searchsorted(cuts[c][0], value[mine], "right")
    return at


def slice_rows(cells: DataFrame, cuts: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """Training rows with the radius slice they lie in."""
    if not cuts:
        return cells.withColumn("slice", F.lit(0))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            at = _slices(pdf["cell"].to_numpy(), pdf["radius"].to_numpy(), cuts)
            yield pdf.assign(slice=at.astype("int32"))

    fields = ", ".join(f"`{n}` {t}" for n, t in cells.dtypes)
    return cells.mapInPandas(place, f"{fields}, slice int")


def slice_visits(visits: DataFrame, cuts: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """Visits with the slices that can hold a neighbour: the triangle inequality bounds their radii."""
    if not cuts:
        return visits.withColumn("slice", F.lit(0))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cell, mid, bound = (pdf[c].to_numpy() for c in ("cell", "to_pivot", "bound"))
            first, last = _slices(cell, mid - bound, cuts), _slices(cell, mid + bound, cuts)
            times = last - first + 1
            rows = np.repeat(np.arange(len(pdf)), times)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
            yield pdf.iloc[rows].assign(slice=(first[rows] + nth).astype("int32"))

    fields = ", ".join(f"`{n}` {t}" for n, t in visits.dtypes)
    return visits.mapInPandas(place, f"{fields}, slice int")


def box_blocks(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in blocks of at most ``size`` rows that lie together: halves along the widest column."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = x[rows]
        wide = (part.max(axis=0) - part.min(axis=0)).argmax()
        half = -(-len(rows) // (2 * size)) * size
        order = np.argpartition(part[:, wide], half - 1 if half < len(rows) else 0)
        cut = half if half < len(rows) else len(rows) // 2
        todo += [rows[order[:cut]], rows[order[cut:]]]
    return out


def first_of_places(x: np.ndarray, k: int) -> np.ndarray:
    """The numbers of the first ``k`` rows of each place, ascending: no later row of a place can be among the nearest."""
    order = np.lexsort(x.T)  # stable: rows of one place stay in their order
    moved = np.ones(len(x), bool)
    moved[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    start = np.maximum.accumulate(np.where(moved, np.arange(len(x)), 0))
    return np.sort(order[np.arange(len(x)) - start < k])


class Blocks:
    """Rows of one group, in order of preference, in blocks with boxes around them."""

    def __init__(self, x: np.ndarray, k: int):
        self.k = k
        kept = first_of_places(x, k)
        x = x[kept]
        size = max(LEAF, k)
        blocks = box_blocks(x, size)
        self.low = np.array([x[b].min(axis=0) for b in blocks])
        self.high = np.array([x[b].max(axis=0) for b in blocks])
        self.x = np.full((len(blocks), size, x.shape[1]), np.inf)  # places without a row are infinitely far
        self.row = np.zeros((len(blocks), size), int)
        for n, b in enumerate(blocks):
            self.x[n, : len(b)], self.row[n, : len(b)] = x[b], kept[b]

    def _to_boxes(self, q: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), len(self.low)))
        for j in range(q.shape[1]):
            at = q[:, j, None]
            total += np.maximum(np.maximum(self.low[None, :, j] - at, at - self.high[None, :, j]), 0.0) ** 2
        return total

    def _to_rows(self, q: np.ndarray, block: np.ndarray) -> np.ndarray:
        total = np.zeros((len(q), self.x.shape[1]))
        for j in range(q.shape[1]):
            total += (q[:, j, None] - self.x[block, :, j]) ** 2
        return total

    def search(self, q: np.ndarray, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, squared distance) of up to ``k`` nearest rows of each query within ``limit``, nearest first."""
        step = max(1, BLOCK // max(len(self.low), self.x.shape[1]))
        for start in range(0, len(q), step):
            part, most = q[start : start + step], limit[start : start + step] ** 2
            boxes = self._to_boxes(part)
            near = self._to_rows(part, boxes.argmin(axis=1))
            most = np.minimum(most, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
            hit = boxes <= most[:, None] * (1 + 1e-9)
            ends = np.cumsum(hit.sum(axis=1)) * self.x.shape[1]
            first = 0
            while first < len(part):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
                at, block = np.nonzero(hit[first:last])
                at += first
                d2 = self._to_rows(part[at], block)
                pair, slot = np.nonzero((d2 <= most[at, None]) & np.isfinite(d2))
                asks, rows, d2 = at[pair], self.row[block[pair], slot], d2[pair, slot]
                order = np.lexsort((rows, d2, asks))
                asks, rows, d2 = asks[order], rows[order], d2[order]
                nth = np.arange(len(asks)) - np.searchsorted(asks, asks)
                kept = nth < self.k
                yield asks[kept] + start, rows[kept], d2[kept]
                first = last


def _ranked(have: pd.DataFrame, key: str, target: str) -> pd.DataFrame:
    """Smaller keys first, so that the order of rows breaks ties."""
    return have.sort_values([key, target], kind="stable")


def nearest(
    train: DataFrame,
    queries: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    k: int,
    pivots: int | None = None,
) -> DataFrame:
    """The ``k`` nearest training rows of each query as ``(key, d2, other, target)``; ties go to the smaller key.

    Training rows with a null feature or target and queries with a null feature take no part.
    """
    types = {n: train.schema[n].dataType.simpleString() for n in (key, target)}
    train = train.select(key, *features, target).dropna(subset=[key, *features, target])
    queries = queries.select(key, *features).dropna(subset=list(features))
    empty = f"`{key}` {types[key]}, d2 double, other {types[key]}, `{target}` double"
    pivots = pivots or pivot_count(train.count())
    picked = train.orderBy(hash_unit(key, 0), key).select(*features).limit(pivots).collect()
    if not picked:
        return train.sparkSession.createDataFrame([], empty)
    centres = np.unique(np.array([tuple(r) for r in picked], dtype="float64"), axis=0)
    cells = cut_lineage(assign_cells(train, features, centres))
    summary = cell_summary(cells, key, k)
    cuts = radius_cuts(cells, summary)
    names = list(features)
    at = ["cell", "slice"]
    by = [*at, "chunk", "qchunk"]
    rows = slice_rows(cells, cuts)

    def part(count: str):
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def meet(visits: DataFrame, whole: bool):
        """Rows and visits in groups of bounded size; a visit meets all chunks of its slice, or one of them."""
        sizes = visits.groupBy(*at).agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("groups"))
        if cuts:
            parts = cells.sparkSession.createDataFrame([(int(c), int(n)) for c, (_, n) in cuts.items()], "cell int, parts int")
            sizes = sizes.join(parts, "cell", "left")
        else:
            sizes = sizes.withColumn("parts", F.lit(1))
        sizes = cut_lineage(sizes.withColumn("parts", F.coalesce("parts", F.lit(1))))
        left = rows.join(sizes, at)
        left = left.withColumn("chunk", part("parts")).withColumn("qchunk", each("groups")).drop("parts", "groups")
        right = visits.join(sizes, at).withColumn("qchunk", part("groups"))
        right = right.withColumn("chunk", each("parts") if whole else part("parts")).drop("parts", "groups")
        return left.groupBy(*by).cogroup(right.groupBy(*by))

    asked = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes)

    def reach(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        """Queries with the distance within which the group has ``k`` rows."""
        bound = np.full(len(ask), np.inf)
        if len(have) and len(ask):
            blocks = Blocks(_matrix(have, names), k)
            for q, _, d2 in blocks.search(_matrix(ask, names), bound):
                last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
                bound[q[last]] = np.sqrt(d2[last]) * (1 + 1e-9) + 1e-9
        return ask[[key, *names]].assign(_bound=bound)

    def search(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(have) and len(ask):
            have = _ranked(have, key, target)
            ids, y = have[key].to_numpy(), have[target].to_numpy(dtype="float64")
            own = ask[key].to_numpy()
            blocks = Blocks(_matrix(have, names), k)
            for q, n, d2 in blocks.search(_matrix(ask, names), ask["bound"].to_numpy()):
                out.append(pd.DataFrame({key: own[q], "d2": d2, "other": ids[n], target: y[n]}))
        return pd.concat(out) if out else pd.DataFrame({key: [], "d2": [], "other": [], target: []})

    homes = assign_cells(queries, features, centres).withColumnRenamed("radius", "to_pivot").withColumn("bound", F.lit(0.0))
    bounded = meet(cut_lineage(slice_visits(homes, cuts)), False).applyInPandas(reach, f"{asked}, _bound double")
    visits = cut_lineage(slice_visits(visit_plan(bounded, features, centres, summary, k, "_bound"), cuts))
    found = meet(visits, True).applyInPandas(search, empty)
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "other", target))), 1, k)
    return found.groupBy(key).agg(best.alias("_near")).select(key, F.inline("_near"))


def knn_regress(
    train: DataFrame,
    queries: DataFrame,
    key: str,
    features: Sequence[str],
    target: str,
    k: int = 9,
    pivots: int | None = None,
) -> DataFrame:
    """Mean target of the ``k`` nearest rows, weighted by 1/distance; exact hits outweigh all others.

    Every query has a row; it is null if a feature is null or there is nothing to learn from.
    """
    rows = nearest(train, queries, key, features, target, k, pivots)
    weight = 1 / F.sqrt(F.nullif(F.col("d2"), F.lit(0.0)))
    exact = F.avg(F.when(F.col("d2") == 0, F.col(target)))
    mean = rows.groupBy(key).agg(F.coalesce(exact, F.try_divide(F.sum(weight * F.col(target)), F.sum(weight))).alias(target))
    return queries.select(key).join(mean, key, "left")
