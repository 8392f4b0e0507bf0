"""Approximate nearest neighbours by cosine: inverted lists and an adaptive scan of the dimensions.

Unit vectors are rotated by a random orthogonal matrix, so that any first dimensions are a fair
sample of all. Centroids from a bounded sample part them into lists; a query probes the lists of the
nearest centroids. Within a list, distances grow by blocks of columns: after each block a hypothesis
test compares the scaled partial distance with the query's current k-th distance and abandons
candidates that are almost surely farther. What remains is scored exactly on the original vectors.

The number of lists to probe is read off the sample: enough to hold ``WANTED`` of its true neighbours.
Every valid vector is indexed. Lists and the queries that probe them are cut into blocks of bounded
size, each pair of blocks is one group, so neither a common vector nor a popular list is one task's.

Edge cases: vectors that are null or zero, hold null or non-finite components, have no id, or differ
in length from the most common length (ties: the shorter) take no part. Rows that repeat id and
vector count once. Ties go to the smaller id. With fewer candidates than ``k`` all are returned; a
query goes on probing until the lists hold enough. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage

#: Bounds of the fit: sampled vectors, lists, sampled queries.
SAMPLE_ROWS = 20_000
LISTS = 1024
SAMPLE_QUERIES = 400
WANTED = 0.97
COLUMNS = 16
#: Of the hypothesis test: a candidate goes if its scaled distance exceeds the k-th by 1 + EPSILON / sqrt(d).
EPSILON = 2.1
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def rotate(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ self.rotation


def _closeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance less the square of ``a``."""
    return (b * b).sum(1) - 2 * a @ b.T


def fit_index(sample: np.ndarray, rows: int, k: int, seed: int = 3) -> Index:
    """Rotation, centroids and number of probes from sampled vectors; ``rows`` is the whole number."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    rotation, _ = np.linalg.qr(rng.standard_normal((size, size)))
    unit = Index(rotation, sample, 1).rotate(sample)
    lists = int(min(LISTS, max(1, round(rows**0.5)), max(1, len(unit) // 8)))
    centroids = unit[rng.choice(len(unit), lists, replace=False)]
    for _ in range(10):
        own = _closeness(unit, centroids).argmin(1)
        count = np.bincount(own, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, own, unit)
        centroids = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centroids)
    own = _closeness(unit, centroids).argmin(1)
    asked = rng.choice(len(unit), min(SAMPLE_QUERIES, len(unit)), replace=False)
    near = _closeness(unit[asked], unit)
    near[np.arange(len(asked)), asked] = np.inf
    found = np.argsort(near, axis=1)[:, : min(k, len(unit) - 1)]
    place = np.argsort(np.argsort(_closeness(unit[asked], centroids), axis=1), axis=1)
    ranks = np.sort(np.take_along_axis(place, own[found], axis=1).ravel())
    probes = 1 + (int(ranks[int(WANTED * (len(ranks) - 1))]) if len(ranks) else 0)
    return Index(rotation, centroids, probes)


def scan(query: np.ndarray, own: int, ids: np.ndarray, rotated: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of all candidates that may be among the ``k`` nearest, by the adaptive scan."""
    size = rotated.shape[1]
    kept, best = [], np.zeros(0)
    limit = np.inf
    for at in range(0, len(ids), 512):
        rows = np.arange(at, min(at + 512, len(ids)))
        rows = rows[ids[rows] != own]
        partial = np.zeros(len(rows))
        for d in range(0, size, COLUMNS):
            stop = min(d + COLUMNS, size)
            partial = partial + ((rotated[rows, d:stop] - query[d:stop]) ** 2).sum(1)
            if np.isfinite(limit) and stop < size:
                near = partial * (size / stop) <= limit * (1 + EPSILON / stop**0.5) ** 2
                rows, partial = rows[near], partial[near]
        kept.append((rows, partial))
        best = np.sort(np.r_[best, partial])[:k]
        if len(best) == k:
            limit = best[-1] + 1e-9
    rows = np.concatenate([r for r, _ in kept]) if kept else np.zeros(0, int)
    partial = np.concatenate([p for _, p in kept]) if kept else np.zeros(0)
    return rows[partial <= limit]


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision; a row's value doesn't depend on the other rows."""
    dots = (vectors * query).sum(1)
    return dots / (np.sqrt((vectors * vectors).sum(1)) * np.sqrt((query * query).sum()))


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def valid_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part, components as doubles."""
    vector = F.col(embedding).cast("array<double>")

    def fine(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return (
        df.select(F.col(vec_id).cast("long").alias("vec_id"), vector.alias("vector"))
        .filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .filter(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
        .dropDuplicates(["vec_id", "vector"])
    )


def nearest(df: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row where ``queries`` holds.

    ``queries`` is a condition on the column vec_id.
    """
    vectors = cut_lineage(valid_vectors(df, vec_id, embedding))
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    common = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return df.sparkSession.createDataFrame([], empty)
    size, rows = common["n"], common["count"]
    vectors = vectors.filter(F.size("vector") == size)
    drawn = F.xxhash64("vec_id", F.lit(5)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    sample = vectors.filter(drawn < SAMPLE_ROWS / rows).select("vec_id", "vector").limit(2 * SAMPLE_ROWS).toArrow()
    if not sample.num_rows:
        sample = vectors.limit(SAMPLE_ROWS).toArrow()
    order = np.argsort(sample["vec_id"].to_numpy(), kind="stable")
    matrix = sample["vector"].combine_chunks().values.to_numpy().reshape(-1, size)
    index = fit_index(matrix[order], rows, k)
    sent = df.sparkSession.sparkContext.broadcast((index.rotation, index.centroids, index.probes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(1).flatten().to_numpy().reshape(-1, size)
                turned = index.rotate(vectors)
                own = _closeness(turned, index.centroids).argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(own, pa.int32()),
                        pa.array([x.tobytes() for x in turned], pa.binary()),
                        pa.array([x.tobytes() for x in np.ascontiguousarray(vectors)], pa.binary()),
                    ],
                    names=["vec_id", "list", "turned", "vector"],
                )

    listed = cut_lineage(
        vectors.mapInArrow(place, "vec_id bigint, list int, turned binary, vector binary")
    )
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    sent_sizes = df.sparkSession.sparkContext.broadcast(sizes)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sizes = Index(*sent.value), sent_sizes.value
        for batch in batches:
            if batch.num_rows:
                near = np.argsort(_closeness(_matrix(batch.column(1)), index.centroids), axis=1, kind="stable")
                held = np.cumsum(sizes[near], axis=1)
                probes = np.maximum(index.probes, 1 + (held < k + 1).sum(1))
                lists = [x[:p].astype(np.int32) for x, p in zip(near, probes)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lists, pa.list_(pa.int32()))],
                    names=["query_id", "turned", "vector", "lists"],
                )

    asked = (
        listed.filter(queries)
        .select(F.col("vec_id").alias("query_id"), "turned", "vector")
        .mapInArrow(probe, "query_id bigint, turned binary, vector binary, lists array<int>")
    )
    probed = cut_lineage(asked.select("query_id", "turned", "vector", F.explode("lists").alias("list")))
    counts = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("parts"))
    counts = counts.join(
        probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("groups")), "list"
    )

    counts = F.broadcast(cut_lineage(counts))  # one row a list, of which there are at most LISTS

    def part(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(9)), F.col(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    vectors_in = listed.join(counts, "list").select(
        "list", part("vec_id", "parts").alias("part"), every("groups").alias("group"), "vec_id", "turned", "vector"
    )
    queries_in = probed.join(counts, "list").select(
        "list", every("parts").alias("part"), part("query_id", "groups").alias("group"), "query_id", "turned", "vector"
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = left["vec_id"].to_numpy()
            turned, whole = (_matrix(left[c].combine_chunks()) for c in ("turned", "vector"))
            q_turned, q_whole = (_matrix(right[c].combine_chunks()) for c in ("turned", "vector"))
            for q, own in enumerate(right["query_id"].to_numpy()):
                rows = scan(q_turned[q], own, ids, turned, k)
                score = cosines(q_whole[q], whole[rows])
                top = np.lexsort((ids[rows], -score))[:k]
                out["query_id"].append(np.full(len(top), own))
                out["vec_id"].append(ids[rows][top])
                out["score"].append(score[top])
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table(
            {
                "query_id": cat(out["query_id"], pa.int64()),
                "vec_id": cat(out["vec_id"], pa.int64()),
                "score": cat(out["score"], pa.float64()),
            }
        )

    keys = ("list", "part", "group")
    found = (
        vectors_in.groupBy(*keys)
        .cogroup(queries_in.groupBy(*keys))
        .applyInArrow(search, "query_id bigint, vec_id bigint, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op10_adaptive_scan(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
