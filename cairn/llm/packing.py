"""Packing by optimal length buckets: boundaries from a dynamic programme over the length histogram.

The histogram counts every length of all documents; different lengths are no more than the root of twice the
corpus's words. The programme picks the boundaries with the least padding for a given number of buckets. Padding obeys
the quadrangle inequality, so the best last boundary never moves back as lengths grow, and a layer of
the programme is searched by halves instead of all pairs.
Within a bucket, documents get positions by slices of a hash: slice counts add up to offsets, exact
order is needed inside a slice only. Positions divided by the batch size give the batches, so every
batch but a bucket's last is full and its padded length stays within the token budget.

Edge cases: a null or empty text has length zero and takes one place in the shortest bucket. A
document longer than the budget is a batch of its own. Rows that repeat id and length are counted
before they are placed and share one order. A null ``doc_id`` is a value like any other. An empty
table gives an empty table. The input needs two columns, others may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import table, words
from cairn.sources.scratch import cut_lineage

BUCKETS = 16
BUDGET = 16_384
SLICE_ROWS = 50_000
CHUNK_COPIES = 10_000


def _layer(spent: np.ndarray, cost, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Least padding of one bucket more up to each length from ``first``, and where the last bucket begins.

    Middles of ranges of lengths are searched, all ranges of a depth at once; the best begin of a middle bounds those
    of both halves.
    """
    n = len(spent)
    least, begin = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)
    lo, hi, from_, to = (np.array([x]) for x in (first, n - 1, first, n - 1))
    while len(lo):
        mid = (lo + hi) // 2
        sizes = np.minimum(to, mid) - from_ + 1
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(from_ - starts, sizes) + np.arange(sizes.sum())
        values = spent[at - 1] + cost(at, np.repeat(mid, sizes))
        best = np.minimum.reduceat(values, starts)
        hits = np.flatnonzero(values == np.repeat(best, sizes))
        owner = np.searchsorted(starts, hits, side="right") - 1
        chosen = at[hits[np.unique(owner, return_index=True)[1]]]
        least[mid], begin[mid] = best, chosen
        left, right = lo < mid, mid < hi
        lo, hi, from_, to = (
            np.concatenate(x)
            for x in (
                (lo[left], mid[right] + 1),
                (mid[left] - 1, hi[right]),
                (from_[left], chosen[right]),
                (chosen[left], to[right]),
            )
        )
    return least, begin


def best_boundaries(length: np.ndarray, count: np.ndarray, buckets: int) -> list[int]:
    """Largest lengths of at most ``buckets`` buckets with the least padding.

    ``length`` ascends. Ties go to fewer buckets, then to the earliest boundaries.
    """
    n = len(length)
    if not n:
        return []
    counts, totals = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(length * count)]

    def cost(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Padding of one bucket of the lengths first..last."""
        return length[last] * (counts[last + 1] - counts[first]) - (totals[last + 1] - totals[first])

    spent = cost(np.zeros(n, np.int64), np.arange(n))
    choices, least = [np.zeros(n, np.int64)], [int(spent[-1])]
    for b in range(1, min(buckets, n)):
        spent, choice = _layer(spent, cost, b)
        choices.append(choice)
        least.append(int(spent[-1]))
    b, j, found = int(np.argmin(least)), n - 1, []
    while True:
        found.append(int(length[j]))
        if b == 0:
            return found[::-1]
        j = int(choices[b][j]) - 1
        b -= 1


def pack(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, slot, padding) of each (doc_id, n_tokens).

    ``batch`` counts within the bucket.
    """
    groups = cut_lineage(lengths.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")))
    histogram = groups.groupBy("n_tokens").agg(F.sum("copies").alias("n"), F.count("*").alias("groups")).toArrow()
    length, count, sizes = (histogram[c].to_numpy() for c in ("n_tokens", "n", "groups"))
    order = np.argsort(length)
    bounds = best_boundaries(length[order], count[order], buckets)
    slices = int(max(1, -(-int(sizes.sum()) // SLICE_ROWS)))
    ends = F.array(*[F.lit(x).cast("long") for x in bounds or [0]])
    placed = (
        groups.withColumn("bucket", F.size(F.filter(ends, lambda e: e < F.col("n_tokens"))))
        .withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slices)))
    )
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("bucket", "slice")
        .agg(F.sum("copies").alias("n"))
        .select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    ahead = (
        Window.partitionBy("bucket", "slice")
        .orderBy("doc_id", "n_tokens")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    first = placed.withColumn("ahead", F.coalesce(F.sum("copies").over(ahead), F.lit(0))).join(
        offsets, ["bucket", "slice"]
    )
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK_COPIES))
    spread = (
        first.select("*", F.explode(chunks).alias("chunk"))
        .repartition("doc_id", "n_tokens", "chunk")
        .withColumn(
            "copy",
            F.explode(
                F.sequence(
                    F.col("chunk") * CHUNK_COPIES,
                    F.least((F.col("chunk") + 1) * CHUNK_COPIES, F.col("copies")) - 1,
                )
            ),
        )
    )
    size = ends[F.col("bucket")]
    at = F.col("offset") + F.col("ahead") + F.col("copy")
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(size, F.lit(1))))
    return spread.select(
        "doc_id",
        "n_tokens",
        "bucket",
        size.alias("bucket_length"),
        F.floor(at / per_batch).alias("batch"),
        F.pmod(at, per_batch).alias("slot"),
        (size - F.col("n_tokens")).alias("padding"),
    )


def word_lengths(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(
        F.col(doc_id).alias("doc_id"), F.size(words(F.col(text))).cast("long").alias("n_tokens")
    )


def op2_length_buckets(spark, sf_dir: str) -> DataFrame:
    return pack(word_lengths(table(spark, sf_dir, "documents")))
