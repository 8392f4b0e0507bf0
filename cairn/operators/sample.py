"""Splits, folds, caps and bootstraps as deterministic hashes of a row key.

A row's fate depends on its key and the seed only, so results do not change with partitioning or when
an executor is lost.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions.columns import hash_unit
from cairn.operators.joins import attach
from cairn.operators.ordering import BUCKETS, fit_row, keyed_as, met, order_bucket, positions, smallest_per_group
from cairn.sources.scratch import cut_lineage

SLOTS = 8  # slices of the hash for each draw of a class


def split_holdout(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``is_test`` = 1 for the given fraction of keys."""
    return df.withColumn("is_test", (hash_unit(key, seed) < fraction).cast("int"))


def split_shuffle(df: DataFrame, key: str, rounds: int, fraction: float, seed: int) -> DataFrame:
    """``rounds`` independent hold-out splits, one row per key and round."""
    iters = F.explode(F.sequence(F.lit(1), F.lit(rounds)))
    return df.withColumn("iter", iters).withColumn(
        "is_test", (hash_unit(key, seed, F.col("iter")) < fraction).cast("int")
    )


def split_kfold(df: DataFrame, key: str, folds: int) -> DataFrame:
    """Contiguous folds by key order; the first ``n % folds`` folds hold one row more."""
    small, extra = divmod(df.count(), folds)
    pos, head = F.col("pos"), extra * (small + 1)
    fold = F.when(pos < head, F.floor(pos / (small + 1))).otherwise(extra + F.floor((pos - head) / max(small, 1)))
    return positions(df, [key], order_bucket(df, key)).withColumn("fold", fold.cast("int"))


def cap_per_class(df: DataFrame, label: str, key: Sequence[str], cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each class, chosen by hash; smaller classes stay whole."""
    scored = df.withColumn("_h", hash_unit(*key, seed))
    return smallest_per_group(scored, [label], "_h", key, cap).drop("_h")


def one_per_group(df: DataFrame, group: str, seed: int) -> DataFrame:
    """One row per group, chosen by the hash of the whole row; partial aggregation keeps it skew-safe."""
    rest = [c for c in df.columns if c != group]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]
    rank = F.struct(hash_unit(F.col(group), *text, seed).alias("h"), F.concat_ws("|", *text).alias("t"))
    return df.groupBy(group).agg(F.min_by(F.struct(*rest), rank).alias("_row")).select(group, "_row.*")


def poisson_steps() -> list[float]:
    """Distribution of Poisson(1) at 0, 1, ... as far as a uniform number of 52 bits can tell."""
    steps = [exp(-1.0)]
    while steps[-1] < 1.0 - 2.0**-52:
        steps.append(steps[-1] + exp(-1.0) / factorial(len(steps)))
        if steps[-1] == steps[-2]:
            break
    return [s for s in steps if s < 1.0]


def _poisson_counts(u: Column) -> Column:
    """Poisson(1) quantile of a uniform number."""
    out = F.lit(0)
    for k, below in enumerate(poisson_steps()):
        out = F.when(u >= below, F.lit(k + 1)).otherwise(out)
    return out


def bootstrap_counts(df: DataFrame, key: str, replicate: int | Column) -> DataFrame:
    """Bootstrap multiplicity ``draws`` of each row; 0 means out of bag."""
    u = hash_unit(F.col(key), replicate if isinstance(replicate, Column) else F.lit(replicate))
    return df.withColumn("_u", u).withColumn("draws", _poisson_counts(F.col("_u"))).drop("_u")


def bootstrap(df: DataFrame, key: str, replicates: int) -> DataFrame:
    """``replicates`` bootstraps at once, one row per key and replicate."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return bootstrap_counts(reps, key, F.col("rep"))


def draw_with_replacement(df: DataFrame, label: str, key: str, draws: int, seed: int) -> DataFrame:
    """``draws`` rows with replacement from each class; classes with fewer rows are kept whole.

    A draw is a rank in the order of the rows' hashes. Rows are counted by slices of the hash, about ``SLOTS`` a draw;
    running counts tell the slice of each draw, and only rows of such slices are numbered, inside their slice.
    Spark may take those rows for far fewer than they are (after an ``explode``), so they meet the draws by a merge and
    are never collected and broadcast.
    """
    slots = 1 << (draws * SLOTS - 1).bit_length()
    scored = df.withColumn("_h", hash_unit(key, seed)).withColumn("_slot", F.floor(F.col("_h") * slots).cast("int"))
    of_class = W.partitionBy(label)
    counts = cut_lineage(
        scored.groupBy(label, "_slot")
        .agg(F.count("*").alias("_in"))
        .withColumn("_n", F.sum("_in").over(of_class))
        .withColumn("_pos", F.sum("_in").over(of_class.orderBy("_slot")) - F.col("_in"))
    )
    sizes = counts.select(label, "_n").distinct()
    wanted = F.when(F.col("_n") >= draws, F.lit(draws)).otherwise(F.col("_n"))
    plan = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("bigint"), wanted - 1)))
    at = F.floor(hash_unit(F.col(label), F.col("draw"), seed) * F.col("_n"))
    plan = plan.withColumn("_pos", F.when(F.col("_n") >= draws, at).otherwise(F.col("draw")))
    # Draws and first ranks of the slices in one order: a draw lies in the last slice that starts at or before it.
    none = F.lit(None).cast("bigint")
    line = counts.select(label, "_pos", "_slot", F.col("_pos").alias("_start"), none.alias("draw")).unionByName(
        plan.select(label, "_pos", none.cast("int").alias("_slot"), none.alias("_start"), "draw")
    )
    behind = of_class.orderBy("_pos", F.col("draw").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = cut_lineage(
        line.withColumns({c: F.last(c, True).over(behind) for c in ("_slot", "_start")})
        .filter(F.col("draw").isNotNull())
        .select(label, "_slot", (F.col("_pos") - F.col("_start")).cast("int").alias("_at"), "draw")
    )
    hit = keyed_as(placed.select(label, "_slot").distinct(), [label, "_slot"])
    inside = W.partitionBy(label, "_slot").orderBy("_h", key)
    near = scored.join(hit, met([label, "_slot"]), "left_semi").withColumn("_at", F.row_number().over(inside) - 1)
    group = [label, "_slot", "_at"]
    return near.hint("merge").join(keyed_as(placed, group), met(group)).select(*df.columns, "draw")


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Random order as a column: ``pos`` is the row's place after the shuffle."""
    scored = df.withColumn("_h", hash_unit(key, seed))
    slot = F.floor(F.col("_h") * BUCKETS).cast("int")
    return positions(scored, ["_h", key], slot).drop("_h")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n / (k * n_class)`` of each class, with its size."""
    sizes = df.groupBy(label).agg(F.count("*").alias("n_rows"))
    total = fit_row(sizes, {"n": F.sum("n_rows"), "k": F.count("*")})
    return sizes.withColumn("weight", F.lit(total["n"]) / (F.col("n_rows") * total["k"]))


def weigh_classes(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return attach(df, class_weights(df, label).withColumnRenamed("weight", name), [label], "n_rows", [name])
