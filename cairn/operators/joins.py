"""Joins: dimensions, statistics, membership, alignment of prediction sets.

Sides are left to Catalyst, which broadcasts a side only below its own size limit and otherwise
shuffles; AQE then splits skewed partitions of plain scans. What AQE does not split is a join against
an aggregate on the same key, so :func:`attach` salts the few hot keys itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from cairn.sources.scratch import cut_lineage

SALTS = 64
HOT_ROWS = 10_000_000  # a table of 10**12 rows has at most 100,000 keys above this


def join_dimension(fact: DataFrame, dimension: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner equi-join of a fact with a dimension."""
    return fact.join(dimension, on)


def hot_keys(stats: DataFrame, on: Sequence[str], rows: str, floor: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``floor`` rows behind them; their number is below total rows / ``floor``."""
    return stats.filter(F.col(rows) > floor).select(*on)


def attach(
    rows: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    count: str,
    keep: Sequence[str],
    floor: int = HOT_ROWS,
) -> DataFrame:
    """Left-join one-row-per-key ``stats`` to ``rows``; ``count`` holds the rows behind each key.

    The statistics are computed once and written. If a key has more than ``floor`` rows, rows of such keys are
    spread over ``SALTS`` partitions and only those keys' statistics are copied; else it is a plain join.
    """
    return attach_written(rows, cut_lineage(stats), on, count, keep, floor)


def attach_written(
    rows: DataFrame,
    stats: DataFrame,
    on: Sequence[str],
    count: str,
    keep: Sequence[str],
    floor: int = HOT_ROWS,
    most: int | None = None,
) -> DataFrame:
    """:func:`attach` for statistics that are a written table; ``most`` is the greatest count if it is known."""
    on = list(on)
    if most is None:
        most = stats.agg(F.max(count)).first()[0] or 0
    if most <= floor:
        return rows.join(stats.select(*on, *keep), on, "left").select(*rows.columns, *keep)
    hot = F.broadcast(hot_keys(stats, on, count, floor).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    left = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)))
    copies = F.when(F.col(count) > floor, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    right = stats.withColumn("_salt", F.explode(copies)).select(*on, "_salt", *keep)
    return left.join(right, [*on, "_salt"], "left").select(*rows.columns, *keep)


def members(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``ids``."""
    return df.join(ids, on, "left_semi")


def non_members(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``ids``."""
    return df.join(ids, on, "left_anti")


def align_predictions(long: DataFrame, key: str, model: str, value: str, models: Sequence[str]) -> DataFrame:
    """One row per key with one column per named model."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models])


