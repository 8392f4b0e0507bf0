"""Scores of prediction tables as distributed aggregates; each returns one row per group.

``by`` lists grouping columns (a model name, a fold); with an empty list there is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions.columns import clip, ratio
from cairn.operators.ordering import keyed_as, met
from cairn.operators.selection import BELOW, FINE, log_band, top_bits, with_order_key
from cairn.sources.scratch import cut_lineage


def _score(df: DataFrame, by: Sequence[str], name: str, value: Column) -> DataFrame:
    return df.groupBy(*by).agg(value.alias(name))


def relative_error(y: Column, p: Column) -> Column:
    return ratio(y - p, y)


def rmspe(df: DataFrame, y: str, p: str, by: Sequence[str] = (), log: bool = False) -> DataFrame:
    """Root mean squared relative error; ``log`` takes columns in log1p space. Zero targets are left out."""
    a, b = (F.expm1(c) if log else F.col(c) for c in (y, p))
    return _score(df, by, "rmspe", F.sqrt(F.avg(F.pow(relative_error(a, b), 2))))


def accuracy(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _score(df, by, "accuracy", F.avg((F.col(y) == F.col(p)).cast("double")))


def mae(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return _score(df, by, "mae", F.avg(F.abs(F.col(y) - F.col(p))))


def r2(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """1 - residual sum / total sum; the total sum is the count times the population variance."""
    residual = F.sum(F.pow(F.col(y) - F.col(p), 2))
    return _score(df, by, "r2", 1 - F.try_divide(residual, F.var_pop(y) * F.count(y)))


def confusion(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, y, p).agg(F.count("*").alias("n"))


def log_loss(
    df: DataFrame, key: Sequence[str], y: str, label: str, p: str, by: Sequence[str] = (), eps: float = 1e-15
) -> DataFrame:
    """Multi-class log loss of a long probability table; each row's probabilities are normalised."""
    rows = df.groupBy(*key, *by).agg(
        F.sum(F.when(F.col(label) == F.col(y), F.col(p))).alias("_hit"), F.sum(p).alias("_all")
    )
    hit = clip(F.coalesce(ratio(F.col("_hit"), F.col("_all")), F.lit(0.0)), eps)
    return _score(rows, by, "log_loss", -F.avg(F.ln(hit)))


def binary_log_loss(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    q, t = clip(F.col(p), eps), F.col(y)
    return _score(df, by, "log_loss", -F.avg(t * F.ln(q) + (1 - t) * F.ln(1 - q)))


def roc_auc(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve by ranks, ties counted half; ``y`` is 0/1 and rows without a score are left out.

    A partial aggregate counts both classes in bands of the score's logarithm. A band with one score or one class
    adds its part of the area at once; only rows of other bands are counted again, by the bits of an ordered integer.
    """
    by = list(by)
    scores = df.filter(F.col(p).isNotNull()).select(*by, F.col(y).alias("_y"), F.col(p).cast("double").alias("_p"))
    group, parts, rows = by, [], scores
    places = [lambda df: df.withColumn("_place", log_band("_p", FINE))] + [
        lambda df, below=below: with_order_key(df, "_p", "_key").withColumn("_place", top_bits(F.col("_key"), below))
        for below in BELOW
    ]
    for at, place in enumerate(places):
        bands = place(rows).groupBy(*group, "_place").agg(
            F.sum("_y").cast("double").alias("_pos"),
            F.sum(1 - F.col("_y")).cast("double").alias("_neg"),
            F.min("_p").alias("_lo"),
            F.max("_p").alias("_hi"),
        )
        before = W.partitionBy(*group).orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
        mixed = (F.col("_lo") < F.col("_hi")) & (F.col("_pos") > 0) & (F.col("_neg") > 0)
        area = F.col("_pos") * (F.col("_below") + F.when(F.col("_open"), 0).otherwise(F.col("_neg") / 2))
        bands = cut_lineage(
            bands.withColumn("_below", F.coalesce(F.sum("_neg").over(before), F.lit(0.0)))
            .withColumn("_open", mixed)
            .select(*by, "_place", "_open", area.alias("_area"), *[F.lit(0.0).alias(c) if at else F.col(c) for c in ("_pos", "_neg")])
        )
        parts.append(bands.drop("_place", "_open"))
        left = bands.filter("_open").select(*by, "_place")
        if place is places[-1] or left.isEmpty():
            break
        group = [*by, "_band"]
        left = keyed_as(left.withColumnRenamed("_place", "_band"), group)
        rows = place(scores).withColumnRenamed("_place", "_band").join(left, met(group), "left_semi")
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    return _score(every, by, "auc", F.try_divide(F.sum("_area"), F.sum("_pos") * F.sum("_neg")))


def jaccard(
    df: DataFrame, y: str, p: str, label: str, by: Sequence[str] = (), smooth: float = 1e-12
) -> DataFrame:
    """Per-class overlap of two 0/1 columns and its mean over the classes, per group."""
    both = F.sum(F.col(y) * F.col(p)).cast("double")
    either = F.sum(F.col(y) + F.col(p)).cast("double") - both
    per_class = df.groupBy(*by, label).agg(((both + smooth) / (either + smooth)).alias("jaccard"))
    return per_class.groupBy(*by).agg(F.avg("jaccard").alias("jaccard"), F.count("*").alias("classes"))
