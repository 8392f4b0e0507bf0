"""Ensembles of predictions held as long tables ``(key, model, value)``."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.ordering import fit_row
from cairn.sources.scratch import cut_lineage


def _weight(model: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, w in weights.items():
        out = F.when(F.col(model) == name, F.lit(float(w))).otherwise(out)
    return out


def blend_equal(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias(value))


def blend_weighted(
    df: DataFrame, key: str, model: str, value: str, weights: Mapping[str, float], log: bool = False
) -> DataFrame:
    """Weighted sum over named models; with ``log`` the sum is taken of log1p values and left in log space."""
    v = F.log1p(value) if log else F.col(value)
    return df.filter(F.col(model).isin(*weights)).groupBy(key).agg(F.sum(_weight(model, weights) * v).alias(value))


def blend_geometric(df: DataFrame, key: Sequence[str], p: str) -> DataFrame:
    """Geometric mean over the models; zero if any model gives zero."""
    mean = F.exp(F.avg(F.when(F.col(p) > 0, F.ln(p))))
    return df.groupBy(*key).agg(F.when(F.min(p) <= 0, F.lit(0.0)).otherwise(mean).alias(p))


def simplex_grid(models: int, steps: int) -> list[tuple[float, ...]]:
    """All weight vectors that sum to 1 on a regular grid."""

    def parts(left: int, n: int):
        if n == 1:
            yield (left,)
            return
        for i in range(left + 1):
            for rest in parts(left - i, n - 1):
                yield (i, *rest)

    return [tuple(i / steps for i in w) for w in parts(steps, models)]


def model_columns(df: DataFrame, key: str, model: str, p_true: str, models: Sequence[str]) -> DataFrame:
    """One row per key with the true-class probability of each model as ``_p0, _p1, ...``."""
    return df.groupBy(key).agg(
        *[F.max(F.when(F.col(model) == m, F.col(p_true))).alias(f"_p{i}") for i, m in enumerate(models)]
    )


def weight_losses(
    df: DataFrame, key: str, model: str, p_true: str, models: Sequence[str], steps: int = 20, eps: float = 1e-15
) -> DataFrame:
    """Log loss of every grid weighting of the models' true-class probabilities.

    A batch of rows meets the grid as a product of two matrices; a task gives one row per weighting. Rows
    that a model doesn't cover are left out of the means.
    """
    names = [f"w{i}" for i in range(len(models))]
    grid = simplex_grid(len(models), steps)
    wide = model_columns(df, key, model, p_true, models).drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(grid)
        total, count = np.zeros(len(grid)), 0
        for batch in batches:
            p = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            p = p[~np.isnan(p).any(axis=1)]
            for at in range(0, len(p), 4096):
                mix = np.clip(p[at : at + 4096] @ weights.T, eps, 1 - eps)
                total -= np.log(mix).sum(axis=0)
            count += len(p)
        columns = [*weights.T, total, np.full(len(grid), count)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*names, "_loss", "_n"])

    schema = ", ".join(f"{n} double" for n in [*names, "_loss"]) + ", _n bigint"
    parts = wide.mapInArrow(run, schema)
    return parts.groupBy(*names).agg(F.try_divide(F.sum("_loss"), F.sum("_n")).alias("log_loss"))


def _simplex_step(gradient: np.ndarray, curvature: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Step to the least value of the quadratic model over the simplex, by active sets of the few weights."""
    best, step = 0.0, np.zeros_like(at)
    for mask in range(1, 1 << len(at)):
        free = np.array([mask >> i & 1 for i in range(len(at))], bool)
        fixed = np.where(free, 0.0, -at)
        n = int(free.sum())
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = curvature[np.ix_(free, free)]
        system[:n, n] = system[n, :n] = 1.0
        right = np.r_[-(gradient + curvature @ fixed)[free], -fixed.sum()]
        move = fixed.copy()
        move[free] = np.linalg.lstsq(system, right, rcond=None)[0][:n]
        if (at + move >= -1e-12).all() and abs(move.sum()) < 1e-9:
            value = gradient @ move + move @ curvature @ move / 2
            if value < best:
                best, step = value, move
    return step


def mixture_weights(
    df: DataFrame, key: str, model: str, p_true: str, models: Sequence[str], passes: int = 50, tolerance: float = 1e-7
) -> list[float]:
    """Weights on the simplex with the least log loss of the mixed true-class probabilities.

    The loss is convex. Each pass is one small aggregate over a written table that gives the loss, its
    gradient and its second derivatives; a Newton step over the simplex follows, halved while the
    loss doesn't fall. Keys that a model doesn't cover are left out.
    """
    m = len(models)
    wide = cut_lineage(model_columns(df, key, model, p_true, models).drop(key).na.drop())

    def measured(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mix = sum((F.lit(float(w)) * F.col(f"_p{i}") for i, w in enumerate(weights)), F.lit(0.0))
        share = [F.try_divide(F.col(f"_p{i}"), F.col("_mix")) for i in range(m)]
        exprs = {"loss": -F.avg(F.ln(F.greatest("_mix", F.lit(1e-300))))}
        exprs |= {f"g{i}": -F.avg(share[i]) for i in range(m)}
        exprs |= {f"h{i}_{j}": F.avg(share[i] * share[j]) for i in range(m) for j in range(i + 1)}
        row = fit_row(wide.withColumn("_mix", mix), exprs)
        if row["loss"] is None:
            return 0.0, np.zeros(m), np.eye(m)
        second = np.array([[row[f"h{max(i, j)}_{min(i, j)}"] or 0.0 for j in range(m)] for i in range(m)])
        return row["loss"], np.array([row[f"g{i}"] or 0.0 for i in range(m)]), second

    weights = np.full(m, 1.0 / m)
    loss, gradient, curvature = measured(weights)
    step = _simplex_step(gradient, curvature, weights)
    for _ in range(passes):
        if np.abs(step).max() < tolerance:
            break
        moved = np.clip(weights + step, 0.0, None)
        moved /= moved.sum()
        at = measured(moved)
        if at[0] > loss:
            step = step / 2
            continue
        weights, (loss, gradient, curvature) = moved, at
        step = _simplex_step(gradient, curvature, weights)
    return weights.tolist()


def best_weights(losses: DataFrame, models: int) -> DataFrame:
    """The weighting with the lowest loss; ties go to the larger leading weights."""
    names = [f"w{i}" for i in range(models)]
    return losses.orderBy(F.round("log_loss", 9), *[F.desc(n) for n in names]).limit(1)
