"""Filters, null handling, imputation and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.ordering import fit_row, order_bucket, positions


def filter_open(df: DataFrame, flag: str = "Open") -> DataFrame:
    """Keep rows that are not closed; an unknown flag counts as open."""
    return df.filter(F.coalesce(F.col(flag), F.lit(1)) != 0)


def filter_floor(df: DataFrame, column: str, floor: float = 0.0, strict: bool = False) -> DataFrame:
    value = F.col(column)
    return df.filter(value > floor if strict else value >= floor)


def replace_value(df: DataFrame, column: str, old: float, new: float) -> DataFrame:
    value = F.col(column)
    return df.withColumn(column, F.when(value == old, F.lit(new)).otherwise(value))


def fill_null(df: DataFrame, value: float | Mapping[str, object]) -> DataFrame:
    """Constant for every numeric column, or one constant per named column."""
    return df.na.fill(value)


def default_flag(df: DataFrame, flag: str = "Open", value: int = 1) -> DataFrame:
    return df.withColumn(flag, F.coalesce(F.col(flag), F.lit(value)))


def assign_where(df: DataFrame, column: str, condition: Column, value) -> DataFrame:
    """Overwrite ``column`` where ``condition`` holds."""
    return df.withColumn(column, F.when(condition, F.lit(value)).otherwise(F.col(column)))


def impute_mean(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Null -> column mean, taken from ``fit`` (default: the table itself); one aggregate for all columns."""
    means = fit_row(fit or df, {c: F.avg(c) for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in columns})


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(columns) if columns else None)


def slice_by_position(df: DataFrame, key: str, first: int) -> DataFrame:
    """Mark the ``first`` rows by key order with slice 0 and the rest with slice 1."""
    numbered = positions(df, [key], order_bucket(df, key))
    return numbered.withColumn("slice", F.when(F.col("pos") < first, 0).otherwise(1))


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables of the same grain, matched by key."""
    return left.join(right, key)


def downcast(df: DataFrame, floats: Sequence[str] = (), ints: Sequence[str] = ()) -> DataFrame:
    """Single-precision floats; integers by cutting the fraction."""
    return df.withColumns(
        {c: F.col(c).cast("float") for c in floats} | {c: F.floor(c).cast("int") for c in ints}
    )
