"""Per-key statistics, histograms, summaries and set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions.columns import ratio
from cairn.operators.joins import attach
from cairn.operators.ordering import distinct_counts, fit_row, range_bucket
from cairn.operators.selection import FINE, group_stats

STORE_STATS = (
    "Sales_mean", "sales_median", "sales_max", "sales_min", "Customers_mean", "Customers_median",
    "promotion_time", "holidaySum", "buying", "buying_rate",
)


def store_stats(df: DataFrame, keys: Sequence[str] = ("Store",)) -> DataFrame:
    """All per-store statistics: one aggregate, and the medians by radix selection."""
    plain = {
        "n_rows": F.count("*"),
        "Sales_mean": F.avg("Sales"),
        "sales_max": F.max("Sales"),
        "sales_min": F.min("Sales"),
        "Customers_mean": F.avg("Customers"),
        "promotion_time": F.sum("Promo"),
        "holidaySum": F.sum("SchoolHoliday"),
    }
    medians = {"sales_median": ("Sales", 0.5), "Customers_median": ("Customers", 0.5)}
    return group_stats(df, list(keys), medians, plain, detail=FINE).withColumns(
        {
            "buying": ratio(F.col("Sales_mean"), F.col("Customers_mean")),
            "buying_rate": ratio(F.col("sales_median"), F.col("Customers_median")),
        }
    )


def attach_store_stats(df: DataFrame, stats: DataFrame, keep: Sequence[str] = STORE_STATS) -> DataFrame:
    """Per-store statistics on every row; stores without statistics keep nulls."""
    return attach(df, stats, ["Store"], "n_rows", keep)


def visit_profile(lines: DataFrame, key: str = "VisitNumber", codes: Mapping[str, int] | None = None) -> DataFrame:
    """Distinct counts, line counts and constants of each visit in a single aggregate.

    ``codes`` gives the greatest number of columns that hold dictionary codes.
    """
    plain = {
        "ScanCount": F.sum("ScanCount"),
        "Count": F.count("ScanCount"),
        "FinelineNumberSum": F.count("FinelineNumber"),
        "UpcSum": F.count("Upc"),
        "WeekdayNumber": F.avg("WeekdayNumber"),
        "TripType": F.avg("TripType").cast("int"),
    }
    return distinct_counts(lines, [key], {c: c for c in ("FinelineNumber", "Upc", "Department")}, plain, codes)


def group_means(df: DataFrame, key: str, columns: Sequence[str], count: str) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias(count))


def transform_counts(df: DataFrame, key: str, counted: dict[str, str]) -> DataFrame:
    """Non-null counts of the group on each of its rows, without gathering a group in one task."""
    counts = df.groupBy(key).agg(
        F.count("*").alias("_rows"), *[F.count(c).alias(name) for name, c in counted.items()]
    )
    return attach(df, counts, [key], "_rows", list(counted))


def describe(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of one expression."""
    values = df.select(value.alias("v"))
    cuts = {"p25": ("v", 0.25), "p50": ("v", 0.5), "p75": ("v", 0.75)}
    plain = {
        "stat_of": F.lit(name),
        "n": F.count("v"),
        "mean": F.avg("v"),
        "std": F.stddev_samp("v"),
        "min": F.min("v"),
        "max": F.max("v"),
    }
    return group_stats(values, [], cuts, plain)


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """Equal-width bins over the range; the last bin is closed."""
    values = df.filter(F.col(column).isNotNull())
    ends = fit_row(values, {"lo": F.min(column), "hi": F.max(column)})
    at = range_bucket(F.col(column), ends["lo"], ends["hi"], bins)
    return values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def same_set(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: sizes of both differences and whether the two sets are equal."""
    tagged = a.distinct().withColumn("_a", F.lit(1)).withColumn("_b", F.lit(0)).unionByName(
        b.distinct().withColumn("_a", F.lit(0)).withColumn("_b", F.lit(1))
    )
    sides = tagged.groupBy(*a.columns).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    only_a = F.coalesce(F.sum(F.col("_a") * (1 - F.col("_b"))), F.lit(0))
    only_b = F.coalesce(F.sum(F.col("_b") * (1 - F.col("_a"))), F.lit(0))
    return sides.agg(only_a.alias("only_left"), only_b.alias("only_right")).withColumn(
        "equal", (F.col("only_left") == 0) & (F.col("only_right") == 0)
    )


def union_sides(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sides in one table with a ``side`` column; columns missing on one side become null."""
    return train.withColumn("side", F.lit("train")).unionByName(
        test.withColumn("side", F.lit("test")), allowMissingColumns=True
    )
