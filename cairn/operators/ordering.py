"""Order statistics that never sort a whole group in one task.

Every function here works in two steps. A cheap aggregate counts rows per *order-preserving bucket*
(between approximate quantiles of a number, or between sampled strings); running totals over those few
buckets give the number of rows before each bucket. Exact ordering is then needed inside a
bucket only, so a group holding a third of all rows is still spread over many tasks, also where the
values crowd together. The quantiles only choose the cuts; results do not depend on them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cairn.sources.scratch import cut_lineage

BUCKETS = 4096  # slices of a hash
SPLITS = 256  # intervals between approximate quantiles
PARTS = 64  # equal slices of such an interval
STRING_SAMPLE = 8192  # different strings from which cuts are chosen
RANGE_ROWS = 100_000  # rows of one range of :func:`ranged`


def range_bucket(value: Column, lo: float | None, hi: float | None, buckets: int = BUCKETS) -> Column:
    """Equal-width slice of ``[lo, hi]``; monotone in ``value``, 0 where the range is empty."""
    if lo is None or float(lo) == float(hi):
        return F.lit(0)
    at = (value.cast("double") - F.lit(float(lo))) * float(buckets) / (float(hi) - float(lo))
    return F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(buckets - 1)).cast("int")


def fit_row(df: DataFrame, exprs: Mapping[str, Column]) -> dict:
    """One row of statistics as plain values, so that they enter later plans as constants."""
    return df.agg(*[e.alias(n) for n, e in exprs.items()]).first().asDict()


def fit_splits(df: DataFrame, columns: Sequence[Column], buckets: int = SPLITS) -> list[list[float]]:
    """Ascending cut points of each column from its least to its greatest value, equally many rows apart."""
    values = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    at = [i / buckets for i in range(buckets + 1)]
    cuts = values.approxQuantile(values.columns, at, 1.0 / (4 * buckets))
    return [sorted(set(c)) for c in cuts]


def cuts_passed(value: Column, cuts: Column, count: int) -> Column:
    """How many of ``count`` ascending cuts are not above ``value``, by binary search; 0 for null."""
    steps = [1 << k for k in reversed(range(count.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(step) for step in steps]),
        F.lit(0),
        lambda n, step: F.when(value >= F.get(cuts, n + step - 1), n + step).otherwise(n),
    )


def split_bucket(value: Column, splits: Sequence[float], parts: int = PARTS) -> Column:
    """Order-preserving bucket: the interval between two cuts, divided into ``parts`` equal slices."""
    if not splits:
        return F.lit(0)
    cuts = F.array(*[F.lit(float(x)) for x in splits])
    number = value.cast("double")

    def bucket(n: Column) -> Column:
        lo, hi = F.get(cuts, n - 1), F.get(cuts, n)
        inside = F.floor((number - lo) / (hi - lo) * float(parts))
        return (n * parts + F.coalesce(F.least(F.greatest(inside, F.lit(0)), F.lit(parts - 1)), F.lit(0))).cast("int")

    return F.transform(F.array(cuts_passed(number, cuts, len(splits))), bucket)[0]


def fit_string_cuts(df: DataFrame, value: Column, buckets: int = SPLITS) -> list[str]:
    """Ascending strings that part the different values of a column about equally.

    They are chosen from the values with the smallest hashes, a sample that depends on the values only.
    """
    different = df.select(value.alias("v")).filter(F.col("v").isNotNull()).distinct()
    sample = different.orderBy(F.xxhash64("v"), "v").limit(STRING_SAMPLE)
    found = [r[0] for r in sample.collect()]
    found = sorted(set(found), key=lambda x: x.encode())
    return [found[i] for i in sorted({len(found) * k // buckets for k in range(1, buckets)})] if found else []


def order_bucket(df: DataFrame, column: str, buckets: int = SPLITS) -> Column:
    """Order-preserving bucket of a numeric, date or string column, fitted on ``df``; nulls come first."""
    kind = df.schema[column].dataType
    value = F.unix_date(column) if isinstance(kind, T.DateType) else F.col(column)
    if isinstance(kind, T.StringType):
        cuts = fit_string_cuts(df, value, buckets)
        return cuts_passed(value, F.array(*[F.lit(c) for c in cuts]), len(cuts)) if cuts else F.lit(0)
    return split_bucket(value, fit_splits(df, [value], buckets)[0])


def ranged(df: DataFrame, order: Sequence[str], name: str = "_range", rows: int = RANGE_ROWS) -> DataFrame:
    """A written table with the number of each row's range along ``order``, about ``rows`` rows a range.

    Spark samples the splitters, whole values whose number follows the table's; equal rows share a range.
    """
    df = cut_lineage(df)
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df.withColumn(name, F.lit(0))
    return cut_lineage(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id()))


def keyed_as(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the key columns under names of their own, for :func:`met`."""
    return df.withColumnsRenamed({k: f"_key_{k}" for k in keys})


def met(keys: Sequence[str]) -> Column:
    """The keys of the left side equal those of a :func:`keyed_as` right side; null equals null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return same


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    sums: Mapping[str, Column],
) -> DataFrame:
    """Add, for each name in ``sums``, its total over the rows that come earlier in ``order``.

    ``bucket`` must not decrease along ``order`` and must have a bounded number of values per key.
    A null key is a key like any other. ``order`` must have no ties within a key.
    """
    group = [*keys, "_bucket"]
    base = df.withColumn("_bucket", bucket)
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = base.groupBy(*group).agg(*[F.sum(e).alias(f"_total_{n}") for n, e in sums.items()])
    offsets = offsets.select(
        *group,
        *[F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)).alias(f"_offset_{n}") for n in sums],
    )
    if not keys:
        offsets = F.broadcast(offsets)  # one row per bucket
    inside = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return base.join(keyed_as(offsets, group), met(group)).select(
        *df.columns,
        *[
            (F.col(f"_offset_{n}") + F.coalesce(F.sum(e).over(inside), F.lit(0))).alias(n)
            for n, e in sums.items()
        ],
    )


def positions(
    df: DataFrame,
    order: Sequence[str],
    bucket: Column,
    keys: Sequence[str] = (),
    name: str = "pos",
) -> DataFrame:
    """Zero-based row number along ``order`` within ``keys``."""
    return prefix_sums(df, keys, bucket, order, {name: F.lit(1).cast("bigint")})


def smallest_per_group(
    df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[str], n: int, buckets: int = BUCKETS
) -> DataFrame:
    """The ``n`` rows of each key with the smallest ``score`` in [0, 1); smaller groups stay whole."""
    group = [*keys, "_slice"]
    base = df.withColumn("_slice", F.floor(F.col(score) * buckets).cast("int"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = base.groupBy(*group).agg(F.count("*").alias("_n"))
    offsets = offsets.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    needed = keyed_as(offsets.filter(F.col("_before") < n).drop("_n"), group)
    inside = W.partitionBy(*group).orderBy(score, *tie)
    return (
        base.join(needed, met(group))
        .withColumn("_rank", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_rank") <= n)
        .select(*df.columns)
    )


WORD = 63  # codes of one word of a set of small codes


def distinct_counts(
    df: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, str],
    plain: Mapping[str, Column],
    codes: Mapping[str, int] | None = None,
) -> DataFrame:
    """Exact distinct counts ``name: column`` and ordinary aggregates per key; nulls aren't counted.

    ``codes`` gives the greatest value of columns that hold whole numbers from 0: their sets are bits of a few words,
    which aggregate like sums. Only other columns make Spark copy a row for each of them.
    """
    codes = dict(codes or {})
    counts, sets = [], {}
    for name, c in distinct.items():
        if c not in codes:
            counts.append(F.count_distinct(c).alias(name))
            continue
        words = [f"_set_{name}_{w}" for w in range(codes[c] // WORD + 1)]
        for w, word in enumerate(words):
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(c) - w * WORD).cast("int"))
            here = F.col(c).between(w * WORD, w * WORD + WORD - 1)
            counts.append(F.bit_or(F.when(here, bit)).alias(word))
        sets[name] = sum((F.coalesce(F.bit_count(w), F.lit(0)) for w in words), F.lit(0)).cast("bigint").alias(name)
    found = df.groupBy(*keys).agg(*counts, *[e.alias(n) for n, e in plain.items()])
    return found.select(*keys, *[sets.get(n, F.col(n)) for n in distinct], *plain)
