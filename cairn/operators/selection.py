"""Exact percentiles of groups of any size by radix selection.

One partial aggregate counts the values of each group in bands of the logarithm, which order as the values do,
with the least and the greatest value of each band; running counts tell the bands that hold the wanted ranks. A rank is
settled if its band holds one value, or if it is the band's first or last rank. Only values of the bands
that are left are counted again, by the upper bits of a 64-bit integer that orders as the double does, and
at last by all of them, so there are at most three passes whatever the values are. Nothing of the input is
written, a group's rows are combined before the shuffle, and no task orders more than a group's bands.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.operators.ordering import fit_row, keyed_as, met
from cairn.sources.scratch import cut_lineage

#: Bands of the first pass in each octave. More of them suit groups of few rows or columns of few values.
DETAIL = 16
FINE = 4096
#: Bits of the ordered integer below the bands of the later passes.
BELOW = (24, 0)
LEAST_NORMAL = 2.0**-1022


def _shift(by: str, value: Column, bits: int | Column) -> Column:
    return F.call_function(by, value, F.lit(bits) if isinstance(bits, int) else bits)


def top_bits(key: Column, below: int) -> Column:
    """The key without its ``below`` lowest bits."""
    return _shift("shiftright", key, below)


def with_order_key(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add a long that orders as the double ``value`` does: NaN comes last, zeros of both signs are equal, null stays null."""
    size = F.abs(F.col(value))
    near = F.floor(F.log2(size)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    steps = df.withColumn("_size", size).withColumn("_near", F.when((size >= LEAST_NORMAL) & (size < float("inf")), near))
    # log2 may round across a power of two.
    over, under = power(F.col("_near")) > F.col("_size"), power(F.col("_near") + 1) <= F.col("_size")
    steps = steps.withColumn("_exponent", F.col("_near") - over.cast("int") + under.cast("int"))
    mantissa = ((F.col("_size") / power(F.col("_exponent")) - 1) * 2.0**52).cast("long")
    end = 2047 << 52
    place = (
        F.when(F.col("_exponent").isNotNull(), _shift("shiftleft", (F.col("_exponent") + 1023).cast("long"), 52) + mantissa)
        .when(F.isnan("_size"), F.lit(end + 1))
        .when(F.col("_size") < LEAST_NORMAL, (F.col("_size") * 2.0**537 * 2.0**537).cast("long"))
        .when(F.col("_size").isNotNull(), F.lit(end))
    )
    signed = F.when((F.col(value) < 0) & ~F.isnan(value), -place).otherwise(place)
    return steps.withColumn(name, signed).drop("_size", "_near", "_exponent")


def log_band(value: str, detail: int = DETAIL) -> Column:
    """A long that doesn't decrease with the double ``value``; null for null."""
    size = F.abs(F.col(value))
    place = F.when(F.isnan(value), F.lit(4096 * detail)).when(size == float("inf"), F.lit(4095 * detail))
    place = place.when(size > 0, F.floor(F.log2(size) * detail) + 2048 * detail).when(size == 0, F.lit(0)).cast("long")
    return F.when((F.col(value) < 0) & ~F.isnan(value), -place).otherwise(place)


def _values(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, _stat, _value): the columns under each other, numbered by ``_stat``."""
    if len(columns) == 1:
        return df.select(*keys, F.lit(0).alias("_stat"), F.col(columns[0]).cast("double").alias("_value"))
    cells = [F.struct(F.lit(i).alias("_stat"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)]
    return df.select(*keys, F.inline(F.array(*cells)))


def _counted(values: DataFrame, group: Sequence[str], place: Column) -> DataFrame:
    """Rows, least and greatest value of each ``_place``, and the rows before it."""
    bands = values.groupBy(*group, place.alias("_place")).agg(
        F.count("*").alias("_n"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")
    )
    known = F.when(F.col("_place").isNotNull(), F.col("_n")).otherwise(0)
    before = W.partitionBy(*group).orderBy("_place").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    return bands.withColumns(
        {
            "_before": F.coalesce(F.sum(known).over(before), F.lit(0)),
            "_total": F.sum(known).over(whole),
            "_rows": F.sum("_n").over(whole),
        }
    )


def _held(bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Settle each asked rank that lies in its row's band; ``_at`` becomes the rank within the band."""
    inside = (F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_before") + F.col("_n"))
    found = bands.filter(inside | F.col("_place").isNull()).withColumn("_at", F.col("_at") - F.col("_before"))
    value = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_at") == 0), F.col("_lo")).when(
        F.col("_at") == F.col("_n") - 1, F.col("_hi")
    )
    return cut_lineage(
        found.withColumn("_found", F.when(F.col("_place").isNotNull(), value)).select(
            *keys, "_stat", F.col("_place").alias("_band"), "_name", "_side", "_part", "_at", "_found", "_rows"
        )
    )


def selected(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], detail: int = DETAIL
) -> DataFrame:
    """(keys, _stat, _name, _side, _part, _found, _rows): the values of the ranks on both sides of each percentile.

    A group has a row without a name for each column that holds nulls in it.
    """
    columns = sorted({c for c, _ in wanted.values()})
    values = _values(df, keys, columns)
    asked = [
        F.struct(F.lit(n).alias("_name"), F.lit(columns.index(c)).alias("_of"), F.lit(float(q)).alias("_q"), F.lit(s).alias("_side"))
        for n, (c, q) in wanted.items()
        for s in (0, 1)
    ]
    # The first question also stands for the group where values are null.
    first = F.struct(F.lit(None).cast("string").alias("_name"), F.lit(-1).alias("_of"), F.lit(0.0).alias("_q"), F.lit(0).alias("_side"))
    bands = _counted(values, [*keys, "_stat"], log_band("_value", detail))
    exact = F.col("_q") * (F.col("_total") - 1)
    asks = (
        bands.select("*", F.inline(F.array(first, *asked)))
        .filter(F.when(F.col("_place").isNull(), F.col("_of") == -1).otherwise(F.col("_of") == F.col("_stat")))
        .withColumn("_at", F.when(F.col("_side") == 0, F.floor(exact)).otherwise(F.ceil(exact)))
        .withColumn("_part", exact - F.floor(exact))
    )
    found = _held(asks, keys)
    settled = [found.filter(F.col("_found").isNotNull() | F.col("_name").isNull())]
    group = [*keys, "_stat", "_band"]
    for above, below in zip((None, *BELOW), BELOW):
        left = found.filter(F.col("_found").isNull() & F.col("_name").isNotNull())
        if left.isEmpty():
            break
        left = keyed_as(left.select(*group, "_name", "_side", "_part", "_at", "_rows"), group)
        needed = left.select(*[f"_key_{g}" for g in group]).distinct()
        if above is None:
            near = values.withColumn("_band", log_band("_value", detail)).join(needed, met(group), "left_semi")
            near = with_order_key(near, "_value", "_key")
        else:
            near = with_order_key(values, "_value", "_key").withColumn("_band", top_bits(F.col("_key"), above))
            near = near.join(needed, met(group), "left_semi")
        bands = _counted(near, group, top_bits(F.col("_key"), below)).drop("_rows")
        found = _held(bands.join(left, met(group)), keys)
        settled.append(found.filter(F.col("_found").isNotNull()))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def group_stats(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    plain: Mapping[str, Column] | None = None,
    rows: str | None = None,
    detail: int = DETAIL,
) -> DataFrame:
    """Ordinary aggregates and exact percentiles per key, one row per key.

    ``wanted`` maps an output name to ``(column, fraction)``; nulls are ignored and ranks in between are
    interpolated. A null key is a key like any other; a group without values has null percentiles. ``rows``
    names a column for the number of rows, which costs nothing beside percentiles. ``detail`` changes the plan
    only: the bands of an octave in the first pass.
    """
    keys, plain = list(keys), dict(plain or {})

    def value(name: str) -> Column:
        lo, hi = (F.max(F.when((F.col("_name") == name) & (F.col("_side") == s), F.col("_found"))) for s in (0, 1))
        part = F.max(F.when(F.col("_name") == name, F.col("_part")))
        return (lo + (hi - lo) * part).alias(name)

    found = selected(df, keys, wanted, detail)
    count = [F.coalesce(F.max("_rows"), F.lit(0)).alias(rows)] if rows else []
    cuts = found.groupBy(*keys).agg(*count, *[value(n) for n in wanted])
    names = [*([rows] if rows else []), *wanted]
    if not plain:
        return cuts.select(*keys, *names)
    whole = df.groupBy(*keys).agg(*[e.alias(n) for n, e in plain.items()])
    if not keys:
        row = fit_row(cuts, {n: F.max(n) for n in names})
        kinds = dict(cuts.dtypes)
        return whole.withColumns({n: F.lit(v).cast(kinds[n]) for n, v in row.items()})
    return whole.join(keyed_as(cuts, keys), met(keys), "left").select(*keys, *plain, *names)


def percentiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]], detail: int = DETAIL
) -> DataFrame:
    return group_stats(df, keys, wanted, detail=detail)
