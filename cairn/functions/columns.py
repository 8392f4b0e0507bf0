"""Scalar column functions; everything here stays in generated JVM code."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column, functions as F

# Codes and names that results depend on.
LETTER_CODES = {"0": 0, "a": 1, "b": 2, "c": 3, "d": 4}
WEEKDAY_CODES = {"Monday": 1, "Tuesday": 2, "Friday": 3, "Wednesday": 4, "Thursday": 5, "Sunday": 6, "Saturday": 7}
CALENDAR_CODES = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4, "Friday": 5, "Sunday": 6, "Saturday": 7}
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec")


def hash_unit(*parts: Column | str | int) -> Column:
    """Uniform number in [0, 1) with 52 bits from the text of the parts; the same on every engine and run."""
    cols = [F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def hash16(value: Column) -> Column:
    """Bucket of 2**16 from the text of a value."""
    return F.conv(F.substr(F.md5(value.cast("string")), F.lit(1), F.lit(4)), 16, 10).cast("int")


def encode_map(value: Column, mapping: Mapping[str, int], keep: bool = False) -> Column:
    """Dictionary lookup; values outside the dictionary become null, or with ``keep`` stay, all as text."""
    code = F.create_map(*[F.lit(x) for x in chain(*mapping.items())])[value]
    return F.coalesce(code.cast("string"), value.cast("string")) if keep else code


def date_parts(date: Column) -> dict[str, Column]:
    """Calendar columns; the day of the week counts from Monday = 0, the week is the ISO week."""
    return {
        "Year": F.year(date),
        "Month": F.month(date),
        "Day": F.day(date),
        "DayOfWeek": F.weekday(date),
        "WeekOfYear": F.weekofyear(date),
    }


def months_open(year: Column, month: Column, since_year: Column, since_month: Column) -> Column:
    return (year - since_year) * 12 + (month - since_month)


def promo_months_open(year: Column, week: Column, since_year: Column, since_week: Column) -> Column:
    """Months since the promotion began; 0 before it or where it never began (year 0)."""
    months = ((year - since_year) * 12).cast("double") + (week - since_week) / F.lit(4.0)
    return F.when(since_year == 0, F.lit(0.0)).otherwise(F.greatest(months, F.lit(0.0)))


def in_promo_month(month: Column, interval: Column) -> Column:
    """1 where the name of the month occurs in a comma-separated list of month names."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month)
    return F.coalesce(F.array_contains(F.split(interval, ","), name), F.lit(False)).cast("int")


def clip(p: Column, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def squash(x: Column) -> Column:
    """Logistic curve of the square root."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.sqrt(x)))


def squash_vector(values: Column, digits: int = 3) -> Column:
    return F.transform(values, lambda x: F.round(squash(x), digits))


def ratio(a: Column, b: Column) -> Column:
    """Quotient, null on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def strip_class_prefix(label: Column, prefix: str = "Class_") -> Column:
    """``Class_3`` -> 2."""
    return F.regexp_replace(label, f"^{prefix}", "").cast("int") - 1


def id_prefix(value: Column, sep: str = "_") -> Column:
    return F.split_part(value, F.lit(sep), F.lit(1))


