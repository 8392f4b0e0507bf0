"""Retail, basket and product feature builds, composed from column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cairn.functions import columns as C
from cairn.operators import clean
from cairn.operators.encode import category_codes, apply_codes
from cairn.operators.stats import visit_profile
from cairn.sources.scratch import cut_lineage

# Names that results depend on.
RETAIL_FEATURES = (
    "Store", "CompetitionDistance", "Promo", "Promo2", "SchoolHoliday",
    "StoreType", "Assortment", "StateHoliday",
    "DayOfWeek", "Month", "Day", "Year", "WeekOfYear",
    "CompetitionOpen", "PromoOpen", "IsPromoMonth",
)
BASKET_RATIOS = (
    "DepartDiff", "ScanCountRate", "FinelineNumberRate", "UpcNumberRate", "Fineline2NumberRate",
    "Upc2NumberRate", "UpcRatio", "FinelineNumberRatio", "kindDepart",
)
LETTERS = ("StoreType", "Assortment", "StateHoliday")
SINCE = ("CompetitionOpenSinceYear", "CompetitionOpenSinceMonth", "Promo2SinceYear", "Promo2SinceWeek")


def add_date_parts(df: DataFrame, date: str = "Date") -> DataFrame:
    return df.withColumns(C.date_parts(F.col(date)))


def add_competition_open(df: DataFrame) -> DataFrame:
    since = (F.coalesce(F.col("CompetitionOpenSince" + part), F.lit(0)) for part in ("Year", "Month"))
    return df.withColumn("CompetitionOpen", C.months_open(F.col("Year"), F.col("Month"), *since))


def add_promo_open(df: DataFrame) -> DataFrame:
    since = (F.coalesce(F.col("Promo2Since" + part), F.lit(0)) for part in ("Year", "Week"))
    return df.withColumn("PromoOpen", C.promo_months_open(F.col("Year"), F.col("WeekOfYear"), *since))


def add_promo_month(df: DataFrame) -> DataFrame:
    return df.withColumn("IsPromoMonth", C.in_promo_month(F.col("Month"), F.col("PromoInterval")))


def build_retail_features(df: DataFrame) -> DataFrame:
    """All row features of a joined sales table; an unknown Open flag is decided before the zero fill."""
    numeric = ["CompetitionDistance", *SINCE]
    return (
        clean.default_flag(df)
        .transform(clean.fill_null, {c: 0 for c in numeric})
        .withColumns({c: F.coalesce(C.encode_map(F.col(c), C.LETTER_CODES), F.lit(0)) for c in LETTERS})
        .transform(add_date_parts)
        .transform(add_competition_open)
        .transform(add_promo_open)
        .transform(add_promo_month)
    )


def add_row_ratios(df: DataFrame) -> DataFrame:
    """Sales per customer, per promotion day and per holiday of the store."""
    pairs = {
        "sales_per_customer": "Customers",
        "sales_per_promo": "promotion_time",
        "sales_per_holiday": "holidaySum",
    }
    return df.withColumns({n: C.ratio(F.col("Sales"), F.col(d)) for n, d in pairs.items()})


def add_basket_ratios(df: DataFrame) -> DataFrame:
    """Nine ratios of the per-visit profile; null on a zero denominator."""
    count = F.col("Count")
    parts = {
        "DepartDiff": ("Department", count),
        "ScanCountRate": ("ScanCount", count),
        "FinelineNumberRate": ("FinelineNumber", count),
        "UpcNumberRate": ("Upc", count),
        "Fineline2NumberRate": ("FinelineNumberSum", count),
        "Upc2NumberRate": ("UpcSum", count),
        "UpcRatio": ("UpcSum", F.col("Upc")),
        "FinelineNumberRatio": ("FinelineNumber", F.col("FinelineNumberSum")),
        "kindDepart": ("Department", F.col("FinelineNumber")),
    }
    return df.withColumns({n: C.ratio(F.col(a), b) for n, (a, b) in parts.items()})


def encode_basket(lines: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Weekday and department as numbers, nulls filled by the column mean."""
    codes = category_codes(lines, "DepartmentDescription") if codes is None else codes
    coded = apply_codes(lines, codes, "DepartmentDescription", "Department")
    coded = coded.withColumn("WeekdayNumber", C.encode_map(F.col("Weekday"), C.WEEKDAY_CODES))
    return clean.impute_mean(coded, ["Upc", "FinelineNumber"])


def build_basket_features(lines: DataFrame) -> DataFrame:
    """Per-visit profile and ratios from item lines: one aggregate over the encoded lines.

    The lines are written once: codes, means and profile read them back and repeat no join behind them.
    """
    lines = cut_lineage(lines)
    codes = cut_lineage(category_codes(lines, "DepartmentDescription"))  # their number comes from the file footers
    return add_basket_ratios(visit_profile(encode_basket(lines, codes), codes={"Department": codes.count()}))
