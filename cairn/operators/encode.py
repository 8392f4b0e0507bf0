"""Encoders and scalers with a fit step (a small table or one row) and a transform step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import PCA, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.joins import attach, attach_written
from cairn.operators.ordering import fit_row, positions, ranged
from cairn.operators.selection import percentiles
from cairn.sources.scratch import cut_lineage


def category_codes(df: DataFrame, column: str, first: int = 1) -> DataFrame:
    """Codes ``first..`` of the distinct values in sorted order, with the rows behind each value.

    The distinct values are written, so that ordering them does not read ``df`` again; ranges of them are ordered
    in one task each.
    """
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_rows"))
    ranked = positions(ranged(values, [column]), [column], F.col("_range"), name="code")
    return ranked.select(column, "n_rows", (F.col("code") + first).cast("int").alias("code"))


def apply_codes(df: DataFrame, codes: DataFrame, column: str, name: str) -> DataFrame:
    """Replace nothing, add ``name``; values unseen in the fit become null."""
    return attach(df, codes.withColumnRenamed("code", name), [column], "n_rows", [name])


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct labels as 0..k-1 (numeric labels in numeric order)."""
    return category_codes(df, column, first=0)


def decode(df: DataFrame, codes: DataFrame, column: str, code: str = "code", name: str | None = None) -> DataFrame:
    """The labels of codes: inverse of :func:`apply_codes`; unknown codes give null.

    ``codes`` holds each label of ``column`` with its ``code``; ``code`` names the column of ``df``.
    """
    labels = codes.select(F.col("code").alias("_code"), F.col(column).alias("_label"))
    found = df.join(labels, F.col(code) == F.col("_code"), "left")
    return found.withColumn(name or column, F.col("_label")).drop("_code", "_label")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows behind every value of several columns as ``(column, value, n_rows)``, from one pass; values as text."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    long = df.select(F.inline(cells)).filter(F.col("value").isNotNull())
    return cut_lineage(long.groupBy("column", "value").agg(F.count("*").alias("n_rows")))


def encode_frequency(df: DataFrame, columns: Mapping[str, str], fit: DataFrame | None = None) -> DataFrame:
    """For each ``column: name``, the relative frequency in ``fit`` of the row's value."""
    counts = value_counts(fit or df, list(columns))
    known = counts.groupBy("column").agg(F.sum("n_rows").alias("n"), F.max("n_rows").alias("most")).collect()
    totals, most = ({r["column"]: r[c] for r in known} for c in ("n", "most"))
    types = dict(df.dtypes)
    out = df
    for column, name in columns.items():
        mine = counts.filter(F.col("column") == column).select(
            F.col("value").cast(types[column]).alias(column),
            "n_rows",
            (F.col("n_rows") / totals.get(column, 1)).alias(name),
        )
        out = attach_written(out, mine, [column], "n_rows", [name], most=most.get(column, 0))
    return out


def category_list(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values, each to become a column of its own.

    A table has no more columns than ``limit`` of one vocabulary: wider ones are refused, they want
    :func:`one_hot_sparse`.
    """
    found = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; use one_hot_sparse")
    return sorted(r[0] for r in found)


def one_hot_sparse(
    df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None, output: str = "features"
) -> DataFrame:
    """0/1 sparse vector over all fitted values of the columns, in column and value order.

    Vocabularies stay tables, so any number of values fits; unseen values and nulls give no entry.
    """
    out, width = df, 0
    for i, c in enumerate(columns):
        codes = category_codes(fit or df, c, first=width)
        width += codes.count()
        out = apply_codes(out, codes, c, f"_at{i}")
    places = F.array_compact(F.array(*[F.col(f"_at{i}") for i in range(len(columns))]))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(width).alias("size"),
        places.alias("indices"),
        F.transform(places, lambda _: F.lit(1.0)).alias("values"),
    )
    return out.withColumn(output, vector).drop(*[f"_at{i}" for i in range(len(columns))])


def one_hot(df: DataFrame, categories: dict[str, Sequence]) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` per fitted value; unseen values give all zeros."""
    return df.withColumns(
        {
            f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
            for c, values in sorted(categories.items())
            for v in values
        }
    )


def scale_standard(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """z-score by the population deviation; null on a constant column."""
    exprs = {f"m_{c}": F.avg(c) for c in columns} | {f"s_{c}": F.stddev_pop(c) for c in columns}
    at = fit_row(fit or df, exprs)
    return df.withColumns({c: _scaled(c, at[f"m_{c}"], at[f"s_{c}"]) for c in columns})


def scale_minmax(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Position in the fitted range; null on a constant column."""
    exprs = {f"lo_{c}": F.min(c) for c in columns} | {f"w_{c}": F.max(c) - F.min(c) for c in columns}
    at = fit_row(fit or df, exprs)
    return df.withColumns({c: _scaled(c, at[f"lo_{c}"], at[f"w_{c}"]) for c in columns})


def scale_robust(df: DataFrame, columns: Sequence[str], fit: DataFrame | None = None) -> DataFrame:
    """Distance from the median in interquartile ranges, from exact percentiles."""
    wanted = {f"{q}_{c}": (c, v) for c in columns for q, v in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    at = fit_row(percentiles(fit or df, [], wanted), {n: F.max(n) for n in wanted})
    spread = {c: None if at[f"q1_{c}"] is None else at[f"q3_{c}"] - at[f"q1_{c}"] for c in columns}
    return df.withColumns({c: _scaled(c, at[f"q2_{c}"], spread[c]) for c in columns})


def _scaled(column: str, centre: float | None, width: float | None) -> Column:
    value = F.col(column).cast("double") - F.lit(centre).cast("double")
    return F.try_divide(value, F.lit(width).cast("double"))


def log_standardize(df: DataFrame, vector: str, size: int, fit: DataFrame | None = None) -> DataFrame:
    """log1p of every element, then the z-score of its position over the table."""
    logged = F.transform(F.col(vector), F.log1p)
    fitted = (fit or df).select(logged.alias("v"))
    at = [F.get(F.col("v"), F.lit(i)) for i in range(size)]
    stats = fit_row(fitted, {"mean": F.array(*[F.avg(a) for a in at]), "std": F.array(*[F.stddev_pop(a) for a in at])})
    mean, std = (F.array(*[F.lit(x).cast("double") for x in stats[n]]) for n in ("mean", "std"))
    centred = F.zip_with(logged, mean, lambda x, m: x - m)
    return df.withColumn(vector, F.zip_with(centred, std, F.try_divide))


def pca_project(df: DataFrame, columns: Sequence[str], k: int = 10, output: str = "pca") -> DataFrame:
    """Projection on the first ``k`` components of the centred columns; component signs are free."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_raw", handleInvalid="error").transform(df)
    centre = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(vectors)
    centred = centre.transform(vectors)
    model = PCA(k=k, inputCol="_centred", outputCol="_pca").fit(centred)
    return model.transform(centred).withColumn(output, vector_to_array("_pca")).drop("_raw", "_centred", "_pca")


def polynomial(df: DataFrame, columns: Sequence[str], output: str = "poly", degree: int = 2) -> DataFrame:
    """All products up to ``degree`` as an array, without a constant term."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_raw").transform(df)
    wide = PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="_poly").transform(vectors)
    return wide.withColumn(output, vector_to_array("_poly")).drop("_raw", "_poly")
