"""CSV sources and sinks, typed loads and submission tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header row and a declared schema; columns are matched by position and checked by name."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_csv_renamed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV whose header row is replaced by the names of ``schema``."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_prediction_files(
    spark: SparkSession, pattern: str, schema: T.StructType, model_name: str = r"([^/]+)\.csv"
) -> DataFrame:
    """All prediction files below a glob as one long table; the model is named by its file path."""
    raw = spark.read.schema(schema).option("header", True).csv(pattern)
    return raw.select("*", F.regexp_extract("_metadata.file_path", model_name, 1).alias("model"))


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.option("header", True).partitionBy(*partition_by).csv(path)
    return path


def write_predictions(df: DataFrame, path: str, key: str = "Id", value: str = "Sales") -> str:
    """Two-column prediction file without an index."""
    return write_csv(df.select(key, value), path)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Declared type per column; text that does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def asset_catalog(images: DataFrame, base: str, image: str = "ImageId") -> DataFrame:
    """The four band files of every image; the name patterns are fixed values of the data set."""
    files = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.format_string(f"{base}/{pattern}", F.col(image)).alias("path"))
            for kind, pattern in (
                ("3", "three_band/%s.tif"),
                ("A", "sixteen_band/%s_A.tif"),
                ("M", "sixteen_band/%s_M.tif"),
                ("P", "sixteen_band/%s_P.tif"),
            )
        ]
    )
    return images.select(image, F.inline(files))


def submission_wide(
    df: DataFrame, key: str, label: str, p: str, classes: Sequence, prefix: str = ""
) -> DataFrame:
    """One probability column per class, in the order of ``classes``."""
    return df.groupBy(key).agg(
        *[F.max(F.when(F.col(label) == c, F.col(p))).alias(f"{prefix}{c}") for c in classes]
    )


def submission_from_template(
    template: DataFrame, predictions: DataFrame, key: str, columns: Sequence[str], default: float = 0.0
) -> DataFrame:
    """Template ids filled by id (not by position); ids without a prediction get ``default``."""
    return template.select(key).join(predictions, key, "left").select(
        key, *[F.coalesce(F.col(c), F.lit(default)).alias(c) for c in columns]
    )
