"""Scans, sinks and round trips."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from cairn.plans import views as V
from cairn.plans.registry import query
from cairn.sources import files
from cairn.sources.scratch import scratch_path

PREDICTION = T.StructType([T.StructField("Id", T.LongType()), T.StructField("Sales", T.DoubleType())])


@query("scan_csv_typed", V.sql("SELECT * FROM store", "store"))
def scan_csv_typed(spark, d):
    """Store table written as CSV and read back with its declared schema."""
    table = V.store(spark, d)
    path = files.write_csv(table, scratch_path(spark, "store-csv"))
    return files.read_csv_typed(spark, path, table.schema)


@query(
    "scan_csv_renamed",
    V.sql("SELECT ImageId AS image, Xmax AS x_extent, Ymin AS y_extent FROM grid", "grid"),
)
def scan_csv_renamed(spark, d):
    """Grid extents read under names of our own instead of the header's."""
    path = files.write_csv(V.grid(spark, d), scratch_path(spark, "grid-csv"))
    return files.read_csv_renamed(
        spark,
        path,
        T.StructType(
            [
                T.StructField("image", T.StringType()),
                T.StructField("x_extent", T.DoubleType()),
                T.StructField("y_extent", T.DoubleType()),
            ]
        ),
    )


@query("scan_glob_predictions", V.sql("SELECT Id, value AS Sales, model FROM predictions", "predictions"))
def scan_glob_predictions(spark, d):
    """One folder per model, read back through a glob with the model named by its path."""
    table = V.predictions(spark, d).select("Id", F.col("value").alias("Sales"), "model")
    path = files.write_csv(table, scratch_path(spark, "predictions-csv"), ["model"])
    return files.read_prediction_files(spark, f"{path}/*", PREDICTION, r"model=([^/]+)/")


@query(
    "cast_typed_columns",
    V.sql(
        """SELECT Id, Date, CAST(floor(Sales) AS int) AS Sales, Open::double AS Open,
             try_cast(StateHoliday AS int) AS StateHoliday FROM sales""",
        "sales",
    ),
)
def cast_typed_columns(spark, d):
    """Text columns cast to declared types; letters in a number column become null."""
    text = V.sales(spark, d).select(
        "Id",
        F.date_format("Date", "yyyy-MM-dd").alias("Date"),
        F.floor("Sales").alias("Sales"),
        F.col("Open").cast("string").alias("Open"),
        "StateHoliday",
    )
    return files.cast_columns(text, {"Date": "date", "Sales": "int", "Open": "double", "StateHoliday": "int"})


@query(
    "image_asset_catalog",
    V.sql(
        """SELECT ImageId, k.kind, replace(k.pattern, '%s', ImageId) AS path
           FROM grid CROSS JOIN (VALUES ('3','bands/three_band/%s.tif'), ('A','bands/sixteen_band/%s_A.tif'),
             ('M','bands/sixteen_band/%s_M.tif'), ('P','bands/sixteen_band/%s_P.tif')) k(kind, pattern)""",
        "grid",
    ),
)
def image_asset_catalog(spark, d):
    return files.asset_catalog(V.grid(spark, d).select("ImageId"), "bands")


@query("sink_predictions_roundtrip", V.sql("SELECT Id, Sales FROM sales", "sales"))
def sink_predictions_roundtrip(spark, d):
    path = files.write_predictions(V.sales(spark, d), scratch_path(spark, "submission-csv"))
    return files.read_csv_typed(spark, path, PREDICTION)


@query(
    "submission_wide",
    V.sql(
        """SELECT Id, """
        + ", ".join(f"round(avg(CASE WHEN class={c} THEN p END), 9) AS Class_{c}" for c in V.CLASSES)
        + " FROM class_probs GROUP BY Id",
        "class_probs",
    ),
)
def submission_wide(spark, d):
    """Mean probability over the models, one column per class in label order, through a CSV."""
    mean = V.class_probs(spark, d).groupBy("Id", "class").agg(F.round(F.avg("p"), 9).alias("p"))
    wide = files.submission_wide(mean, "Id", "class", "p", V.CLASSES, "Class_")
    path = files.write_csv(wide, scratch_path(spark, "wide-csv"))
    return files.read_csv_typed(spark, path, wide.schema)


@query(
    "submission_from_template",
    V.sql(
        f"""SELECT t.Id, {", ".join(f"coalesce(p.{m}, 0.0::double) AS {m}" for m in V.MODELS)}
           FROM sales t LEFT JOIN (
             SELECT Id, {", ".join(f"max(CASE WHEN model = '{m}' THEN value END) AS {m}" for m in V.MODELS)}
             FROM predictions GROUP BY Id) p ON t.Id = p.Id AND t.Open = 1""",
        "sales",
        "predictions",
    ),
)
def submission_from_template(spark, d):
    """Every sales id is in the template; only days known to be open have predictions."""
    sales = V.sales(spark, d)
    wide = files.submission_wide(V.predictions(spark, d), "Id", "model", "value", V.MODELS)
    known = wide.join(sales.filter(F.col("Open") == 1), "Id", "left_semi")
    return files.submission_from_template(sales, known, "Id", list(V.MODELS))
