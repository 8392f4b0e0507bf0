"""Filters, null handling, projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import clean, joins
from cairn.operators.sample import bootstrap_counts
from cairn.operators.stats import attach_store_stats, store_stats
from cairn.plans import views as V
from cairn.plans.registry import query

WEEKDAY_SQL = "CASE Weekday " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.WEEKDAY_CODES.items()) + " END"
UNIT_SQL = "(('0x' || substr(md5({}), 1, 13))::bigint / 4503599627370496.0::double)"


def unit(*parts: str) -> str:
    """DuckDB twin of ``hash_unit``."""
    return UNIT_SQL.format(" || '|' || ".join(f"CAST({p} AS varchar)" for p in parts))


@query("filter_open", V.sql("SELECT * FROM sales WHERE coalesce(Open, 1) <> 0", "sales"))
def filter_open(spark, d):
    return clean.filter_open(V.sales(spark, d))


@query(
    "filter_sales_floor",
    V.sql(
        """SELECT 'ge' AS rule, Id, Sales FROM sales WHERE Sales >= 0
           UNION ALL SELECT 'gt', Id, Sales FROM sales WHERE Sales > 0""",
        "sales",
    ),
)
def filter_sales_floor(spark, d):
    """Both floors the workload uses."""
    sales = V.sales(spark, d)
    loose = clean.filter_floor(sales, "Sales").select(F.lit("ge").alias("rule"), "Id", "Sales")
    strict = clean.filter_floor(sales, "Sales", strict=True).select(F.lit("gt").alias("rule"), "Id", "Sales")
    return loose.unionByName(strict)


@query(
    "replace_zero_target",
    V.sql("SELECT Id, CASE WHEN Sales = 0 THEN 1.0::double ELSE Sales END AS Sales FROM sales", "sales"),
)
def replace_zero_target(spark, d):
    return clean.replace_value(V.sales(spark, d).select("Id", "Sales"), "Sales", 0.0, 1.0)


@query(
    "fill_null_constant",
    V.sql(
        """SELECT Store, StoreType, Assortment, coalesce(CompetitionDistance, 0) AS CompetitionDistance,
             coalesce(CompetitionOpenSinceYear, 0) AS CompetitionOpenSinceYear,
             coalesce(CompetitionOpenSinceMonth, 0) AS CompetitionOpenSinceMonth, Promo2,
             coalesce(Promo2SinceYear, 0) AS Promo2SinceYear, coalesce(Promo2SinceWeek, 0) AS Promo2SinceWeek,
             PromoInterval FROM store""",
        "store",
    ),
)
def fill_null_constant(spark, d):
    return clean.fill_null(V.store(spark, d), 0)


@query("default_open_flag", V.sql("SELECT Id, Store, Date, coalesce(Open, 1) AS Open FROM sales", "sales"))
def default_open_flag(spark, d):
    return clean.default_flag(V.sales(spark, d).select("Id", "Store", "Date", "Open"))


@query(
    "conditional_assign",
    V.sql(
        """SELECT Store, CASE WHEN Promo2 = 0 THEN '' ELSE PromoInterval END AS PromoInterval,
             CASE WHEN CompetitionDistance < 0 THEN 0.0::double ELSE CompetitionDistance END AS CompetitionDistance
           FROM store""",
        "store",
    ),
)
def conditional_assign(spark, d):
    stores = V.store(spark, d)
    named = clean.assign_where(stores, "PromoInterval", F.col("Promo2") == 0, "")
    floored = clean.assign_where(named, "CompetitionDistance", F.col("CompetitionDistance") < 0, 0.0)
    return floored.select("Store", "PromoInterval", "CompetitionDistance")


BASKET_NUMBERS = f"""SELECT VisitNumber, Upc, ScanCount, FinelineNumber, {WEEKDAY_SQL} AS WeekdayNumber, TripType
  FROM basket"""


def _basket_numbers(spark, d):
    return V.basket(spark, d).select(
        "VisitNumber",
        "Upc",
        "ScanCount",
        "FinelineNumber",
        C.encode_map(F.col("Weekday"), C.WEEKDAY_CODES).alias("WeekdayNumber"),
        "TripType",
    )


@query(
    "impute_mean",
    V.sql(
        f"""WITH b AS ({BASKET_NUMBERS}),
          m AS (SELECT avg(Upc) AS u, avg(FinelineNumber) AS f FROM b)
        SELECT VisitNumber, round(coalesce(Upc::double, u), 6) AS Upc, ScanCount,
          round(coalesce(FinelineNumber::double, f), 6) AS FinelineNumber, WeekdayNumber, TripType
        FROM b, m""",
        "basket",
    ),
)
def impute_mean(spark, d):
    cols = ["Upc", "FinelineNumber"]
    filled = clean.impute_mean(_basket_numbers(spark, d), cols)
    return filled.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "impute_mean_from_train",
    V.sql(
        """WITH t AS (SELECT * FROM train JOIN store USING (Store)),
          s AS (SELECT * FROM test JOIN store USING (Store)),
          m AS (SELECT avg(CompetitionDistance) AS a, avg(Promo2SinceWeek) AS b, avg(Open) AS c FROM t)
        SELECT Id, round(coalesce(CompetitionDistance, a), 6) AS CompetitionDistance,
          round(coalesce(Promo2SinceWeek::double, b), 6) AS Promo2SinceWeek,
          round(coalesce(Open::double, c), 6) AS Open FROM s, m""",
        "train",
        "test",
        "store",
    ),
)
def impute_mean_from_train(spark, d):
    """Test rows filled by the means of the training rows."""
    joined = joins.join_dimension(V.sales(spark, d), V.store(spark, d), "Store")
    cols = ["CompetitionDistance", "Promo2SinceWeek", "Open"]
    filled = clean.impute_mean(V.test(joined), cols, fit=V.train(joined))
    return filled.select("Id", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "drop_null_rows",
    V.sql(
        """SELECT * FROM store WHERE CompetitionDistance IS NOT NULL AND CompetitionOpenSinceYear IS NOT NULL
           AND CompetitionOpenSinceMonth IS NOT NULL AND Promo2SinceYear IS NOT NULL
           AND Promo2SinceWeek IS NOT NULL AND PromoInterval IS NOT NULL""",
        "store",
    ),
)
def drop_null_rows(spark, d):
    return clean.drop_null_rows(V.store(spark, d))


@query(
    "drop_columns",
    V.sql("SELECT VisitNumber, Upc, ScanCount, FinelineNumber, TripType FROM basket", "basket"),
)
def drop_columns(spark, d):
    return V.basket(spark, d).drop("Weekday", "DepartmentDescription")


@query("project_features", V.sql("SELECT Id, Store, Promo, SchoolHoliday, Customers FROM sales", "sales"))
def project_features(spark, d):
    return V.sales(spark, d).select("Id", *["Store", "Promo", "SchoolHoliday", "Customers"])


@query(
    "concat_columns",
    V.sql(
        f"""SELECT s.Id, s.Sales, {", ".join(f"p.{m}" for m in V.MODELS)} FROM sales s JOIN (
             SELECT Id, {", ".join(f"max(CASE WHEN model = '{m}' THEN value END) AS {m}" for m in V.MODELS)}
             FROM predictions GROUP BY Id) p ON s.Id = p.Id""",
        "sales",
        "predictions",
    ),
)
def concat_columns(spark, d):
    """Prediction columns set beside the sales rows they belong to."""
    wide = joins.align_predictions(V.predictions(spark, d), "Id", "model", "value", V.MODELS)
    return clean.concat_columns(V.sales(spark, d).select("Id", "Sales"), wide, "Id")


@query(
    "filter_two_keys",
    V.sql("SELECT * FROM polygons WHERE ImageId = 'img_3_1' AND ClassType = 2", "polygons"),
)
def filter_two_keys(spark, d):
    return V.polygons(spark, d).filter((F.col("ImageId") == "img_3_1") & (F.col("ClassType") == 2))


@query(
    "slice_by_position",
    V.sql(
        """SELECT Id, Sales, row_number() OVER (ORDER BY Id) - 1 AS pos,
             CASE WHEN row_number() OVER (ORDER BY Id) <= 9999 THEN 0 ELSE 1 END AS slice FROM sales""",
        "sales",
    ),
)
def slice_by_position(spark, d):
    return clean.slice_by_position(V.sales(spark, d).select("Id", "Sales"), "Id", 9999)


@query(
    "strip_class_prefix",
    V.sql("SELECT id, CAST(replace(target, 'Class_', '') AS int) - 1 AS y FROM product", "product"),
)
def strip_class_prefix(spark, d):
    return V.product(spark, d).select("id", C.strip_class_prefix(F.col("target")).alias("y"))


@query("distinct_values", V.sql("SELECT DISTINCT ImageId, ClassType FROM polygons", "polygons"))
def distinct_values(spark, d):
    return V.polygons(spark, d).select("ImageId", "ClassType").distinct()


@query(
    "downcast_numeric",
    V.sql("SELECT Id, Sales::float AS Sales, floor(Sales / 7)::int AS Stretched FROM sales", "sales"),
)
def downcast_numeric(spark, d):
    table = V.sales(spark, d).select("Id", "Sales", (F.col("Sales") / 7).alias("Stretched"))
    return clean.downcast(table, floats=["Sales"], ints=["Stretched"])


# --- joins ---------------------------------------------------------------------------------------


@query("join_store_dim", V.sql("SELECT * FROM sales JOIN store USING (Store)", "sales", "store"))
def join_store_dim(spark, d):
    return joins.join_dimension(V.sales(spark, d), V.store(spark, d), "Store")


@query(
    "join_train_stats_to_test",
    V.sql(
        """WITH m AS (SELECT Store, avg(Sales) AS a, median(Sales) AS b FROM train GROUP BY Store)
        SELECT t.Id, t.Store, round(m.a + 1e-9, 6) AS Sales_mean, round(m.b + 1e-9, 6) AS sales_median
        FROM test t LEFT JOIN m ON t.Store = m.Store""",
        "train",
        "test",
    ),
)
def join_train_stats_to_test(spark, d):
    sales = V.sales(spark, d)
    keep = ["Sales_mean", "sales_median"]
    out = attach_store_stats(V.test(sales).select("Id", "Store"), store_stats(V.train(sales)), keep)
    return out.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in keep})


@query(
    "semi_join_members",
    V.sql("SELECT * FROM polygons WHERE ImageId IN (SELECT ImageId FROM polygons WHERE ClassType = 3)", "polygons"),
)
def semi_join_members(spark, d):
    """Polygons of images that hold at least one polygon of class 3."""
    polygons = V.polygons(spark, d)
    return joins.members(polygons, polygons.filter("ClassType = 3"), "ImageId")


@query(
    "anti_join_out_of_bag",
    V.sql(f"SELECT Id, Sales FROM sales WHERE NOT ({unit('Id', 1)} >= exp(-1.0::double))", "sales"),
)
def anti_join_out_of_bag(spark, d):
    """Rows that the first bootstrap replicate never drew."""
    sales = V.sales(spark, d).select("Id", "Sales")
    drawn = bootstrap_counts(sales, "Id", 1).filter("draws > 0")
    return joins.non_members(sales, drawn, "Id")


@query(
    "align_predictions",
    V.sql(
        "SELECT Id, "
        + ", ".join(f"max(CASE WHEN model='{m}' THEN value END) AS {m}" for m in V.MODELS)
        + " FROM predictions GROUP BY Id",
        "predictions",
    ),
)
def align_predictions(spark, d):
    return joins.align_predictions(V.predictions(spark, d), "Id", "model", "value", V.MODELS)
