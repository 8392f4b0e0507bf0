"""Per-key statistics, windows, previews and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import stats as S
from cairn.operators.encode import category_codes, apply_codes
from cairn.operators.ordering import distinct_counts
from cairn.operators.selection import FINE, group_stats, percentiles
from cairn.plans import views as V
from cairn.plans.q_clean import WEEKDAY_SQL
from cairn.plans.registry import query
from cairn.sources.scratch import cut_lineage


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def settled(df, names):
    """Rounded to 6 digits after a nudge off exact ties, which float sums reach from either side."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _store_query(agg_sql: str) -> str:
    return V.sql(f"SELECT Store, {agg_sql} FROM sales GROUP BY Store", "sales")


@query("store_sales_mean", _store_query("round(avg(Sales) + 1e-9, 6) AS Sales_mean"))
def store_sales_mean(spark, d):
    return V.sales(spark, d).groupBy("Store").agg(F.round(F.avg("Sales") + 1e-9, 6).alias("Sales_mean"))


@query("store_sales_median", _store_query("round(median(Sales), 6) AS sales_median"))
def store_sales_median(spark, d):
    return rounded(percentiles(V.sales(spark, d), ["Store"], {"sales_median": ("Sales", 0.5)}, FINE), ["sales_median"])


@query("store_sales_extremes", _store_query("max(Sales) AS sales_max, min(Sales) AS sales_min"))
def store_sales_extremes(spark, d):
    return V.sales(spark, d).groupBy("Store").agg(F.max("Sales").alias("sales_max"), F.min("Sales").alias("sales_min"))


@query(
    "store_customers_stats",
    _store_query("round(avg(Customers), 6) AS Customers_mean, round(median(Customers), 6) AS Customers_median"),
)
def store_customers_stats(spark, d):
    median = {"Customers_median": ("Customers", 0.5)}
    out = group_stats(V.sales(spark, d), ["Store"], median, {"Customers_mean": F.avg("Customers")}, detail=FINE)
    return rounded(out, ["Customers_mean", "Customers_median"])


@query("store_buying_ratio", _store_query("round(avg(Sales) / nullif(avg(Customers), 0), 6) AS buying"))
def store_buying_ratio(spark, d):
    return V.sales(spark, d).groupBy("Store").agg(
        F.round(C.ratio(F.avg("Sales"), F.avg("Customers")), 6).alias("buying")
    )


@query(
    "store_buying_rate_median",
    _store_query("round(median(Sales) / nullif(median(Customers), 0), 6) AS buying_rate"),
)
def store_buying_rate_median(spark, d):
    both = percentiles(V.sales(spark, d), ["Store"], {"s": ("Sales", 0.5), "c": ("Customers", 0.5)}, FINE)
    return both.select("Store", F.round(C.ratio(F.col("s"), F.col("c")), 6).alias("buying_rate"))


@query("store_promo_count", _store_query("sum(Promo)::bigint AS promotion_time"))
def store_promo_count(spark, d):
    return V.sales(spark, d).groupBy("Store").agg(F.sum("Promo").alias("promotion_time"))


@query("store_holiday_count", _store_query("sum(SchoolHoliday)::bigint AS \"holidaySum\""))
def store_holiday_count(spark, d):
    return V.sales(spark, d).groupBy("Store").agg(F.sum("SchoolHoliday").alias("holidaySum"))


FUSED_SQL = """round(avg(Sales) + 1e-9, 6) AS Sales_mean, round(median(Sales) + 1e-9, 6) AS sales_median,
  max(Sales) AS sales_max, min(Sales) AS sales_min, round(avg(Customers) + 1e-9, 6) AS Customers_mean,
  round(median(Customers) + 1e-9, 6) AS Customers_median, sum(Promo)::bigint AS promotion_time,
  sum(SchoolHoliday)::bigint AS "holidaySum", round(avg(Sales) / nullif(avg(Customers), 0) + 1e-9, 6) AS buying,
  round(median(Sales) / nullif(median(Customers), 0) + 1e-9, 6) AS buying_rate"""
FRACTIONS = ["Sales_mean", "sales_median", "Customers_mean", "Customers_median", "buying", "buying_rate"]


@query(
    "store_stats_fused",
    V.sql(
        f"""WITH st AS (SELECT Store, {FUSED_SQL} FROM train GROUP BY Store)
        SELECT s.Id, s.Store, st.* EXCLUDE (Store) FROM sales s LEFT JOIN st ON s.Store = st.Store""",
        "train",
    ),
)
def store_stats_fused(spark, d):
    """Every training statistic of the store on every row of both sides."""
    sales = V.sales(spark, d)
    out = S.attach_store_stats(sales.select("Id", "Store"), S.store_stats(V.train(sales)))
    return settled(out, FRACTIONS)


@query(
    "store_stats_per_side",
    V.sql(
        f"""SELECT CASE WHEN Date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS side, Store,
             count(*) AS n_rows, {FUSED_SQL} FROM sales GROUP BY 1, 2""",
        "sales",
    ),
)
def store_stats_per_side(spark, d):
    side = F.when(F.col("Date") < F.lit(V.TRAIN_END).cast("date"), "train").otherwise("test")
    return settled(S.store_stats(V.sales(spark, d).withColumn("side", side), ["side", "Store"]), FRACTIONS)


# --- basket aggregates ---------------------------------------------------------------------------

LINES_SQL = f"""lines AS (SELECT b.*, {WEEKDAY_SQL} AS WeekdayNumber, c.code AS Department FROM basket b JOIN (
  SELECT DepartmentDescription, row_number() OVER (ORDER BY DepartmentDescription) AS code
  FROM (SELECT DISTINCT DepartmentDescription FROM basket)) c USING (DepartmentDescription))"""


def coded_lines(spark, d):
    """Basket lines with weekday and department numbers, and the greatest numbers."""
    basket = V.basket(spark, d)
    # Written codes: their number comes from the file footers.
    codes = cut_lineage(category_codes(basket, "DepartmentDescription"))
    coded = apply_codes(basket, codes, "DepartmentDescription", "Department")
    coded = coded.withColumn("WeekdayNumber", C.encode_map(F.col("Weekday"), C.WEEKDAY_CODES))
    return coded, {"Department": codes.count(), "WeekdayNumber": max(C.WEEKDAY_CODES.values())}


def lines(spark, d):
    return coded_lines(spark, d)[0]


MEAN_COLUMNS = ["Upc", "ScanCount", "FinelineNumber", "WeekdayNumber", "TripType", "Department"]


@query(
    "visit_mean_all",
    V.sql(
        f"WITH {LINES_SQL} SELECT VisitNumber, "
        + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MEAN_COLUMNS)
        + ", count(*) AS Count FROM lines GROUP BY VisitNumber",
        "basket",
    ),
)
def visit_mean_all(spark, d):
    return rounded(S.group_means(lines(spark, d), "VisitNumber", MEAN_COLUMNS, "Count"), MEAN_COLUMNS)


@query(
    "visit_distinct_profile",
    V.sql(
        f"""WITH {LINES_SQL} SELECT VisitNumber, count(DISTINCT FinelineNumber) AS FinelineNumber,
             count(DISTINCT Upc) AS Upc, sum(ScanCount)::bigint AS ScanCount,
             count(DISTINCT Department) AS Department, count(DISTINCT WeekdayNumber) AS WeekdayNumber
           FROM lines GROUP BY VisitNumber""",
        "basket",
    ),
)
def visit_distinct_profile(spark, d):
    counted = {c: c for c in ("FinelineNumber", "Upc", "Department", "WeekdayNumber")}
    rows, codes = coded_lines(spark, d)
    return distinct_counts(rows, ["VisitNumber"], counted, {"ScanCount": F.sum("ScanCount")}, codes)


@query(
    "visit_counts",
    V.sql(
        """SELECT VisitNumber, count(ScanCount) AS Count, sum(ScanCount)::bigint AS "ScanCountSum", count(Upc) AS Upcs
           FROM basket GROUP BY VisitNumber""",
        "basket",
    ),
)
def visit_counts(spark, d):
    return V.basket(spark, d).groupBy("VisitNumber").agg(
        F.count("ScanCount").alias("Count"), F.sum("ScanCount").alias("ScanCountSum"), F.count("Upc").alias("Upcs")
    )


@query(
    "visit_constants",
    V.sql(
        f"""SELECT VisitNumber, avg({WEEKDAY_SQL}) AS WeekdayNumber, avg(TripType) AS TripType,
             avg(VisitNumber) AS VisitMean, min(TripType) = max(TripType) AS one_value
           FROM basket GROUP BY VisitNumber""",
        "basket",
    ),
)
def visit_constants(spark, d):
    """Values that are constant in a visit, pulled by their mean and checked."""
    weekday = C.encode_map(F.col("Weekday"), C.WEEKDAY_CODES)
    return V.basket(spark, d).groupBy("VisitNumber").agg(
        F.avg(weekday).alias("WeekdayNumber"),
        F.avg("TripType").alias("TripType"),
        F.avg("VisitNumber").alias("VisitMean"),
        (F.min("TripType") == F.max("TripType")).alias("one_value"),
    )


@query(
    "class_profile",
    V.sql(
        """SELECT TripType, count(DISTINCT FinelineNumber) AS FinelineNumber, count(DISTINCT Upc) AS Upc,
             sum(ScanCount)::bigint AS ScanCount, count(DISTINCT DepartmentDescription) AS Department
           FROM basket GROUP BY TripType""",
        "basket",
    ),
)
def class_profile(spark, d):
    return V.basket(spark, d).groupBy("TripType").agg(
        F.count_distinct("FinelineNumber").alias("FinelineNumber"),
        F.count_distinct("Upc").alias("Upc"),
        F.sum("ScanCount").alias("ScanCount"),
        F.count_distinct("DepartmentDescription").alias("Department"),
    )


@query(
    "class_visit_count",
    V.sql("SELECT TripType, VisitNumber, count(ScanCount) AS Count FROM basket GROUP BY 1, 2", "basket"),
)
def class_visit_count(spark, d):
    return V.basket(spark, d).groupBy("TripType", "VisitNumber").agg(F.count("ScanCount").alias("Count"))


@query("class_sizes", V.sql("SELECT TripType, count(*) AS n FROM basket GROUP BY 1", "basket"))
def class_sizes(spark, d):
    return V.basket(spark, d).groupBy("TripType").agg(F.count("*").alias("n"))


@query(
    "class_value_histogram",
    V.sql("SELECT TripType, FinelineNumber, count(*) AS n FROM basket GROUP BY 1, 2", "basket"),
)
def class_value_histogram(spark, d):
    return V.basket(spark, d).groupBy("TripType", "FinelineNumber").agg(F.count("*").alias("n"))


@query(
    "describe_log",
    V.sql(
        """SELECT 'log_sales' AS stat_of, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
             round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS p25,
             round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75
           FROM (SELECT ln(1 + Sales) AS v FROM sales)""",
        "sales",
    ),
)
def describe_log(spark, d):
    out = S.describe(V.sales(spark, d), F.log1p("Sales"), "log_sales")
    return rounded(out, ["mean", "std", "min", "max", "p25", "p50", "p75"])


@query(
    "histogram_100",
    V.sql(
        """WITH b AS (SELECT min(Sales) AS lo, max(Sales) AS hi FROM sales)
        SELECT least(floor((Sales - lo) * 100.0::double / (hi - lo)), 99)::int AS bin, count(*) AS n
        FROM sales, b GROUP BY 1""",
        "sales",
    ),
)
def histogram_100(spark, d):
    return S.histogram(V.sales(spark, d), "Sales", 100)


@query(
    "visit_mean_probability",
    V.sql(
        """WITH l AS (SELECT l_orderkey AS VisitNumber, (l_partkey * 7 + l_suppkey) % n AS Id
             FROM lineitem, (SELECT count(*) AS n FROM orders))
        SELECT VisitNumber, model, class, round(avg(p), 9) AS p, count(*) AS n_rows
        FROM l JOIN class_probs USING (Id) GROUP BY 1, 2, 3""",
        "class_probs",
    ),
)
def visit_mean_probability(spark, d):
    """Mean class-probability vector of each visit over its lines, per model."""
    orders = V.row_count(spark, d, "orders")
    rows = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("VisitNumber"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % orders).alias("Id")
    )
    probs = V.class_probs(spark, d).groupBy("Id", "model").agg(
        *[F.max(F.when(F.col("class") == c, F.col("p"))).alias(f"p{c}") for c in V.CLASSES]
    )
    means = rows.join(probs, "Id").groupBy("VisitNumber", "model").agg(
        F.count("*").alias("n_rows"), *[F.avg(f"p{c}").alias(f"p{c}") for c in V.CLASSES]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p{c}").alias("p")) for c in V.CLASSES])
    return means.select("VisitNumber", "model", "n_rows", F.inline(cells)).withColumn("p", F.round("p", 9))


# --- windows, previews ---------------------------------------------------------------------------


@query(
    "visit_transform_count",
    V.sql(
        """SELECT VisitNumber, Upc, FinelineNumber, ScanCount,
             count(FinelineNumber) OVER (PARTITION BY VisitNumber) AS "FinelineNumberSum",
             count(Upc) OVER (PARTITION BY VisitNumber) AS "UpcSum" FROM basket""",
        "basket",
    ),
)
def visit_transform_count(spark, d):
    rows = V.basket(spark, d).select("VisitNumber", "Upc", "FinelineNumber", "ScanCount")
    return S.transform_counts(rows, "VisitNumber", {"FinelineNumberSum": "FinelineNumber", "UpcSum": "Upc"})


@query("preview_head", V.sql("SELECT * FROM sales ORDER BY Id LIMIT 30", "sales"))
def preview_head(spark, d):
    return V.sales(spark, d).orderBy("Id").limit(30)


@query(
    "sorted_frequency_curve",
    V.sql("SELECT FinelineNumber, count(*) AS n FROM basket GROUP BY 1 ORDER BY 1", "basket"),
)
def sorted_frequency_curve(spark, d):
    return V.basket(spark, d).groupBy("FinelineNumber").agg(F.count("*").alias("n")).orderBy("FinelineNumber")


# --- set operations ------------------------------------------------------------------------------


def _image_prefixes(spark, d, classes: str):
    return V.polygons(spark, d).filter(classes).select(F.substring_index("ImageId", "_", 2).alias("prefix")).distinct()


PREFIX_SQL = "SELECT DISTINCT split_part(ImageId, '_', 1) || '_' || split_part(ImageId, '_', 2) AS prefix FROM polygons"


@query(
    "intersect_prefixes",
    V.sql(f"{PREFIX_SQL} WHERE ClassType <= 2 INTERSECT {PREFIX_SQL} WHERE ClassType >= 4", "polygons"),
)
def intersect_prefixes(spark, d):
    return _image_prefixes(spark, d, "ClassType <= 2").intersect(_image_prefixes(spark, d, "ClassType >= 4"))


@query(
    "set_equality_check",
    V.sql(
        f"""WITH a AS ({PREFIX_SQL} WHERE ClassType <= 2), b AS ({PREFIX_SQL} WHERE ClassType >= 4)
        SELECT *, only_left = 0 AND only_right = 0 AS equal FROM (
          SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_left,
            (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_right)""",
        "polygons",
    ),
)
def set_equality_check(spark, d):
    return S.same_set(_image_prefixes(spark, d, "ClassType <= 2"), _image_prefixes(spark, d, "ClassType >= 4"))


@query(
    "union_split_sides",
    V.sql(
        """SELECT 'train' AS side, Id, Store, Sales FROM train
           UNION ALL SELECT 'test', Id, Store, NULL FROM test""",
        "train",
        "test",
    ),
)
def union_split_sides(spark, d):
    """Train and test in one table (the test side has no target), split apart and joined again by side."""
    sales = V.sales(spark, d)
    both = S.union_sides(V.train(sales).select("Id", "Store", "Sales"), V.test(sales).select("Id", "Store"))
    train, test = (both.filter(F.col("side") == side) for side in ("train", "test"))
    return train.unionByName(test)


@query("except_sets", V.sql("SELECT Store FROM store EXCEPT SELECT Store FROM sales WHERE Open = 0", "store", "sales"))
def except_sets(spark, d):
    """Stores that were never recorded as closed."""
    return V.store(spark, d).select("Store").subtract(V.sales(spark, d).filter("Open = 0").select("Store"))
