"""Row features, encoders and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import clean, encode as E, features as X, joins
from cairn.operators.stats import attach_store_stats, store_stats
from cairn.plans import views as V
from cairn.plans.q_clean import WEEKDAY_SQL
from cairn.plans.q_stats import FRACTIONS, FUSED_SQL, rounded, settled
from cairn.plans.registry import query
from cairn.sources.scratch import cut_lineage

DATE_SQL = """year(Date)::int AS Year, month(Date)::int AS Month, day(Date)::int AS Day,
  (isodow(Date) - 1)::int AS DayOfWeek, week(Date)::int AS WeekOfYear"""
MONTHS_SQL = "[" + ",".join(f"'{m}'" for m in C.MONTH_NAMES) + "]"
COMP_SQL = """12 * (year(Date) - coalesce(CompetitionOpenSinceYear, 0))
  + (month(Date) - coalesce(CompetitionOpenSinceMonth, 0))"""
PROMO_SQL = """CASE WHEN coalesce(Promo2SinceYear, 0) = 0 THEN 0.0::double ELSE greatest(
  (12 * (year(Date) - Promo2SinceYear))::double + (week(Date) - Promo2SinceWeek) / 4.0::double, 0.0::double) END"""
ISPROMO_SQL = f"coalesce(list_contains(string_split(PromoInterval, ','), {MONTHS_SQL}[month(Date)]), false)::int"


def letter_sql(column: str) -> str:
    return f"(CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.LETTER_CODES.items()) + " ELSE 0 END)"


def joined(spark, d):
    return joins.join_dimension(V.sales(spark, d), V.store(spark, d), "Store")


@query("date_parts", V.sql(f"SELECT Id, {DATE_SQL} FROM sales", "sales"))
def date_parts(spark, d):
    return X.add_date_parts(V.sales(spark, d).select("Id", "Date")).drop("Date")


@query(
    "competition_open_months",
    V.sql(f"SELECT Id, ({COMP_SQL})::int AS CompetitionOpen FROM sales JOIN store USING (Store)", "sales", "store"),
)
def competition_open_months(spark, d):
    return X.add_competition_open(X.add_date_parts(joined(spark, d))).select("Id", "CompetitionOpen")


@query(
    "promo_open_months",
    V.sql(f"SELECT Id, {PROMO_SQL} AS PromoOpen FROM sales JOIN store USING (Store)", "sales", "store"),
)
def promo_open_months(spark, d):
    return X.add_promo_open(X.add_date_parts(joined(spark, d))).select("Id", "PromoOpen")


@query(
    "is_promo_month",
    V.sql(f"SELECT Id, {ISPROMO_SQL} AS IsPromoMonth FROM sales JOIN store USING (Store)", "sales", "store"),
)
def is_promo_month(spark, d):
    return X.add_promo_month(X.add_date_parts(joined(spark, d))).select("Id", "IsPromoMonth")


RETAIL_SQL = f"""clean AS (SELECT * REPLACE (coalesce(Open, 1) AS Open) FROM sales WHERE coalesce(Open, 1) <> 0
    AND (Date >= DATE '2000-01-01' OR Sales > 0)),
  st AS (SELECT Store, {FUSED_SQL} FROM clean WHERE Date < DATE '2000-01-01' GROUP BY Store),
  feat AS (SELECT Id, CASE WHEN Date < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS side, Sales,
    Store, coalesce(CompetitionDistance, 0) AS CompetitionDistance, Promo, Promo2, SchoolHoliday,
    {letter_sql('StoreType')} AS StoreType, {letter_sql('Assortment')} AS Assortment,
    {letter_sql('StateHoliday')} AS StateHoliday, {DATE_SQL}, ({COMP_SQL})::int AS CompetitionOpen,
    {PROMO_SQL} AS PromoOpen, {ISPROMO_SQL} AS IsPromoMonth
    FROM clean JOIN store USING (Store))"""


def retail_table(spark, d):
    """Cleaned and joined sales with row features; ``side`` tells train from test rows."""
    side = F.when(F.col("Date") < F.lit(V.TRAIN_END).cast("date"), "train").otherwise("test")
    sales = clean.filter_open(clean.default_flag(V.sales(spark, d))).withColumn("side", side)
    sales = sales.filter((F.col("side") == "test") | (F.col("Sales") > 0))
    return X.build_retail_features(joins.join_dimension(sales, V.store(spark, d), "Store"))


def retail_with_stats(spark, d):
    """Row features plus the training statistics of the store, on both sides."""
    table = retail_table(spark, d)
    kept = table.select("Id", "side", "Sales", "Customers", *X.RETAIL_FEATURES)
    raw = clean.filter_open(V.sales(spark, d))
    stats = store_stats(V.train(raw).filter("Sales > 0"))
    return attach_store_stats(kept, stats)


@query(
    "retail_features",
    V.sql(
        f"""WITH {RETAIL_SQL} SELECT feat.*, st.* EXCLUDE (Store)
        FROM feat LEFT JOIN st ON feat.Store = st.Store""",
        "sales",
        "store",
    ),
)
def retail_features(spark, d):
    """Flagship: the whole retail feature build with train statistics on both sides."""
    return settled(retail_with_stats(spark, d).drop("Customers"), FRACTIONS)


@query(
    "log_target_roundtrip",
    V.sql(
        """SELECT Id, round(ln(1 + Sales), 6) AS log_sales, round(exp(ln(1 + Sales)) - 1, 4) AS back FROM sales""",
        "sales",
    ),
)
def log_target_roundtrip(spark, d):
    logged = V.sales(spark, d).select("Id", F.log1p("Sales").alias("v"))
    return logged.select("Id", F.round("v", 6).alias("log_sales"), F.round(F.expm1("v"), 4).alias("back"))


@query(
    "row_ratio_features",
    V.sql(
        """SELECT s.Id, Sales / nullif(Customers, 0) AS sales_per_customer,
             Sales / nullif(p, 0) AS sales_per_promo, Sales / nullif(h, 0) AS sales_per_holiday
           FROM sales s JOIN (SELECT Store, sum(Promo) AS p, sum(SchoolHoliday) AS h FROM sales GROUP BY 1) t
             ON s.Store = t.Store""",
        "sales",
    ),
)
def row_ratio_features(spark, d):
    sales = V.sales(spark, d)
    counts = sales.groupBy("Store").agg(
        F.count("*").alias("n_rows"), F.sum("Promo").alias("promotion_time"), F.sum("SchoolHoliday").alias("holidaySum")
    )
    rows = sales.select("Id", "Store", "Sales", "Customers")
    out = X.add_row_ratios(joins.attach(rows, counts, ["Store"], "n_rows", ["promotion_time", "holidaySum"]))
    names = ["sales_per_customer", "sales_per_promo", "sales_per_holiday"]
    return out.select("Id", *names)


PROFILE_SQL = f"""coded AS (SELECT b.VisitNumber, b.ScanCount, b.TripType, {WEEKDAY_SQL} AS WeekdayNumber,
    b.DepartmentDescription AS Department, coalesce(b.Upc::double, m.u) AS Upc,
    coalesce(b.FinelineNumber::double, m.f) AS FinelineNumber
    FROM basket b, (SELECT avg(Upc) AS u, avg(FinelineNumber) AS f FROM basket) m),
  prof AS (SELECT VisitNumber, count(DISTINCT FinelineNumber) AS FinelineNumber, count(DISTINCT Upc) AS Upc,
    count(DISTINCT Department) AS Department, sum(ScanCount)::bigint AS ScanCount, count(ScanCount) AS Count,
    count(FinelineNumber) AS "FinelineNumberSum", count(Upc) AS "UpcSum", avg(WeekdayNumber) AS WeekdayNumber,
    avg(TripType)::int AS TripType FROM coded GROUP BY 1)"""
RATIO_SQL = """round(Department / nullif(Count, 0), 6) AS "DepartDiff", round(ScanCount / nullif(Count, 0), 6) AS "ScanCountRate",
  round(FinelineNumber / nullif(Count, 0), 6) AS "FinelineNumberRate", round(Upc / nullif(Count, 0), 6) AS "UpcNumberRate",
  round("FinelineNumberSum" / nullif(Count, 0), 6) AS "Fineline2NumberRate", round("UpcSum" / nullif(Count, 0), 6) AS "Upc2NumberRate",
  round("UpcSum" / nullif(Upc, 0), 6) AS "UpcRatio",
  round(FinelineNumber / nullif("FinelineNumberSum", 0), 6) AS "FinelineNumberRatio",
  round(Department / nullif(FinelineNumber, 0), 6) AS "kindDepart\""""


@query(
    "basket_ratio_features",
    V.sql(f"WITH {PROFILE_SQL} SELECT VisitNumber, {RATIO_SQL} FROM prof", "basket"),
)
def basket_ratio_features(spark, d):
    out = X.build_basket_features(V.basket(spark, d)).select("VisitNumber", *X.BASKET_RATIOS)
    return rounded(out, X.BASKET_RATIOS)


@query("basket_features", V.sql(f"WITH {PROFILE_SQL} SELECT prof.*, {RATIO_SQL} FROM prof", "basket"))
def basket_features(spark, d):
    """Whole basket build: codes, imputation, one per-visit aggregate, ratios."""
    return rounded(X.build_basket_features(V.basket(spark, d)), X.BASKET_RATIOS)


@query(
    "sigmoid_sqrt",
    V.sql(
        """SELECT id, list_transform(features, lambda x: round(1 / (1 + exp(-sqrt(abs(x)))), 3)) AS features
           FROM product""",
        "product",
    ),
)
def sigmoid_sqrt(spark, d):
    """Squashed vectors; the sample vectors hold negatives, so their size goes in."""
    sizes = F.transform("features", F.abs)
    return V.product(spark, d).select("id", C.squash_vector(sizes).alias("features"))


LOGSTD_SQL = """long AS (SELECT id, unnest(range(0, 64)) AS i, ln(1 + abs(unnest(features))) AS v FROM product),
  st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM long GROUP BY 1)"""


@query(
    "log_standardize",
    V.sql(
        f"""WITH {LOGSTD_SQL} SELECT id, list(round((v - m) / nullif(s, 0), 5) ORDER BY i) AS features
        FROM long JOIN st USING (i) GROUP BY id""",
        "product",
    ),
)
def log_standardize(spark, d):
    sizes = V.product(spark, d).select("id", F.transform("features", F.abs).alias("features"))
    out = E.log_standardize(sizes, "features", 64)
    return out.withColumn("features", F.transform("features", lambda x: F.round(x, 5)))


@query("split_id_prefix", V.sql("SELECT PolyId, split_part(ImageId, '_', 1) AS prefix FROM polygons", "polygons"))
def split_id_prefix(spark, d):
    return V.polygons(spark, d).select("PolyId", C.id_prefix(F.col("ImageId")).alias("prefix"))


@query(
    "clip_probability",
    V.sql(
        "SELECT Id, model, class, round(least(greatest(p, 0.15::double), 0.85::double), 9) AS p FROM class_probs",
        "class_probs",
    ),
)
def clip_probability(spark, d):
    """Clipped to [0.15, 0.85] so that both ends act on the sample probabilities."""
    probs = V.class_probs(spark, d)
    return probs.select("Id", "model", "class", F.round(C.clip(F.col("p"), 0.15), 9).alias("p"))


# --- encoders ------------------------------------------------------------------------------------


@query(
    "encode_dictionary",
    V.sql(
        f"""SELECT VisitNumber, Upc, ScanCount, {WEEKDAY_SQL} AS WeekdayNumber FROM basket""",
        "basket",
    ),
)
def encode_dictionary(spark, d):
    code = C.encode_map(F.col("Weekday"), C.WEEKDAY_CODES).alias("WeekdayNumber")
    return V.basket(spark, d).select("VisitNumber", "Upc", "ScanCount", code)


CALENDAR_SQL = "(CASE Weekday " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CALENDAR_CODES.items()) + " END)::int"
KEPT_SQL = "CASE StateHoliday " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in list(C.LETTER_CODES.items())[:3]) + " ELSE StateHoliday END"


@query(
    "encode_dictionary_orders",
    V.sql(f"SELECT VisitNumber, Upc, {WEEKDAY_SQL} AS listed, {CALENDAR_SQL} AS calendar FROM basket", "basket"),
)
def encode_dictionary_orders(spark, d):
    """Both weekday numberings that the workloads use."""
    day = F.col("Weekday")
    listed, calendar = C.encode_map(day, C.WEEKDAY_CODES), C.encode_map(day, C.CALENDAR_CODES)
    return V.basket(spark, d).select("VisitNumber", "Upc", listed.alias("listed"), calendar.alias("calendar"))


@query("replace_known_values", V.sql(f"SELECT Id, {KEPT_SQL} AS StateHoliday FROM sales", "sales"))
def replace_known_values(spark, d):
    """Values of a dictionary replaced, all others kept as they are."""
    some = dict(list(C.LETTER_CODES.items())[:3])
    return V.sales(spark, d).select("Id", C.encode_map(F.col("StateHoliday"), some, keep=True).alias("StateHoliday"))


@query(
    "encode_category_codes",
    V.sql(
        """WITH c AS (SELECT p, row_number() OVER (ORDER BY p)::int AS Department FROM (
             SELECT DISTINCT DepartmentDescription AS p FROM basket JOIN orders ON VisitNumber = o_orderkey
             WHERE o_orderdate < TIMESTAMP '2000-01-01'))
        SELECT VisitNumber, Upc, ScanCount, Department FROM basket LEFT JOIN c ON DepartmentDescription = p""",
        "basket",
    ),
)
def encode_category_codes(spark, d):
    """Codes fitted on training visits, applied to all lines."""
    basket = V.basket(spark, d)
    early = V.table(spark, d, "orders").filter(F.col("o_orderdate") < F.lit(V.TRAIN_END).cast("timestamp"))
    early = early.select(F.col("o_orderkey").alias("VisitNumber"))
    codes = E.category_codes(joins.members(basket, early, "VisitNumber"), "DepartmentDescription")
    out = E.apply_codes(basket, codes, "DepartmentDescription", "Department")
    return out.select("VisitNumber", "Upc", "ScanCount", "Department")


@query(
    "encode_label",
    V.sql(
        """SELECT id, target, (dense_rank() OVER (ORDER BY target) - 1)::int AS y FROM product""",
        "product",
    ),
)
def encode_label(spark, d):
    products = V.product(spark, d).select("id", "target")
    return E.apply_codes(products, E.label_codes(products, "target"), "target", "y")


@query(
    "encode_hash16",
    V.sql(
        """SELECT VisitNumber, Upc, ('0x' || substr(md5(Weekday), 1, 4))::int AS Weekday,
             ('0x' || substr(md5(DepartmentDescription), 1, 4))::int AS DepartmentDescription FROM basket""",
        "basket",
    ),
)
def encode_hash16(spark, d):
    hashed = [C.hash16(F.col(c)).alias(c) for c in ("Weekday", "DepartmentDescription")]
    return V.basket(spark, d).select("VisitNumber", "Upc", *hashed)


FREQUENCY_COLUMNS = ["Upc", "ScanCount", "FinelineNumber", "WeekdayNumber", "DepartmentDescription"]


@query(
    "encode_frequency",
    V.sql(
        f"WITH l AS (SELECT *, {WEEKDAY_SQL} AS WeekdayNumber FROM basket) SELECT VisitNumber, "
        + ", ".join(f"round(Count{c}, 9) AS Count{c}" for c in FREQUENCY_COLUMNS)
        + " FROM l "
        + " ".join(
            f"""LEFT JOIN (SELECT {c}, count(*) / (SELECT count({c}) FROM l)::double AS Count{c}
                  FROM l WHERE {c} IS NOT NULL GROUP BY 1) USING ({c})"""
            for c in FREQUENCY_COLUMNS
        ),
        "basket",
    ),
)
def encode_frequency(spark, d):
    """Relative frequency of five columns' values beside each line."""
    out = V.basket(spark, d).withColumn("WeekdayNumber", C.encode_map(F.col("Weekday"), C.WEEKDAY_CODES))
    out = E.encode_frequency(out, {c: f"Count{c}" for c in FREQUENCY_COLUMNS})
    return out.select("VisitNumber", *[F.round(f"Count{c}", 9).alias(f"Count{c}") for c in FREQUENCY_COLUMNS])


@query(
    "decode_label",
    V.sql("SELECT id, target, target AS again, (dense_rank() OVER (ORDER BY target) - 1)::int AS y FROM product", "product"),
)
def decode_label(spark, d):
    """Labels to codes and back."""
    products = V.product(spark, d).select("id", "target")
    codes = E.label_codes(products, "target")
    return E.decode(E.apply_codes(products, codes, "target", "y"), codes, "target", "y", "again")


SPARSE = ["Department", "FinelineNumber", "Upc"]


@query(
    "encode_one_hot_sparse",
    V.sql(
        "WITH l AS (SELECT VisitNumber, DepartmentDescription AS Department, FinelineNumber, Upc FROM basket), "
        + ", ".join(
            f"v{i} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS at FROM (SELECT DISTINCT {c} AS v FROM l WHERE {c} IS NOT NULL))"
            for i, c in enumerate(SPARSE)
        )
        + """, n AS (SELECT (SELECT count(*) FROM v0) AS n0, (SELECT count(*) FROM v1) AS n1, (SELECT count(*) FROM v2) AS n2)
        SELECT VisitNumber, (n0 + n1 + n2)::int AS size, list_filter([v0.at, n0 + v1.at, n0 + n1 + v2.at],
          lambda x: x IS NOT NULL)::int[] AS indices
        FROM l CROSS JOIN n LEFT JOIN v0 ON Department = v0.v LEFT JOIN v1 ON FinelineNumber = v1.v LEFT JOIN v2 ON Upc = v2.v""",
        "basket",
    ),
)
def encode_one_hot_sparse(spark, d):
    """Three columns with vocabularies of any size as one sparse vector."""
    lines = V.basket(spark, d).withColumnRenamed("DepartmentDescription", "Department").select("VisitNumber", *SPARSE)
    out = E.one_hot_sparse(lines, SPARSE)
    return out.select("VisitNumber", "features.size", "features.indices")


HOT = {"Assortment": "abc", "StateHoliday": "0abc", "StoreType": "abcd"}


@query(
    "encode_one_hot",
    V.sql(
        "SELECT Id, Promo, SchoolHoliday, "
        + ", ".join(f"coalesce(({c} = '{v}')::int, 0) AS \"{c}_{v}\"" for c, vs in HOT.items() for v in vs)
        + " FROM sales JOIN store USING (Store)",
        "sales",
        "store",
    ),
)
def encode_one_hot(spark, d):
    """Numbers pass through, text columns become one 0/1 column per value seen in training."""
    rows = joined(spark, d)
    categories = {c: E.category_list(V.train(rows), c) for c in HOT}
    return E.one_hot(rows, categories).select(
        "Id", "Promo", "SchoolHoliday", *[f"{c}_{v}" for c, vs in categories.items() for v in vs]
    )


SCALED = ["Sales", "Customers", "Store"]


def _scaled(op, spark, d):
    sales = V.sales(spark, d)
    return rounded(op(sales, SCALED, fit=V.train(sales)).select("Id", *SCALED), SCALED)


@query(
    "scale_standard",
    V.sql(
        "SELECT Id, "
        + ", ".join(f"round(({c} - m_{c}) / nullif(s_{c}, 0), 6) AS {c}" for c in SCALED)
        + " FROM sales, (SELECT "
        + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALED)
        + " FROM train)",
        "train",
    ),
)
def scale_standard(spark, d):
    return _scaled(E.scale_standard, spark, d)


@query(
    "scale_robust",
    V.sql(
        "SELECT Id, "
        + ", ".join(f"round(({c} - q_{c}[2]) / nullif(q_{c}[3] - q_{c}[1], 0), 6) AS {c}" for c in SCALED)
        + " FROM sales, (SELECT "
        + ", ".join(f"quantile_cont({c}::double, [0.25, 0.5, 0.75]) AS q_{c}" for c in SCALED)
        + " FROM train)",
        "train",
    ),
)
def scale_robust(spark, d):
    return _scaled(E.scale_robust, spark, d)


@query(
    "scale_minmax",
    V.sql(
        "SELECT Id, "
        + ", ".join(f"round(({c} - l_{c}) / nullif(h_{c} - l_{c}, 0)::double, 6) AS {c}" for c in SCALED)
        + " FROM sales, (SELECT "
        + ", ".join(f"min({c}) AS l_{c}, max({c}) AS h_{c}" for c in SCALED)
        + " FROM train)",
        "train",
    ),
)
def scale_minmax(spark, d):
    return _scaled(E.scale_minmax, spark, d)


@query("pca_project")
def pca_project(spark, d):
    """Ten components of the scaled basket features."""
    cols = ["FinelineNumber", "Upc", "Department", "ScanCount", "Count", "WeekdayNumber", *X.BASKET_RATIOS]
    table = cut_lineage(X.build_basket_features(V.basket(spark, d)).select("VisitNumber", *cols))
    scaled = clean.fill_null(E.scale_minmax(table, cols), 0.0)
    return E.pca_project(scaled, cols, 10).select("VisitNumber", "pca")


@query(
    "polynomial_features",
    V.sql(
        """SELECT Id, [x, x*x, y, x*y, y*y, z, x*z, y*z, z*z] AS poly FROM (
             SELECT Id, Promo::double AS x, Customers::double AS y, SchoolHoliday::double AS z FROM sales)""",
        "sales",
    ),
)
def polynomial_features(spark, d):
    rows = V.sales(spark, d).select("Id", "Promo", "Customers", "SchoolHoliday")
    return E.polynomial(rows, ["Promo", "Customers", "SchoolHoliday"]).select("Id", "poly")
