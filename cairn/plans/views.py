"""Stand-in domain views over the TPC-H-like tables, as DataFrames and as DuckDB SQL.

The source tables hold no nulls, so the views plant nulls, zeros and returns by formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TRAIN_END = "2000-01-01"
RASTER = 41  # rows and columns of every stand-in image
BANDS = 8
PIXEL_ROWS = 2_000_000  # of a task, about
MODELS = ("m1", "m2", "m3", "m4")
PROB_MODELS = ("m1", "m2", "m3")
CLASSES = (1, 2, 3, 4, 5)
TARGETS = tuple(f"Class_{i}" for i in range(1, 11))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table, answered from the file footers."""
    return table(spark, sf_dir, name).count()


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS Store",
        "CASE s_suppkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS StoreType",
        "CASE s_suppkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS Assortment",
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS CompetitionDistance",
        "CAST(CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 1990 + s_suppkey % 9 END AS int) AS CompetitionOpenSinceYear",
        "CAST(CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 1 + s_suppkey % 12 END AS int) AS CompetitionOpenSinceMonth",
        "CAST(s_suppkey % 2 AS int) AS Promo2",
        "CAST(CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 1994 + s_suppkey % 5 END AS int) AS Promo2SinceYear",
        "CAST(CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 1 + s_suppkey % 52 END AS int) AS Promo2SinceWeek",
        "CASE WHEN s_suppkey % 2 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'Jan,Apr,Jul,Oct' "
        "WHEN s_suppkey % 3 = 1 THEN 'Feb,May,Aug,Nov' ELSE 'Mar,Jun,Sept,Dec' END AS PromoInterval",
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    stores = row_count(spark, sf_dir, "supplier")
    return (
        table(spark, sf_dir, "orders")
        .withColumn("Store", F.col("o_custkey") % F.lit(stores).cast("bigint"))
        .selectExpr(
            "o_orderkey AS Id",
            "Store",
            "CAST(o_orderdate AS date) AS Date",
            "CASE WHEN o_orderkey % 53 = 0 THEN 0.0D ELSE o_totalprice END AS Sales",
            "CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 ELSE 1 + o_orderkey % 400 END AS int) AS Customers",
            "CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0 ELSE 1 END AS Open",
            "CAST(o_orderkey % 2 AS int) AS Promo",
            "CASE o_orderkey % 40 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '0' END AS StateHoliday",
            "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS SchoolHoliday",
        )
    )


def train(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Date") < F.lit(TRAIN_END).cast("date"))


def test(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Date") >= F.lit(TRAIN_END).cast("date"))


def basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    parts = table(spark, sf_dir, "part")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .selectExpr(
            "l_orderkey AS VisitNumber",
            "CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_partkey END AS Upc",
            "CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS int) AS ScanCount",
            "p_type AS DepartmentDescription",
            "p_size AS FinelineNumber",
            "date_format(o_orderdate, 'EEEE') AS Weekday",
            "CAST(substr(o_orderpriority, 1, 1) AS int) AS TripType",
        )
    )


def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id",
        "transform(embedding, x -> CAST(x AS double)) AS features",
        "concat('Class_', CAST(label + 1 AS string)) AS target",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in zip(MODELS, (7, 3, 5, 9))]
    )
    return (
        table(spark, sf_dir, "orders")
        .withColumn("m", F.explode(models))
        .selectExpr(
            "o_orderkey AS Id",
            "m.model AS model",
            "o_totalprice AS truth",
            "o_totalprice * (1 + ((o_orderkey * m.k) % 11 - 5) / 100.0D) AS value",
        )
    )


def class_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in zip(PROB_MODELS, (3, 5, 8))]
    )
    scores = "transform(array(1, 2, 3, 4, 5), c -> CAST(1 + (o_orderkey * (c + m.k)) % 7 AS double))"
    return (
        table(spark, sf_dir, "orders")
        .withColumn("m", F.explode(models))
        .withColumn("sc", F.expr(scores))
        .withColumn("total", F.expr("aggregate(sc, 0.0D, (a, x) -> a + x)"))
        .select("o_orderkey", "o_orderpriority", "m.model", "total", F.posexplode("sc").alias("at", "score"))
        .selectExpr(
            "o_orderkey AS Id",
            "model",
            "CAST(substr(o_orderpriority, 1, 1) AS int) AS truth",
            "at + 1 AS class",
            "score / total AS p",
        )
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS PolyId",
        "concat('img_', CAST(p_partkey DIV 100 AS string), '_', CAST(p_partkey % 3 AS string)) AS ImageId",
        "CAST(p_partkey % 5 + 1 AS int) AS ClassType",
        "concat('MULTIPOLYGON (((1 1, ', CAST(p_size % 13 + 9 AS string), ' 2, ', CAST(p_size % 7 + 8 AS string),"
        " ' 14, 2 11, 1 1), (4 4, 6 4, 6 6, 4 6, 4 4)))') AS MultipolygonWKT",
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image with figures that differ between images."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "concat('img_', CAST(p_partkey DIV 100 AS string), '_', CAST(p_partkey % 3 AS string)) AS ImageId", "p_size"
    )
    return parts.groupBy("ImageId").agg(F.sum("p_size").cast("bigint").alias("total"), F.max("p_size").alias("top"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).selectExpr(
        "ImageId", "CAST(20 + total % 7 AS double) AS Xmax", "CAST(18 + top % 5 AS double) AS Ymin"
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.sequence(F.lit(0), F.lit(RASTER - 1))
    some = images(spark, sf_dir)
    tasks = max(spark.sparkContext.defaultParallelism, -(-some.count() * RASTER * RASTER * BANDS // PIXEL_ROWS))
    lines = some.select("ImageId", "total").withColumn("y", F.explode(side))
    return (
        lines.repartition(tasks, "ImageId")
        .withColumn("x", F.explode(side))
        .withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
        .withColumn(
            "value",
            ((F.col("x") * 31 + F.col("y") * 17 + F.col("band") * 97 + F.col("total") * 13) % 2048).cast("int"),
        )
        .drop("total")
    )


# --- the same views for DuckDB -------------------------------------------------------------------

_SQL = {
    "store": """SELECT s_suppkey AS Store,
  CASE s_suppkey%4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'd' END AS StoreType,
  CASE s_suppkey%3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS Assortment,
  CASE WHEN s_suppkey%7=0 THEN NULL ELSE s_acctbal END AS CompetitionDistance,
  (CASE WHEN s_suppkey%11=0 THEN NULL ELSE 1990+s_suppkey%9 END)::int AS CompetitionOpenSinceYear,
  (CASE WHEN s_suppkey%11=0 THEN NULL ELSE 1+s_suppkey%12 END)::int AS CompetitionOpenSinceMonth,
  (s_suppkey%2)::int AS Promo2,
  (CASE WHEN s_suppkey%2=0 THEN NULL ELSE 1994+s_suppkey%5 END)::int AS Promo2SinceYear,
  (CASE WHEN s_suppkey%2=0 THEN NULL ELSE 1+s_suppkey%52 END)::int AS Promo2SinceWeek,
  CASE WHEN s_suppkey%2=0 THEN NULL WHEN s_suppkey%3=0 THEN 'Jan,Apr,Jul,Oct'
       WHEN s_suppkey%3=1 THEN 'Feb,May,Aug,Nov' ELSE 'Mar,Jun,Sept,Dec' END AS PromoInterval
FROM supplier""",
    "sales": """SELECT o_orderkey AS Id, o_custkey%(SELECT count(*) FROM supplier) AS Store,
  CAST(o_orderdate AS date) AS Date,
  CASE WHEN o_orderkey%53=0 THEN 0.0::double ELSE o_totalprice END AS Sales,
  (CASE WHEN o_orderkey%97=0 THEN 0 ELSE 1+o_orderkey%400 END)::int AS Customers,
  CASE WHEN o_orderkey%31=0 THEN NULL WHEN o_orderkey%17=0 THEN 0 ELSE 1 END AS Open,
  (o_orderkey%2)::int AS Promo,
  CASE o_orderkey%40 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE '0' END AS StateHoliday,
  CASE WHEN o_orderkey%5=0 THEN 1 ELSE 0 END AS SchoolHoliday
FROM orders""",
    "train": "SELECT * FROM sales WHERE Date < DATE '2000-01-01'",
    "test": "SELECT * FROM sales WHERE Date >= DATE '2000-01-01'",
    "basket": """SELECT l_orderkey AS VisitNumber, CASE WHEN l_partkey%41=0 THEN NULL ELSE l_partkey END AS Upc,
  CAST(CASE WHEN l_returnflag='R' THEN -l_quantity ELSE l_quantity END AS int) AS ScanCount,
  p_type AS DepartmentDescription, p_size AS FinelineNumber,
  dayname(o_orderdate) AS Weekday, CAST(substr(o_orderpriority,1,1) AS int) AS TripType
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey""",
    "product": """SELECT vec_id AS id, embedding::double[] AS features,
  concat('Class_', CAST(label+1 AS varchar)) AS target FROM embeddings""",
    "predictions": """SELECT o_orderkey AS Id, m.model, o_totalprice AS truth,
  o_totalprice*(1+((o_orderkey*m.k)%11-5)/100.0::double) AS value
FROM orders CROSS JOIN (VALUES ('m1',7),('m2',3),('m3',5),('m4',9)) AS m(model,k)""",
    "class_probs": """SELECT Id, model, truth, class, sc::double / sum(sc::double) OVER (PARTITION BY Id, model) AS p
FROM (SELECT o_orderkey AS Id, m.model, CAST(substr(o_orderpriority,1,1) AS int) AS truth, cl.c::int AS class,
        1+(o_orderkey*(cl.c+m.k))%7 AS sc
      FROM orders CROSS JOIN (VALUES ('m1',3),('m2',5),('m3',8)) AS m(model,k)
                  CROSS JOIN (VALUES (1),(2),(3),(4),(5)) AS cl(c))""",
    "polygons": """SELECT p_partkey AS PolyId,
  concat('img_',CAST(p_partkey//100 AS varchar),'_',CAST(p_partkey%3 AS varchar)) AS ImageId,
  (p_partkey%5+1)::int AS ClassType,
  concat('MULTIPOLYGON (((1 1, ',CAST(p_size%13+9 AS varchar),' 2, ',CAST(p_size%7+8 AS varchar),
         ' 14, 2 11, 1 1), (4 4, 6 4, 6 6, 4 6, 4 4)))') AS MultipolygonWKT
FROM part""",
    "images": """SELECT concat('img_',CAST(p_partkey//100 AS varchar),'_',CAST(p_partkey%3 AS varchar)) AS ImageId,
  sum(p_size)::bigint AS total, max(p_size) AS top FROM part GROUP BY 1""",
    "grid": "SELECT ImageId, (20+total%7)::double AS Xmax, (18+top%5)::double AS Ymin FROM images",
    "pixels": """SELECT ImageId, y::int AS y, x::int AS x, b::int AS band,
  CAST((x*31+y*17+b*97+total*13)%2048 AS int) AS value
FROM images, range(0,41) r(y), range(0,41) s(x), range(0,8) t(b)""",
}
_NEEDS = {"train": ["sales"], "test": ["sales"], "grid": ["images"], "pixels": ["images"]}


def sql(body: str, *views: str) -> str:
    """``body`` with the named views in front as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({_SQL[name]})" for name in ordered)
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{ctes},\n{body[len(start):]}"
    return f"WITH {ctes}\n{body}"
