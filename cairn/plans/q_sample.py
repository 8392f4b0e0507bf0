"""Splits, folds, caps and bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import sample as M
from cairn.plans import views as V
from cairn.plans.q_clean import unit
from cairn.plans.registry import query


@query(
    "split_holdout",
    V.sql(
        f"""SELECT Id, ({unit('Id', 10)} < 0.012)::int AS small, ({unit('Id', 10)} < 0.12)::int AS is_test,
             ({unit('Id', 42)} < 0.8)::int AS large FROM sales""",
        "sales",
    ),
)
def split_holdout(spark, d):
    """The hold-out fractions the workloads use."""
    ids = V.sales(spark, d).select("Id")
    small = M.split_holdout(ids, "Id", 0.012, 10).withColumnRenamed("is_test", "small")
    large = M.split_holdout(small, "Id", 0.8, 42).withColumnRenamed("is_test", "large")
    return M.split_holdout(large, "Id", 0.12, 10)


@query(
    "split_shuffle_10",
    V.sql(
        f"""SELECT Id, i::int AS iter, ({unit('Id', 43, 'i')} < 0.25)::int AS is_test FROM sales, range(1, 11) t(i)""",
        "sales",
    ),
)
def split_shuffle_10(spark, d):
    return M.split_shuffle(V.sales(spark, d).select("Id"), "Id", 10, 0.25, 43)


@query(
    "split_kfold_blocks",
    V.sql(
        """SELECT Id, row_number() OVER (ORDER BY Id) - 1 AS pos, (ntile(10) OVER (ORDER BY Id) - 1)::int AS fold
           FROM sales""",
        "sales",
    ),
)
def split_kfold_blocks(spark, d):
    return M.split_kfold(V.sales(spark, d).select("Id"), "Id", 10)


@query(
    "sample_cap_per_class",
    V.sql(
        f"""SELECT Id, TripType FROM (
             SELECT o_orderkey AS Id, substr(o_orderpriority, 1, 1)::int AS TripType,
               row_number() OVER (PARTITION BY TripType ORDER BY {unit('o_orderkey', 7)}, o_orderkey) AS rn FROM orders)
           WHERE rn <= 2000""",
    ),
)
def sample_cap_per_class(spark, d):
    orders = V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS Id", "CAST(substr(o_orderpriority, 1, 1) AS int) AS TripType"
    )
    return M.cap_per_class(orders, "TripType", ["Id"], 2000, 7)


ONE_TEXT = " || '|' || ".join(
    f"coalesce(CAST({c} AS varchar), '')" for c in ("Upc", "ScanCount", "FinelineNumber")
)


@query(
    "sample_one_per_group",
    V.sql(
        f"""SELECT VisitNumber, Upc, ScanCount, FinelineNumber FROM (SELECT *, row_number() OVER (PARTITION BY VisitNumber
             ORDER BY md5(VisitNumber || '|' || {ONE_TEXT} || '|5')[1:13], {ONE_TEXT}) AS rn FROM basket) WHERE rn = 1""",
        "basket",
    ),
)
def sample_one_per_group(spark, d):
    rows = V.basket(spark, d).select("VisitNumber", "Upc", "ScanCount", "FinelineNumber")
    return M.one_per_group(rows, "VisitNumber", 5)


def _poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {below!r}::double)::int" for below in M.poisson_steps()) + ")"


@query(
    "bootstrap_in_out_bag",
    V.sql(
        f"""SELECT Id, rep::int AS rep, {_poisson_sql('u')} AS draws FROM (
             SELECT Id, rep, {unit('Id', 'rep')} AS u FROM sales, range(1, 6) t(rep))""",
        "sales",
    ),
)
def bootstrap_in_out_bag(spark, d):
    """Five replicates; ``draws`` = 0 is out of bag."""
    return M.bootstrap(V.sales(spark, d).select("Id"), "Id", 5)


@query(
    "sample_with_replacement",
    V.sql(
        f"""WITH rows AS (SELECT o_orderkey AS Id, substr(o_orderpriority, 1, 1)::int AS class FROM orders),
          idx AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {unit('Id', 3)}, Id) - 1 AS pos FROM rows),
          sizes AS (SELECT class, count(*) AS n FROM rows GROUP BY 1),
          draws AS (SELECT class, draw, CASE WHEN n >= 10000 THEN floor({unit('class', 'draw', 3)} * n)::bigint
              ELSE draw END AS pos FROM sizes, range(0, 10000) t(draw) WHERE draw < n)
        SELECT Id, class, draw FROM idx JOIN draws USING (class, pos)""",
    ),
)
def sample_with_replacement(spark, d):
    rows = V.table(spark, d, "orders").selectExpr(
        "o_orderkey AS Id", "CAST(substr(o_orderpriority, 1, 1) AS int) AS class"
    )
    return M.draw_with_replacement(rows, "class", "Id", 10_000, 3)


@query(
    "shuffle_rows",
    V.sql(f"SELECT Id, row_number() OVER (ORDER BY {unit('Id', 21)}, Id) - 1 AS pos FROM sales", "sales"),
)
def shuffle_rows(spark, d):
    return M.shuffle_rows(V.sales(spark, d).select("Id"), "Id", 21)


@query(
    "class_balance_weights",
    V.sql(
        """WITH c AS (SELECT TripType, count(*) AS n FROM basket GROUP BY 1)
        SELECT VisitNumber, b.TripType, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n)::double, 9) AS weight
        FROM basket b JOIN c USING (TripType)""",
        "basket",
    ),
)
def class_balance_weights(spark, d):
    rows = V.basket(spark, d).select("VisitNumber", "TripType")
    return M.weigh_classes(rows, "TripType").withColumn("weight", F.round("weight", 9))
