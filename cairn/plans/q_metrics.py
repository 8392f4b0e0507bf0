"""Metrics and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import blend as B, metrics as K
from cairn.plans import views as V
from cairn.plans.q_stats import rounded
from cairn.plans.registry import query


@query(
    "metric_rmspe",
    V.sql(
        "SELECT model, round(sqrt(avg(pow((truth - value) / nullif(truth, 0), 2))), 6) AS rmspe FROM predictions GROUP BY 1",
        "predictions",
    ),
)
def metric_rmspe(spark, d):
    return rounded(K.rmspe(V.predictions(spark, d), "truth", "value", ["model"]), ["rmspe"])


@query(
    "metric_rmspe_log",
    V.sql(
        """SELECT model, round(sqrt(avg(pow(((exp(y) - 1) - (exp(p) - 1)) / nullif(exp(y) - 1, 0), 2))), 6) AS rmspe
           FROM (SELECT model, ln(1 + truth) AS y, ln(1 + value) AS p FROM predictions) GROUP BY 1""",
        "predictions",
    ),
)
def metric_rmspe_log(spark, d):
    logged = V.predictions(spark, d).select("model", F.log1p("truth").alias("y"), F.log1p("value").alias("p"))
    return rounded(K.rmspe(logged, "y", "p", ["model"], log=True), ["rmspe"])


TOP_SQL = """top AS (SELECT Id, model, truth, class AS pred FROM (
  SELECT *, row_number() OVER (PARTITION BY Id, model ORDER BY round(p, 9) DESC, class) AS rn FROM class_probs)
  WHERE rn = 1)"""


def top_class(spark, d):
    """Most probable class per id and model; ties go to the lower class."""
    # One long holds the rounded probability and the class, so that the maximum aggregates without a sort.
    score = F.round(F.round("p", 9) * 1e9).cast("long") * 1024 + (1023 - F.col("class"))
    best = V.class_probs(spark, d).groupBy("Id", "model", "truth").agg(F.max(score).alias("_best"))
    return best.select("Id", "model", "truth", (1023 - F.col("_best") % 1024).cast("int").alias("pred"))


@query(
    "metric_accuracy",
    V.sql(f"WITH {TOP_SQL} SELECT model, round(avg((truth = pred)::int), 6) AS accuracy FROM top GROUP BY 1", "class_probs"),
)
def metric_accuracy(spark, d):
    return rounded(K.accuracy(top_class(spark, d), "truth", "pred", ["model"]), ["accuracy"])


@query(
    "metric_confusion",
    V.sql(f"WITH {TOP_SQL} SELECT model, truth, pred, count(*) AS n FROM top GROUP BY 1, 2, 3", "class_probs"),
)
def metric_confusion(spark, d):
    return K.confusion(top_class(spark, d), "truth", "pred", ["model"])


@query(
    "metric_roc_auc",
    V.sql(
        """WITH s AS (SELECT model, class, round(p, 9) AS p, sum((truth = class)::int)::double AS pos,
             sum((truth <> class)::int)::double AS neg FROM class_probs GROUP BY 1, 2, 3),
          r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, class ORDER BY p
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT model, class, round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc
        FROM r GROUP BY 1, 2""",
        "class_probs",
    ),
)
def metric_roc_auc(spark, d):
    """One-vs-rest area per model and class."""
    rows = V.class_probs(spark, d).select(
        "model", "class", F.round("p", 9).alias("p"), (F.col("truth") == F.col("class")).cast("int").alias("hit")
    )
    return rounded(K.roc_auc(rows, "hit", "p", ["model", "class"]), ["auc"])


@query(
    "metric_log_loss",
    V.sql(
        """SELECT model, round(-avg(ln(least(greatest(hit / total, 1e-15::double), 1 - 1e-15::double))), 6) AS log_loss
           FROM (SELECT Id, model, sum(CASE WHEN class = truth THEN p END) AS hit, sum(p) AS total
             FROM class_probs GROUP BY 1, 2) GROUP BY 1""",
        "class_probs",
    ),
)
def metric_log_loss(spark, d):
    return rounded(K.log_loss(V.class_probs(spark, d), ["Id"], "truth", "class", "p", ["model"]), ["log_loss"])


@query(
    "metric_binary_log_loss",
    V.sql(
        """SELECT model, class, round(-avg((truth = class)::int * ln(p) + (1 - (truth = class)::int) * ln(1 - p)), 6) AS log_loss
           FROM (SELECT * REPLACE (least(greatest(p, 1e-15::double), 1 - 1e-15::double) AS p) FROM class_probs)
           GROUP BY 1, 2""",
        "class_probs",
    ),
)
def metric_binary_log_loss(spark, d):
    rows = V.class_probs(spark, d).withColumn("hit", (F.col("truth") == F.col("class")).cast("int"))
    return rounded(K.binary_log_loss(rows, "hit", "p", ["model", "class"]), ["log_loss"])


@query("metric_mae", V.sql("SELECT model, round(avg(abs(truth - value)), 4) AS mae FROM predictions GROUP BY 1", "predictions"))
def metric_mae(spark, d):
    return rounded(K.mae(V.predictions(spark, d), "truth", "value", ["model"]), ["mae"], 4)


@query(
    "metric_r2",
    V.sql(
        """SELECT model, round(1 - sum(pow(truth - value, 2)) / (var_pop(truth) * count(truth)), 6) AS r2
           FROM predictions GROUP BY 1""",
        "predictions",
    ),
)
def metric_r2(spark, d):
    return rounded(K.r2(V.predictions(spark, d), "truth", "value", ["model"]), ["r2"])


@query(
    "metric_jaccard",
    V.sql(
        f"""WITH {TOP_SQL}, m AS (SELECT model, c.class, (truth = c.class)::int AS t, (pred = c.class)::int AS p
          FROM top CROSS JOIN (VALUES (1),(2),(3),(4),(5)) c(class)),
          j AS (SELECT model, class, (sum(t * p) + 1e-12::double) / (sum(t + p) - sum(t * p) + 1e-12::double) AS j
            FROM m GROUP BY 1, 2)
        SELECT model, round(avg(j), 6) AS jaccard, count(*) AS classes FROM j GROUP BY 1""",
        "class_probs",
    ),
)
def metric_jaccard(spark, d):
    """Overlap of true and predicted class masks of each model, averaged over the classes."""
    rows = top_class(spark, d).withColumn("class", F.explode(F.array(*map(F.lit, V.CLASSES))))
    masks = rows.select(
        "model",
        "class",
        (F.col("truth") == F.col("class")).cast("int").alias("t"),
        (F.col("pred") == F.col("class")).cast("int").alias("p"),
    )
    return rounded(K.jaccard(masks, "t", "p", "class", ["model"]), ["jaccard"])


# --- blends --------------------------------------------------------------------------------------

WEIGHTS = {"m1": 0.85, "m2": 0.05, "m3": 0.05, "m4": 0.05}
SECOND = {"m1": 0.75, "m2": 0.15, "m3": 0.05, "m4": 0.05}


def weighted_sql(weights: dict[str, float], value: str) -> str:
    return "sum(CASE model " + " ".join(f"WHEN '{m}' THEN {w}::double" for m, w in weights.items()) + f" END * {value})"


@query("blend_equal", V.sql("SELECT Id, round(avg(value), 7) AS value FROM predictions GROUP BY 1", "predictions"))
def blend_equal(spark, d):
    return rounded(B.blend_equal(V.predictions(spark, d), "Id", "value"), ["value"], 7)


@query(
    "blend_log_weighted",
    V.sql(
        f"""SELECT Id, round({weighted_sql(WEIGHTS, 'ln(1 + value)')}, 6) AS value,
             round({weighted_sql(SECOND, 'ln(1 + value)')}, 6) AS second FROM predictions GROUP BY 1""",
        "predictions",
    ),
)
def blend_log_weighted(spark, d):
    """Both published weightings, left in log space."""
    rows = V.predictions(spark, d)
    first = B.blend_weighted(rows, "Id", "model", "value", WEIGHTS, log=True)
    second = B.blend_weighted(rows, "Id", "model", "value", SECOND, log=True).withColumnRenamed("value", "second")
    return rounded(first.join(second, "Id"), ["value", "second"])


@query(
    "blend_linear_weighted",
    V.sql(f"SELECT Id, round({weighted_sql(WEIGHTS, 'value')}, 7) AS value FROM predictions GROUP BY 1", "predictions"),
)
def blend_linear_weighted(spark, d):
    return rounded(B.blend_weighted(V.predictions(spark, d), "Id", "model", "value", WEIGHTS), ["value"], 7)


@query(
    "blend_two_level",
    V.sql(
        f"""SELECT Id, round(0.5 * {weighted_sql(WEIGHTS, 'value')} + 0.5 * max(CASE WHEN model = 'm3' THEN value END), 7)
             AS value FROM predictions GROUP BY 1""",
        "predictions",
    ),
)
def blend_two_level(spark, d):
    """Half the weighted blend, half one of its models."""
    rows = V.predictions(spark, d)
    blended = B.blend_weighted(rows, "Id", "model", "value", WEIGHTS).withColumn("model", F.lit("blend"))
    single = rows.filter("model = 'm3'").select("Id", "value", F.lit("single").alias("model"))
    both = blended.unionByName(single)
    return rounded(B.blend_weighted(both, "Id", "model", "value", {"blend": 0.5, "single": 0.5}), ["value"], 7)


@query(
    "seed_average_table",
    V.sql("SELECT Id, round(sum(value) / (3 + 1), 7) AS value FROM predictions GROUP BY 1", "predictions"),
)
def seed_average_table(spark, d):
    """Base run plus three further runs, divided by their number."""
    return rounded(B.blend_equal(V.predictions(spark, d), "Id", "value"), ["value"], 7)


@query(
    "blend_weight_search",
    V.sql(
        """WITH t AS (SELECT Id, max(CASE WHEN model='m1' THEN p END) AS a, max(CASE WHEN model='m2' THEN p END) AS b,
             max(CASE WHEN model='m3' THEN p END) AS c FROM class_probs WHERE class = truth GROUP BY 1),
          g AS (SELECT i / 20.0::double AS w0, j / 20.0::double AS w1, (20 - i - j) / 20.0::double AS w2
             FROM range(0, 21) x(i), range(0, 21) y(j) WHERE i + j <= 20),
          l AS (SELECT w0, w1, w2, round(-avg(ln(w0*a + w1*b + w2*c)), 9) AS log_loss FROM t, g GROUP BY 1, 2, 3)
        SELECT w0, w1, w2, round(log_loss, 6) AS log_loss FROM l ORDER BY l.log_loss, w0 DESC, w1 DESC, w2 DESC LIMIT 1""",
        "class_probs",
    ),
)
def blend_weight_search(spark, d):
    """Weights on the simplex that minimise the log loss of the blended true-class probability."""
    hits = V.class_probs(spark, d).filter(F.col("class") == F.col("truth"))
    losses = B.weight_losses(hits, "Id", "model", "p", V.PROB_MODELS)
    return rounded(B.best_weights(losses, 3), ["log_loss"])


@query("blend_weight_optimum")
def blend_weight_optimum(spark, d):
    """The continuous minimum of the same loss, a row per model."""
    hits = V.class_probs(spark, d).filter(F.col("class") == F.col("truth"))
    weights = B.mixture_weights(hits, "Id", "model", "p", V.PROB_MODELS)
    return spark.createDataFrame(list(zip(V.PROB_MODELS, weights)), "model string, weight double")


@query(
    "blend_geometric",
    V.sql(
        "SELECT Id, class, round(pow(product(p), 1 / 3.0::double), 6) AS p FROM class_probs GROUP BY 1, 2",
        "class_probs",
    ),
)
def blend_geometric(spark, d):
    return rounded(B.blend_geometric(V.class_probs(spark, d), ["Id", "class"], "p"), ["p"])
