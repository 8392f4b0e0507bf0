"""Queries without an SQL twin: every one runs, and its result has the bounds that its kind promises."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairn.operators import encode as E
from cairn.plans import views as V

QUERIES = entry.queries()
CLASSIFIERS = ["train_gbt_multiclass", "train_linear_svc", "train_logistic", "train_mlp", "train_rf_classifier"]
REGRESSORS = ["seed_average", "stack_regression", "train_adaboost_r2", "train_extra_trees", "train_gbt_regressor", "train_rf_regressor"]
OTHERS = [
    "bagged_stack", "blend_weight_optimum", "cross_val_score", "feature_importance_topk", "grid_search", "lasso_impute_column",
    "model_save_load_score", "pca_project", "repeated_holdout_report", "score_pixels", "stack_probabilities",
]


def test_every_query_runs_somewhere():
    """All other keys are held against DuckDB, or belong to the folder of corpus operators."""
    own = {k for k in QUERIES if k not in entry.LLM_QUERIES}
    assert own - set(entry.oracle_sql()) == {*CLASSIFIERS, *REGRESSORS, *OTHERS}


def run(key, spark, sf_dir):
    return QUERIES[key](spark, sf_dir)


@pytest.mark.parametrize("key", REGRESSORS)
def test_regressions_are_near_the_truth(spark, sf_dir, key):
    truth = V.test(V.sales(spark, sf_dir)).select("Id", F.col("Sales").alias("y"))
    out = run(key, spark, sf_dir).withColumnRenamed("value", "Sales").join(truth, "Id")
    got = out.filter("y > 0").agg(
        F.count("*").alias("n"), F.avg(F.abs(F.log1p("Sales") - F.log1p("y"))).alias("e"), F.stddev(F.log1p("y")).alias("s")
    ).first()
    ids = [r["Id"] for r in out.collect()]  # closed days have no features
    assert 0.9 * truth.count() <= len(ids) == len(set(ids)) and got["e"] < 1.5 * got["s"]


@pytest.mark.parametrize("key", CLASSIFIERS)
def test_classifiers_name_known_labels(spark, sf_dir, key):
    rows = run(key, spark, sf_dir).collect()
    known = {r[0] for r in V.basket(spark, sf_dir).select("TripType").distinct().collect()}
    assert rows and all(r["predicted"] in known and sum(r["p"]) == pytest.approx(1, abs=1e-6) for r in rows)


@pytest.mark.parametrize("key", ["bagged_stack", "stack_probabilities"])
def test_stacks_give_probabilities(spark, sf_dir, key):
    out = run(key, spark, sf_dir)
    p = "p" if "p" in out.columns else "stacked"
    rows = out.collect()
    assert rows and all(0 <= x <= 1 for r in rows for x in r[p]) and len({r["id"] for r in rows}) == len(rows)


def test_selection_covers_the_grid(spark, sf_dir):
    rows = run("grid_search", spark, sf_dir).collect()
    assert len(rows) == 8 and len({(r["trees"], r["min_leaf"], r["features"]) for r in rows}) == 8
    assert min(r["log_loss"] for r in rows) == next(r["log_loss"] for r in rows if r["best"])


def test_scores_lie_in_their_range(spark, sf_dir):
    r = run("cross_val_score", spark, sf_dir).first()
    assert r["folds"] == 10 and 0 < r["mean"] <= 1 and r["std"] >= 0
    rows = run("repeated_holdout_report", spark, sf_dir).collect()
    assert len(rows) == 10 and all(0 <= r["accuracy"] <= 1 and 0 <= r["auc"] <= 1 for r in rows)


def test_weights_are_no_worse_than_any_on_the_grid(spark, sf_dir):
    from cairn.operators import blend as B

    weights = {r["model"]: r["weight"] for r in run("blend_weight_optimum", spark, sf_dir).collect()}
    assert sum(weights.values()) == pytest.approx(1) and min(weights.values()) >= 0
    hits = V.class_probs(spark, sf_dir).filter(F.col("class") == F.col("truth"))
    least = B.weight_losses(hits, "Id", "model", "p", V.PROB_MODELS).agg(F.min("log_loss")).first()[0]
    wide = hits.groupBy("Id").pivot("model", list(V.PROB_MODELS)).agg(F.max("p"))
    mix = sum(F.col(m) * w for m, w in weights.items())
    assert wide.agg(-F.avg(F.ln(mix))).first()[0] <= least + 1e-7


def test_importances_are_shares(spark, sf_dir):
    values = [r["importance"] for r in run("feature_importance_topk", spark, sf_dir).collect()]
    assert len(values) == 10 and values == sorted(values, reverse=True) and 0 < sum(values) <= 1 + 1e-9


def test_imputed_column_is_finite(spark, sf_dir):
    out = run("lasso_impute_column", spark, sf_dir)
    assert out.count() == V.test(V.sales(spark, sf_dir)).count()
    assert out.filter(F.isnan("Customers_hat") | F.col("Customers_hat").isNull()).count() == 0


def test_saved_model_scores_every_visit(spark, sf_dir):
    rows = run("model_save_load_score", spark, sf_dir).collect()
    visits = V.basket(spark, sf_dir).select("VisitNumber").distinct().count()
    assert len(rows) == visits and {r["prediction"] for r in rows} <= set(range(5))


def test_components_are_centred_and_apart(spark, sf_dir):
    out = run("pca_project", spark, sf_dir)
    name = next(c for c, t in out.dtypes if t == "array<double>")
    first, second = F.get(name, F.lit(0)), F.get(name, F.lit(1))
    got = out.agg(F.avg(first).alias("m"), F.corr(first, second).alias("r"), F.var_pop(first).alias("a"), F.var_pop(second).alias("b")).first()
    assert abs(got["m"]) < 1e-6 and abs(got["r"]) < 1e-6 and got["a"] >= got["b"]


def test_every_pixel_has_a_class(spark, sf_dir):
    rows = run("score_pixels", spark, sf_dir)
    images = V.polygons(spark, sf_dir).select("ImageId").distinct().count()
    assert rows.count() == images * V.RASTER**2
    assert {r[0] for r in rows.select("ClassType").distinct().collect()} <= set(V.CLASSES)


def test_codes_come_back(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "v string")
    codes = E.label_codes(df, "v")
    back = E.decode(E.apply_codes(df, codes, "v", "code"), codes, "v", "code", "again")
    assert back.filter(~F.col("v").eqNullSafe(F.col("again"))).count() == 0


def test_sparse_vectors_of_wide_vocabularies(spark):
    df = spark.range(3000).selectExpr("concat('v', id) AS a", "CASE WHEN id % 2 = 0 THEN id % 5 END AS b")
    rows = E.one_hot_sparse(df, ["a", "b"]).select("features.*").collect()
    assert {r["size"] for r in rows} == {3005} and {len(r["indices"]) for r in rows} == {1, 2}
    assert all(list(r["indices"]) == sorted(r["indices"]) and set(r["values"]) == {1.0} for r in rows)
