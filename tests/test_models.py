"""Models against constant or majority baselines on planted signals, neighbours against brute force."""

import math
import os
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F, types as T

from cairn.functions.columns import hash_unit
from cairn.operators import models as L, neighbours as N
from cairn.operators.sample import split_holdout
from cairn.sources import files
from cairn.sources.scratch import cut_lineage, scratch_path


@pytest.fixture(scope="module")
def regression(spark):
    df = spark.range(1500).select("id", *[hash_unit("id", s).alias(f"x{s}") for s in range(4)])
    df = df.withColumn("label", F.when(F.col("x0") > 0.5, 3.0).otherwise(1.0) + F.col("x1") + F.col("x2") * 0.2)
    rows = cut_lineage(split_holdout(L.assemble(df, ["x0", "x1", "x2", "x3"], ["id", "label"]), "id", 0.25, 99))
    return rows.filter("is_test = 0"), rows.filter("is_test = 1")


@pytest.fixture(scope="module")
def classes(spark):
    df = spark.range(1200).select("id", *[hash_unit("id", s).alias(f"x{s}") for s in range(3)])
    label = F.when(F.col("x0") < 0.2, 0.0).when(F.col("x1") > 0.5, 1.0).otherwise(2.0)
    rows = L.assemble(L.balanced(df.withColumn("label", label)), ["x0", "x1", "x2"], ["id", "label", "weight"])
    rows = cut_lineage(split_holdout(rows, "id", 0.25, 99))
    return rows.filter("is_test = 0"), rows.filter("is_test = 1")


def rmse(df, name="value"):
    return RegressionEvaluator(labelCol="label", predictionCol=name, metricName="rmse").evaluate(df)


def baseline(train, test):
    mean = train.agg(F.avg("label")).first()[0]
    return rmse(test.withColumn("value", F.lit(mean)))


@pytest.mark.parametrize("make", [L.forest, L.extra_trees, L.boosted, lambda: L.lasso("label", 0.01)])
def test_regressors_beat_the_mean(regression, make):
    train, test = regression
    assert rmse(L.fit_predict(make(), train, test)) < 0.7 * baseline(train, test)


def test_adaboost_beats_the_mean(regression):
    train, test = regression
    models, weights = L.fit_adaboost_r2(train, rounds=4)
    assert rmse(L.predict_adaboost_r2(models, weights, test)) < 0.6 * baseline(train, test)


def test_a_perfect_tree_ends_the_rounds(spark):
    rows = spark.range(200).selectExpr("id", "CAST(id % 4 AS double) AS x", "CAST(id % 4 AS double) AS label")
    models, weights = L.fit_adaboost_r2(L.assemble(rows, ["x"], ["id", "label"]), rounds=5, depth=4)
    assert len(models) == 1 and weights == [1.0]


def test_boosting_stops_early_and_scores_in_linear_time(regression):
    train, test = regression
    began = time.perf_counter()
    model, rounds, errors = L.fit_boosted_early(L.boosted(rounds=300, depth=2), train, test)
    assert 1 <= rounds <= len(errors) < 300 and len(errors) == len(model.treeWeights)
    assert time.perf_counter() - began < 200
    whole = L.boosted(rounds=300, depth=2).fit(train)
    began = time.perf_counter()
    assert len(L.round_errors(whole, test)) == 300
    assert time.perf_counter() - began < 30


def test_early_stopping_takes_the_best_round(regression):
    train, test = regression
    model, rounds, errors = L.fit_boosted_early(L.boosted(rounds=6), train, test)
    assert errors[rounds - 1] == min(errors)
    cut = L.predict_rounds(model, test, len(errors)).select("id", "value")
    full = model.transform(test).select("id", "prediction")
    worst = cut.join(full, "id").agg(F.max(F.abs(F.col("value") - F.col("prediction")))).first()[0]
    assert worst < 1e-9


def test_stacked_regression_beats_the_mean(regression):
    train, test = regression
    half = split_holdout(train.drop("is_test"), "id", 0.5, 2)
    out = L.stack_regression(
        {"a": L.forest(trees=5), "b": L.boosted(rounds=3)},
        L.boosted(rounds=5, depth=3),
        half.filter("is_test = 0"),
        half.filter("is_test = 1"),
        test.drop("is_test"),
        ["id"],
    )
    assert rmse(out.join(test.select("id", "label"), "id")) < 0.7 * baseline(train, test)


CLASSIFIERS = [
    lambda n: L.logistic(n),
    lambda n: L.forest_classifier(5, 4),
    lambda n: L.boosted_classifier(3, 3),
    lambda n: L.linear_svc(),
    lambda n: L.network([3, 6, 3], 60),
]


@pytest.mark.parametrize("make", CLASSIFIERS)
def test_classifiers_beat_the_majority(classes, make):
    train, test = classes
    out = L.fit_classes(make(train.count()), train, test, ["id", "label"]).cache()
    hit = out.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0]
    share = test.groupBy("label").count().agg(F.max("count")).first()[0] / test.count()
    assert hit > share + 0.1
    total = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1)
    assert out.agg(F.max(total)).first()[0] < 1e-6


def test_bagged_stack_gives_probabilities(classes):
    train, test = classes
    out = L.bagged_stack(train.select("id", "label", "features"), test.select("id", "features"), "id", 3, 2)
    total = F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1)
    assert out.count() == test.count() and out.agg(F.max(total)).first()[0] < 1e-6


def test_repeated_holdout_has_a_row_per_round(classes):
    train, _ = classes
    out = L.repeated_holdout(lambda: L.logistic(900, iterations=5), train.drop("is_test"), "id", rounds=3).collect()
    assert sorted(r["iter"] for r in out) == [1, 2, 3] and all(r["accuracy"] > 0.5 for r in out)


@pytest.mark.parametrize("pivots", [1, 12, 150])
def test_neighbours_equal_brute_force(spark, pivots, monkeypatch):
    monkeypatch.setattr(N, "TRAIN_CHUNK", 60)
    monkeypatch.setattr(N, "QUERY_CHUNK", 40)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 12, size=(500, 3))
    points[: 180] = [5, 5, 5]  # a third of all rows in one place
    rows = [(i, *map(int, p), float(i % 13)) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id bigint, a int, b int, c int, y double")
    train, queries = df.filter("id % 5 > 0"), df.filter("id % 5 = 0")
    got = {r["id"]: r["y"] for r in N.knn_regress(train, queries, "id", ["a", "b", "c"], "y", 9, pivots).collect()}
    have = [r for r in rows if r[0] % 5]
    asked = [r for r in rows if r[0] % 5 == 0]
    assert len(got) == len(asked)
    for q in asked:
        near = sorted((sum((q[j] - t[j]) ** 2 for j in (1, 2, 3)), t[0], t[4]) for t in have)[:9]
        exact = [y for d2, _, y in near if d2 == 0]
        want = (
            sum(exact) / len(exact)
            if exact
            else sum(y / math.sqrt(d2) for d2, _, y in near) / sum(1 / math.sqrt(d2) for d2, _, _ in near)
        )
        assert got[q[0]] == pytest.approx(want, abs=1e-9)


def test_renamed_and_template_files(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType())])
    path = files.write_predictions(spark.createDataFrame([(1, 2.5), (2, None)], "Id bigint, Sales double"), scratch_path(spark, "t"))
    assert sorted(tuple(r) for r in files.read_csv_renamed(spark, path, schema).collect()) == [(1, 2.5), (2, None)]
    template = spark.createDataFrame([(2,), (1,), (9,)], "Id bigint")
    preds = spark.createDataFrame([(1, 0.5), (2, 0.25)], "Id bigint, p double")
    got = {r["Id"]: r["p"] for r in files.submission_from_template(template, preds, "Id", ["p"]).collect()}
    assert got == {1: 0.5, 2: 0.25, 9: 0.0}


def compared_share(spark, folder):
    """Share of all pairs of test and training days that the search compares."""
    from cairn.operators import features as X
    from cairn.plans import views as V
    from cairn.plans.q_models import KNN_FEATURES

    rows = X.add_date_parts(V.sales(spark, folder)).withColumn("y", F.log1p("Sales"))
    train, asked = V.train(rows).select("Id", *KNN_FEATURES, "y"), V.test(rows).select("Id", *KNN_FEATURES)
    n = train.count()
    picked = train.orderBy(hash_unit("Id", 0), "Id").select(*KNN_FEATURES).limit(N.pivot_count(n)).collect()
    centres = np.unique(np.array([tuple(r) for r in picked], dtype="float64"), axis=0)
    cells = cut_lineage(N.assign_cells(train, KNN_FEATURES, centres))
    summary = N.cell_summary(cells, "Id", 9)
    cuts = N.radius_cuts(cells, summary)
    sizes = N.slice_rows(cells, cuts).groupBy("cell", "slice").agg(F.count("*").alias("n"))
    visits = N.slice_visits(N.visit_plan(asked, KNN_FEATURES, centres, summary, 9), cuts)
    return visits.join(sizes, ["cell", "slice"]).agg(F.sum("n")).first()[0] / (n * asked.count())


def test_the_share_of_compared_pairs_falls(spark):
    assert compared_share(spark, "/root/testdata/sf0.01") < 0.5 * compared_share(spark, "/root/testdata/sf0.001")


def test_a_query_learns_its_bound_from_its_own_cell(spark, monkeypatch):
    plan, visits = N.visit_plan, []

    def spy(queries, features, pivots, summary, k, known=None):
        out = plan(queries, features, pivots, summary, k, known)
        loose = plan(queries.drop(known) if known else queries, features, pivots, summary, k)
        visits.append((out.count(), loose.count()))
        return out

    monkeypatch.setattr(N, "visit_plan", spy)
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.normal(size=2)), float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double")
    assert N.nearest(df, df.filter("id % 10 = 0"), "id", ["a", "b"], "y", 3).filter("id = other AND d2 = 0").count() == 300
    assert [tight < 0.7 * loose for tight, loose in visits] == [True]


@pytest.mark.parametrize("far", [False, True])
def test_blocks_compare_few_rows_and_lose_none(far, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 30, size=(4000, 3)).astype(float)
    x[1000:2300] = [7, 7, 7]  # a place with far more than k rows
    q = np.concatenate([x[::25], rng.normal(15, 12, size=(100, 3))])
    limit = np.where(np.arange(len(q)) % 3 == 0, 1.5, np.inf)
    if far:
        x, q = x + 1e9, q + 1e9
    compared, count = N.Blocks._to_rows, []
    monkeypatch.setattr(N.Blocks, "_to_rows", lambda self, a, b: count.append(len(a) * N.LEAF) or compared(self, a, b))
    monkeypatch.setattr(N, "BLOCK", 5000)
    got = {}
    for at, row, d2 in N.Blocks(x, 9).search(q, limit):
        for a, r, d in zip(at.tolist(), row.tolist(), d2.tolist()):
            got.setdefault(a, []).append((d, r))
    for i in range(len(q)):
        near = sorted(zip(((q[i] - x) ** 2).sum(axis=1).tolist(), range(len(x))))[:9]
        assert got.get(i, []) == [n for n in near if n[0] <= limit[i] ** 2]
    assert sum(count) < 0.15 * len(q) * len(x)


def test_neighbours_of_places_far_from_the_origin(spark):
    rows = [(i, 1e9 * (i % 3) + i % 40 / 8.0, i % 7 / 4.0, float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, y double")
    got = N.nearest(df, df.filter("id % 9 = 0"), "id", ["a", "b"], "y", 2, 40).groupBy("id").agg(F.array_sort(F.collect_list("other")))
    for q, found in got.collect():
        near = sorted(((rows[q][1] - r[1]) ** 2 + (rows[q][2] - r[2]) ** 2, r[0]) for r in rows)[:2]
        assert found == sorted(r for _, r in near)


def test_neighbours_with_nulls_and_text_keys(spark):
    rows = [(f"k{i:02d}", float(i), None if i == 3 else 1.0, float(i)) for i in range(40)] + [("x", 5.0, 1.0, None)]
    train = spark.createDataFrame(rows, "id string, a double, b double, y double")
    asked = spark.createDataFrame([("q1", 5.2, 1.0), ("q2", None, 1.0), ("q3", 3.0, 1.0)], "id string, a double, b double")
    got = {r["id"]: r["y"] for r in N.knn_regress(train, asked, "id", ["a", "b"], "y", k=1).collect()}
    assert got["q1"] == 5.0 and got["q2"] is None and got["q3"] in (2.0, 4.0)
    none = N.knn_regress(train.limit(0), asked, "id", ["a", "b"], "y").collect()
    assert [r["y"] for r in none] == [None] * 3


def test_neighbours_from_another_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from cairn.session import local_session\nfrom cairn.operators.neighbours import knn_regress\n"
        "s = local_session(2)\nd = s.range(50).selectExpr('id', 'id AS a', 'CAST(id AS double) AS y')\n"
        "print('rows', knn_regress(d, d, 'id', ['a'], 'y').filter('y = id').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 50" in done.stdout, done.stderr[-2000:]


def test_cross_validation_equals_the_estimator_of_spark(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = spark.createDataFrame(
        [(float(i % 2), Vectors.dense(i % 2 + (i % 7) / 5.0, i % 3), i % 3) for i in range(60)], ["label", "features", "fold"]
    ).coalesce(1)
    model = L.logistic(60, weighted=False)
    grid = ParamGridBuilder().addGrid(model.regParam, [0.01, 1.0]).build()
    score = MulticlassClassificationEvaluator(metricName="logLoss")
    want = CrossValidator(estimator=model, estimatorParamMaps=grid, evaluator=score, numFolds=3, foldCol="fold").fit(rows)
    means, deviations = L.cross_validate(model, grid, score, rows, 3, parallelism=2)
    assert means == pytest.approx(want.avgMetrics) and deviations == pytest.approx(want.stdMetrics)
    with pytest.raises(ValueError, match="folds 0 to 3"):
        L.cross_validate(model, grid, score, rows, 4)
