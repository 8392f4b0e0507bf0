"""Training and scoring as Spark ML jobs.

Every function takes assembled frames (a vector column ``features``) and returns a scored DataFrame or
a small table of scores; nothing but fitted models and scores reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from math import log
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairn.functions.columns import hash_unit
from cairn.operators import metrics as K
from cairn.operators.ordering import fit_row
from cairn.operators.sample import bootstrap_counts, split_holdout, weigh_classes
from cairn.sources.scratch import cut_lineage, scratch_path


@contextmanager
def cached(*frames: DataFrame) -> Iterator[list[DataFrame]]:
    """Keep frames that an iterative fit reads many times; spills to disk, rebuilt if an executor goes."""
    held = [f.persist(StorageLevel.MEMORY_AND_DISK) for f in frames]
    try:
        yield held
    finally:
        for f in held:
            f.unpersist()


def assemble(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Vector of the named columns (nulls as 0) beside the columns to keep."""
    filled = df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_f_{c}") for c in columns])
    vectors = VectorAssembler(inputCols=[f"_f_{c}" for c in columns], outputCol="features").transform(filled)
    return vectors.select(*keep, "features")


def assemble_array(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, array_to_vector(column).alias("features"))


# --- regression ----------------------------------------------------------------------------------


def forest(label: str = "label", trees: int = 20, depth: int = 5, seed: int = 43) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def extra_trees(label: str = "label", trees: int = 20, depth: int = 5, seed: int = 3) -> RandomForestRegressor:
    """Trees on the whole sample with random feature subsets; the split thresholds stay optimised."""
    return RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, bootstrap=False, featureSubsetStrategy="onethird"
    )


def boosted(
    label: str = "label", rounds: int = 10, depth: int = 5, eta: float = 0.3, seed: int = 1301, subsample: float = 0.9
) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=eta, subsamplingRate=subsample,
        minInstancesPerNode=6, seed=seed,
    )


def fit_predict(estimator: Estimator, train: DataFrame, test: DataFrame, name: str = "value") -> DataFrame:
    with cached(train) as (rows,):
        model = estimator.fit(rows)
    return model.transform(test).withColumnRenamed("prediction", name)


def leaf_values(model: Model, spark: SparkSession) -> list[np.ndarray]:
    """Weighted prediction of every leaf, in leaf order, for each tree of a boosted model.

    The saved form of the model is read back; its size is that of the model.
    """
    path = scratch_path(spark, "boosted")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild")
    trees: list[list[float]] = [[] for _ in model.treeWeights]
    for r in nodes.filter("leftChild < 0").orderBy("treeID", "id").collect():
        trees[r["treeID"]].append(r["prediction"] * model.treeWeights[r["treeID"]])
    return [np.array(t) for t in trees]


def staged_predictions(model: Model, df: DataFrame, name: str = "stages") -> DataFrame:
    """Array with the boosted prediction after each round: one pass finds every tree's leaf."""
    values = leaf_values(model, df.sparkSession)
    flat = np.concatenate(values)
    first = np.cumsum([0, *(len(v) for v in values[:-1])])

    @F.pandas_udf("array<double>")
    def running(leaves: pd.Series) -> pd.Series:
        return leaves.map(lambda x: np.cumsum(flat[first + np.asarray(x, dtype=int)]))

    found = model.copy({model.leafCol: "_leaf", model.predictionCol: "_whole"}).transform(df)
    return found.withColumn(name, running(vector_to_array("_leaf"))).drop("_leaf", "_whole")


def round_errors(model: Model, valid: DataFrame, label: str = "label") -> list[float]:
    """Relative error in log space after each round: one aggregate by round over the stages."""
    y = F.expm1(label)
    each = staged_predictions(model, valid).select(label, F.posexplode("stages").alias("round", "value"))
    error = F.sqrt(F.avg(F.pow(K.relative_error(y, F.expm1("value")), 2)))
    rows = each.groupBy("round").agg(error.alias("error")).orderBy("round").collect()
    return [r["error"] for r in rows]


def fit_boosted_early(
    estimator: GBTRegressor, train: DataFrame, valid: DataFrame, label: str = "label"
) -> tuple[Model, int, list[float]]:
    """Boosting that stops once held-out rows no longer gain: ``(model, rounds, errors)``.

    Training ends when the held-out squared error rises; of the rounds made, the one with the least
    relative error of the held-out rows in log space is named.
    """
    both = train.withColumn("_held", F.lit(False)).unionByName(valid.withColumn("_held", F.lit(True)))
    stopping = estimator.copy({estimator.validationIndicatorCol: "_held", estimator.validationTol: 0.0})
    with cached(both) as (rows,):
        model = stopping.fit(rows)
    scores = round_errors(model, valid, label)
    return model, scores.index(min(scores)) + 1, scores


def predict_rounds(model: Model, df: DataFrame, rounds: int, name: str = "value") -> DataFrame:
    """Boosted prediction cut after ``rounds`` rounds."""
    staged = staged_predictions(model, df)
    return staged.withColumn(name, F.get("stages", F.lit(rounds - 1))).drop("stages")


def fit_adaboost_r2(
    train: DataFrame, label: str = "label", rounds: int = 5, depth: int = 3, seed: int = 477
) -> tuple[list[Model], list[float]]:
    """AdaBoost.R2 with linear loss: trees and their log weights.

    A round fits one tree, scores the rows with it, and takes one small aggregate; the rows with their
    new weights are written, so no round runs through earlier trees. A perfect tree ends the rounds.
    """
    models: list[Model] = []
    weights: list[float] = []
    current = cut_lineage(train.withColumn("_w", F.lit(1.0)))
    for i in range(rounds):
        tree = DecisionTreeRegressor(labelCol=label, weightCol="_w", maxDepth=depth, seed=seed + i)
        model = tree.fit(current)
        scored = model.transform(current).withColumn("_e", F.abs(F.col(label) - F.col("prediction")))
        at = fit_row(scored, {"e": F.max("_e"), "s": F.sum(F.col("_w") * F.col("_e")), "w": F.sum("_w")})
        if not at["e"]:
            models.append(model)
            weights.append(max([1.0, *weights]))
            break
        mean = at["s"] / at["w"] / at["e"]
        if mean >= 0.5:
            break
        beta = mean / (1 - mean)
        models.append(model)
        weights.append(-log(beta))
        weight = F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / at["e"])
        if i + 1 < rounds:
            current = cut_lineage(scored.withColumn("_w", weight).select(*current.columns))
    if not models:
        raise ValueError("the first tree is no better than chance; use deeper trees")
    return models, weights


def predict_adaboost_r2(models: Sequence[Model], weights: Sequence[float], df: DataFrame, name: str = "value") -> DataFrame:
    """Weighted median of the trees' predictions."""
    out = df
    for i, m in enumerate(models):
        out = m.copy({m.predictionCol: f"_t{i}"}).transform(out)
    pairs = F.array_sort(
        F.array(*[F.struct(F.col(f"_t{i}").alias("p"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    )
    half = sum(weights) / 2
    state = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("p"))
    picked = F.aggregate(
        pairs,
        state,
        lambda a, x: F.struct(
            (a["s"] + x["w"]).alias("s"),
            F.coalesce(a["p"], F.when(a["s"] + x["w"] >= half, x["p"])).alias("p"),
        ),
        lambda a: a["p"],
    )
    return out.withColumn(name, picked).drop(*[f"_t{i}" for i in range(len(models))])


def lasso(label: str, alpha: float = 0.4) -> LinearRegression:
    return LinearRegression(labelCol=label, regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=100)


# --- classification ------------------------------------------------------------------------------


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    return weigh_classes(df, label, "weight")


def logistic(rows: int, c: float = 1.0, iterations: int = 20, l1: float = 0.0, weighted: bool = True) -> LogisticRegression:
    """Multinomial regression; ``c`` is the inverse strength summed over ``rows`` rows."""
    model = LogisticRegression(
        family="multinomial", regParam=1.0 / (c * max(rows, 1)), elasticNetParam=l1, maxIter=iterations
    )
    return model.setWeightCol("weight") if weighted else model


def forest_classifier(trees: int = 10, depth: int = 5, leaf: int = 10, seed: int = 43, weighted: bool = True):
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return model.setWeightCol("weight") if weighted else model


def boosted_classifier(rounds: int = 5, depth: int = 3, eta: float = 0.3, seed: int = 1, weight: str | None = None):
    """One boosted binary model per class."""
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=eta, seed=seed)
    model = OneVsRest(classifier=one, rawPredictionCol="rawPrediction", parallelism=4)
    return model.setWeightCol(weight) if weight else model


def linear_svc(iterations: int = 10, reg: float = 0.01) -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=reg), rawPredictionCol="rawPrediction", parallelism=4)


def network(layers: Sequence[int], iterations: int = 30, seed: int = 7) -> MultilayerPerceptronClassifier:
    """Feed-forward network with sigmoid layers and a softmax output."""
    return MultilayerPerceptronClassifier(layers=list(layers), maxIter=iterations, blockSize=128, seed=seed)


def score_classes(model: Model, df: DataFrame, name: str = "p") -> DataFrame:
    """Class probabilities as an array in label order.

    Models without probabilities have their per-class margins squashed and normalised.
    """
    scored = model.transform(df)
    if "probability" in scored.columns:
        p = vector_to_array("probability")
    else:
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(odds, F.lit(0.0), lambda a, x: a + x)
        p = F.transform(odds, lambda x: F.try_divide(x, total))
    return scored.withColumn(name, p).drop("rawPrediction", "probability")


def fit_classes(estimator: Estimator, train: DataFrame, test: DataFrame, keep: Sequence[str], name: str = "p") -> DataFrame:
    with cached(train) as (rows,):
        model = estimator.fit(rows)
    return score_classes(model, test, name).select(*keep, name, F.col("prediction").cast("int").alias("prediction"))


# --- stacking, bagging, selection ----------------------------------------------------------------


def geometric_probabilities(columns: Sequence[str]) -> Column:
    """Element-wise geometric mean of probability arrays."""
    product = F.col(columns[0])
    for c in columns[1:]:
        product = F.zip_with(product, F.col(c), lambda a, b: a * b)
    return F.transform(product, lambda x: F.pow(x, 1.0 / len(columns)))


def append_probabilities(df: DataFrame, p: str) -> DataFrame:
    """Probabilities appended to the feature vector."""
    return df.withColumn("features", array_to_vector(F.concat(vector_to_array("features"), F.col(p))))


def stack_probabilities(estimators: Sequence[Estimator], base: DataFrame, rest: DataFrame) -> DataFrame:
    """Base models fitted on ``base``; ``rest`` gains the geometric mean of their probabilities."""
    out = rest
    with cached(base) as (rows,):
        for i, est in enumerate(estimators):
            out = score_classes(est.fit(rows), out, f"_p{i}").drop("prediction")
    names = [f"_p{i}" for i in range(len(estimators))]
    return append_probabilities(out.withColumn("stacked", geometric_probabilities(names)).drop(*names), "stacked")


def stack_regression(
    estimators: dict[str, Estimator], final: Estimator, base: DataFrame, second: DataFrame, test: DataFrame, keep: Sequence[str]
) -> DataFrame:
    """First-level predictions become the features of the second-level model, fitted on other rows."""
    levels = [second, test]
    with cached(base) as (rows,):
        for name, est in estimators.items():
            model = est.fit(rows)
            levels = [model.transform(f).withColumnRenamed("prediction", name) for f in levels]
    train2, test2 = (assemble(f, list(estimators), [*keep, *extra]) for f, extra in zip(levels, (["label"], [])))
    return fit_predict(final, train2, test2)


def bagged_stack(
    train: DataFrame,
    test: DataFrame,
    key: str,
    classes: int,
    replicates: int = 2,
    outer: Callable[[int], Estimator] = lambda seed: forest_classifier(5, 4, 1, seed=seed, weighted=False),
    inner: Callable[[int], Estimator] = lambda seed: boosted_classifier(3, 3, 0.46, seed=seed, weight="weight"),
) -> DataFrame:
    """Per replicate: ``outer`` on out-of-bag rows, ``inner`` on in-bag rows plus its probabilities.

    Both get the replicate's number as seed; ``inner`` must weigh rows by ``weight``, their draws.
    """
    runs = []
    for rep in range(1, replicates + 1):
        drawn = bootstrap_counts(train, key, rep).withColumn("weight", F.col("draws").cast("double"))
        with cached(drawn) as (rows,):
            outside = outer(rep).fit(rows.filter("draws = 0"))
            inside = score_classes(outside, rows.filter("draws > 0"), "_oob").drop("prediction")
            with cached(append_probabilities(inside, "_oob")) as (stacked,):
                fitted = inner(rep).fit(stacked)
        scored = append_probabilities(score_classes(outside, test, "_oob").drop("prediction"), "_oob")
        runs.append(cut_lineage(score_classes(fitted, scored, "p").select(key, "p")))
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    means = [F.avg(F.get("p", F.lit(i))) for i in range(classes)]
    return every.groupBy(key).agg(F.array(*means).alias("p"))


def seed_average(
    make: Callable[[int], Estimator], train: DataFrame, test: DataFrame, key: str, seeds: Sequence[int]
) -> DataFrame:
    """Mean prediction over runs that differ in their seed and their hold-out split."""
    runs = None
    with cached(train) as (rows,):
        for seed in seeds:
            part = split_holdout(rows, key, 0.012, seed).filter("is_test = 0")
            run = make(seed).fit(part).transform(test).select(key, F.expm1("prediction").alias("value"))
            runs = run if runs is None else runs.unionByName(run)
    return runs.groupBy(key).agg(F.avg("value").alias("value"))


def cross_validate(
    estimator: Estimator, grid: Sequence[dict], score: Evaluator, rows: DataFrame, folds: int, fold: str = "fold", parallelism: int = 1
) -> tuple[list[float], list[float]]:
    """Mean and deviation over the folds of each setting's score on the fold that its fit doesn't see.

    Fits read the cached rows through a filter: no copy of a fold is held, and no model of all rows is fitted.
    """
    found = {r[0] for r in rows.select(fold).distinct().collect()}
    if found != set(range(folds)):
        raise ValueError(f"folds 0 to {folds - 1} need rows, found {sorted(found, key=str)}")

    def one(task: tuple[int, dict]) -> float:
        k, params = task
        model = estimator.fit(rows.filter(F.col(fold) != k), params)
        return float(score.evaluate(model.transform(rows.filter(F.col(fold) == k), params)))

    tasks = [(k, m) for k in range(folds) for m in grid]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        scores = np.reshape(pool.map(inheritable_thread_target(rows.sparkSession)(one), tasks, chunksize=1), (folds, len(grid)))
    return scores.mean(axis=0).tolist(), scores.std(axis=0).tolist()


def repeated_holdout(
    make: Callable[[], Estimator], df: DataFrame, key: str, rounds: int = 10, fraction: float = 0.25, seed: int = 43
) -> DataFrame:
    """Accuracy, one-vs-rest area (second class) and confusion table of repeated hold-out fits.

    All rounds are scored into one table, so each metric is a single aggregate grouped by round.
    """
    scored = None
    with cached(df) as (rows,):
        for i in range(1, rounds + 1):
            held = hash_unit(key, seed, i) < fraction
            part = score_classes(make().fit(rows.filter(~held)), rows.filter(held), "p").select(
                F.lit(i).alias("iter"),
                "label",
                "prediction",
                F.get("p", F.lit(1)).alias("score"),
                (F.col("label") == 1).cast("int").alias("hit"),
            )
            scored = part if scored is None else scored.unionByName(part)
        scored = cut_lineage(scored)
    cells = K.confusion(scored, "label", "prediction", ["iter"]).groupBy("iter")
    table = cells.agg(F.array_sort(F.collect_list(F.struct("label", "prediction", "n"))).alias("confusion"))
    accuracy = K.accuracy(scored, "label", "prediction", ["iter"])
    return accuracy.join(K.roc_auc(scored, "hit", "score", ["iter"]), "iter").join(table, "iter")
