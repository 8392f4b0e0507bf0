"""Training, scoring, stacking and model selection.

Each query builds its feature frame, writes it to the shared folder and reads it back for the fit.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from cairn.operators import encode as E, features as X, models as L, raster as G
from cairn.operators.neighbours import knn_regress as knn
from cairn.operators.ordering import fit_row
from cairn.operators.sample import draw_with_replacement, split_holdout, split_kfold
from cairn.plans import views as V
from cairn.plans.q_features import joined, retail_with_stats
from cairn.plans.q_raster import mask_of
from cairn.plans.registry import query
from cairn.sources.scratch import cut_lineage, scratch_path

RETAIL_COLUMNS = [*X.RETAIL_FEATURES, "Sales_mean", "sales_median", "sales_max", "sales_min", "promotion_time", "buying"]
FIT_ROWS = 4096  # of a task that fits on pixels
BASKET_COLUMNS = ["FinelineNumber", "Upc", "Department", "ScanCount", "Count", "WeekdayNumber", *X.BASKET_RATIOS]


def retail_frames(spark, d):
    """Train and test vectors; the feature table is written once and both sides read it back."""
    table = retail_with_stats(spark, d).withColumn("label", F.log1p("Sales"))
    rows = cut_lineage(L.assemble(table, RETAIL_COLUMNS, ["Id", "side", "label"]))
    return rows.filter("side = 'train'"), rows.filter("side = 'test'")


def basket_rows(spark, d):
    """Vectors of all visits with balanced weights."""
    visits = cut_lineage(X.build_basket_features(V.basket(spark, d)))
    coded = E.apply_codes(visits, E.label_codes(visits, "TripType"), "TripType", "code")
    table = L.balanced(coded, "code").withColumn("label", F.col("code").cast("double"))
    scaled = E.scale_minmax(table, BASKET_COLUMNS, fit=visits)
    return cut_lineage(L.assemble(scaled, BASKET_COLUMNS, ["VisitNumber", "label", "weight", "TripType"]))


def basket_frames(spark, d):
    """All visits, split 88/12."""
    split = split_holdout(basket_rows(spark, d), "VisitNumber", 0.12, 10)
    return split.filter("is_test = 0"), split.filter("is_test = 1")


def _classes(make):
    """Fit on the training visits; codes of the held-out ones go back to their labels."""

    def run(spark, d):
        train, test = basket_frames(spark, d)
        codes = train.unionByName(test).select(F.col("label").cast("int").alias("code"), "TripType").distinct()
        scored = L.fit_classes(make(train), train, test, ["VisitNumber", "label"])
        return E.decode(scored, codes, "TripType", "prediction", "predicted")

    return run


def product_frames(spark, d, fraction: float = 0.2):
    """Standardised product vectors, split by hash."""
    sizes = V.product(spark, d).withColumn("features", F.transform("features", F.abs))
    scaled = E.log_standardize(sizes, "features", 64)
    rows = E.apply_codes(scaled, E.label_codes(scaled, "target"), "target", "code")
    rows = L.assemble_array(rows.withColumn("label", F.col("code").cast("double")), "features", ["id", "label"])
    split = cut_lineage(split_holdout(rows, "id", fraction, 21))
    return split.filter("is_test = 0"), split.filter("is_test = 1")


def _sales(predicted):
    return predicted.select("Id", F.expm1("value").alias("Sales"))


def _regression(estimator):
    def run(spark, d):
        train, test = retail_frames(spark, d)
        return _sales(L.fit_predict(estimator(), train, test))

    return run


query("train_rf_regressor")(_regression(L.forest))
query("train_extra_trees")(_regression(L.extra_trees))


@query("train_adaboost_r2")
def train_adaboost_r2(spark, d):
    train, test = retail_frames(spark, d)
    models, weights = L.fit_adaboost_r2(train)
    return _sales(L.predict_adaboost_r2(models, weights, test))


@query("train_gbt_regressor")
def train_gbt_regressor(spark, d):
    """Boosting cut at the round with the lowest held-out relative error."""
    train, test = retail_frames(spark, d)
    split = split_holdout(train, "Id", 0.012, 10)
    model, rounds, _ = L.fit_boosted_early(L.boosted(), split.filter("is_test = 0"), split.filter("is_test = 1"))
    return _sales(L.predict_rounds(model, test, rounds))


KNN_FEATURES = ["Store", "Promo", "SchoolHoliday", "DayOfWeek", "Month", "Day"]
KNN_D2 = " + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in KNN_FEATURES)


@query(
    "knn_regress",
    V.sql(
        f"""WITH f AS (SELECT Id, Store, Promo, SchoolHoliday, (isodow(Date) - 1) AS DayOfWeek, month(Date) AS Month,
             day(Date) AS Day, Date < DATE '2000-01-01' AS is_train, ln(1 + Sales) AS y FROM sales),
          n AS (SELECT q.Id, unnest(min_by({{'d2': {KNN_D2}, 'y': t.y}}, ({KNN_D2}) * 1000000000 + t.Id, 9)) AS r
             FROM f q, f t WHERE NOT q.is_train AND t.is_train GROUP BY q.Id)
        SELECT Id, round(coalesce(avg(CASE WHEN r.d2 = 0 THEN r.y END),
          sum(r.y / sqrt(nullif(r.d2, 0))) / sum(1 / sqrt(nullif(r.d2, 0)))), 6) AS log_sales FROM n GROUP BY 1""",
        "sales",
    ),
)
def knn_regress(spark, d):
    """Nine nearest training days of each test day, weighted by 1/distance, in log space."""
    rows = X.add_date_parts(V.sales(spark, d)).withColumn("log_sales", F.log1p("Sales"))
    out = knn(V.train(rows), V.test(rows), "Id", KNN_FEATURES, "log_sales", k=9)
    return out.withColumn("log_sales", F.round("log_sales", 6))


@query("lasso_impute_column")
def lasso_impute_column(spark, d):
    """Customers of the test days predicted from their other columns."""
    table = X.build_retail_features(joined(spark, d))
    rows = L.assemble(table, X.RETAIL_FEATURES, ["Id", "Date", "Customers"]).withColumn(
        "label", F.col("Customers").cast("double")
    )
    return L.fit_predict(L.lasso("label"), V.train(rows), V.test(rows), "Customers_hat").select("Id", "Customers_hat")


def _network(train):
    return L.network([len(BASKET_COLUMNS), 16, len(V.CLASSES)])


query("train_logistic")(_classes(lambda train: L.logistic(train.count(), c=0.1)))
query("train_rf_classifier")(_classes(lambda _: L.forest_classifier()))
query("train_gbt_multiclass")(_classes(lambda _: L.boosted_classifier()))
query("train_linear_svc")(_classes(lambda _: L.linear_svc()))
query("train_mlp")(_classes(_network))


def _base_models():
    return [L.linear_svc(), L.forest_classifier(5, 4, 1, weighted=False), L.boosted_classifier(3, 3)]


@query("stack_probabilities")
def stack_probabilities(spark, d):
    """Three base models fitted on half the products; the other half gains their blended probabilities."""
    base, rest = product_frames(spark, d, 0.5)
    return L.stack_probabilities(_base_models(), base, rest).select("id", "label", "stacked")


@query("stack_regression")
def stack_regression(spark, d):
    train, test = retail_frames(spark, d)
    split = split_holdout(train, "Id", 0.5, 12)
    first = {"forest": L.forest(trees=10), "extra": L.extra_trees(trees=10), "boost": L.boosted(rounds=5)}
    out = L.stack_regression(
        first, L.boosted(rounds=5, depth=3), split.filter("is_test = 0"), split.filter("is_test = 1"), test, ["Id"]
    )
    return _sales(out)


@query("bagged_stack")
def bagged_stack(spark, d):
    train, test = product_frames(spark, d)
    return L.bagged_stack(train, test, "id", len(V.TARGETS))


@query("grid_search")
def grid_search(spark, d):
    """Log loss of every forest setting on three folds of all visits."""
    forest = L.forest_classifier(trees=5, depth=4)
    grid = (
        ParamGridBuilder()
        .addGrid(forest.numTrees, [5, 10])
        .addGrid(forest.minInstancesPerNode, [5, 10])
        .addGrid(forest.featureSubsetStrategy, ["sqrt", "all"])
        .build()
    )
    folds = split_kfold(basket_rows(spark, d), "VisitNumber", 3)
    score = MulticlassClassificationEvaluator(metricName="logLoss", weightCol="weight")
    with L.cached(folds) as (rows,):
        means, _ = L.cross_validate(forest, grid, score, rows, 3, parallelism=4)
    named = [
        (int(m[forest.numTrees]), int(m[forest.minInstancesPerNode]), m[forest.featureSubsetStrategy], v)
        for m, v in zip(grid, means)
    ]
    best = min(v for *_, v in named)
    return spark.createDataFrame(
        [(*r, r[-1] == best) for r in named],
        "trees int, min_leaf int, features string, log_loss double, best boolean",
    )


@query("cross_val_score")
def cross_val_score(spark, d):
    """Mean and deviation of the accuracy over ten contiguous folds."""
    rows = basket_rows(spark, d)
    model = L.logistic(rows.count(), iterations=5)
    score = MulticlassClassificationEvaluator(metricName="accuracy")
    with L.cached(split_kfold(rows, "VisitNumber", 10)) as (folds,):
        (mean,), (std,) = L.cross_validate(model, [{}], score, folds, 10)
    return spark.createDataFrame([(10, mean, std)], "folds int, mean double, std double")


@query("repeated_holdout_report")
def repeated_holdout_report(spark, d):
    rows = basket_rows(spark, d)
    n = rows.count()
    return L.repeated_holdout(lambda: L.logistic(n, iterations=5), rows, "VisitNumber")


@query("score_pixels")
def score_pixels(spark, d):
    """Class of every pixel of every image, from a classifier fitted on drawn labelled pixels.

    Vectors, labelled pixels and drawn rows are written and read back: no job plans again what comes before them.
    Spark's multinomial fit goes wrong where a task holds more than one block of rows (1 MB, about 14,000 of these).
    """
    vectors = cut_lineage(G.pixel_vectors(V.pixels(spark, d), V.BANDS))
    places = F.concat_ws("|", "ImageId", "ClassType", "y", "x").alias("place")
    marked = cut_lineage(G.labelled_pixels(mask_of(spark, d), vectors).select("ClassType", "bands", places))
    drawn = cut_lineage(draw_with_replacement(marked, "ClassType", "place", 10_000, 3))
    top = float(fit_row(vectors, {"top": F.max(F.array_max("bands"))})["top"] or 1)
    scaled = F.transform("bands", lambda b: b / top)
    drawn = drawn.withColumn("label", F.col("ClassType") - 1.0).withColumn("bands", scaled)
    rows = L.assemble_array(vectors.withColumn("bands", scaled), "bands", ["ImageId", "y", "x"])
    tasks = -(-drawn.count() // FIT_ROWS) or 1
    spread = drawn.repartition(tasks, "ClassType", "draw")
    with L.cached(L.assemble_array(spread, "bands", ["label"])) as (fit,):
        fitted = L.logistic(fit.count(), iterations=10, weighted=False).fit(fit)
    scored = fitted.transform(rows)
    return scored.select("ImageId", "y", "x", (F.col("prediction") + 1).cast("int").alias("ClassType"))


@query("feature_importance_topk")
def feature_importance_topk(spark, d):
    train, _ = retail_frames(spark, d)
    with L.cached(train) as (rows,):
        model = L.forest(trees=10).fit(rows)
    pairs = [(n, float(v)) for n, v in zip(RETAIL_COLUMNS, model.featureImportances.toArray())]
    table = spark.createDataFrame(pairs, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(10)


@query("seed_average")
def seed_average(spark, d):
    """Boosting runs that differ in seed and hold-out, averaged after leaving log space."""
    train, test = retail_frames(spark, d)
    return L.seed_average(lambda s: L.boosted(rounds=5, depth=4, seed=s), train, test, "Id", (1301, 1302, 1303))


@query("model_save_load_score")
def model_save_load_score(spark, d):
    """A fitted pipeline saved to the shared folder, loaded and used for scoring."""
    visits = X.build_basket_features(V.basket(spark, d)).na.fill(0.0)
    coded = visits.withColumn("label", F.col("TripType") - 1.0)
    pipeline = Pipeline(
        stages=[
            VectorAssembler(inputCols=BASKET_COLUMNS, outputCol="features"),
            L.forest_classifier(5, 4, weighted=False),
        ]
    )
    path = scratch_path(spark, "model")
    with L.cached(coded) as (rows,):
        pipeline.fit(rows).write().overwrite().save(path)
        scored = PipelineModel.load(path).transform(rows)
        return cut_lineage(scored.select("VisitNumber", F.col("prediction").cast("int").alias("prediction")))
