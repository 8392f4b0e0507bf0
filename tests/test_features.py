"""Edge rows of cleaning, features, encoders and metrics."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions import columns as C
from cairn.operators import blend as B, clean, encode as E, features as X, metrics as K, stats as S


def test_unknown_open_flag_is_kept_and_filled(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 1)], "Id int, Open int")
    assert [r["Id"] for r in clean.filter_open(df).orderBy("Id").collect()] == [1, 3]
    assert [r["Open"] for r in clean.default_flag(df).orderBy("Id").collect()] == [1, 0, 1]


def test_sales_floor_and_zero_replacement(spark):
    df = spark.createDataFrame([(0.0,), (5.0,)], "Sales double")
    assert clean.filter_floor(df, "Sales").count() == 2
    assert clean.filter_floor(df, "Sales", strict=True).count() == 1
    assert sorted(r[0] for r in clean.replace_value(df, "Sales", 0.0, 1.0).collect()) == [1.0, 5.0]


def test_september_is_sept(spark):
    rows = [(9, "Mar,Jun,Sept,Dec"), (9, "Mar,Jun,Sep,Dec"), (9, None), (3, "Mar,Jun,Sept,Dec")]
    df = spark.createDataFrame(rows, "m int, i string")
    assert [r[0] for r in df.select(C.in_promo_month(F.col("m"), F.col("i"))).collect()] == [1, 0, 0, 1]


def test_first_of_january_keeps_its_year(spark):
    df = spark.createDataFrame([(datetime.date(2000, 1, 1),)], "Date date")
    r = X.add_date_parts(df).first()
    assert (r["Year"], r["WeekOfYear"], r["DayOfWeek"]) == (2000, 52, 5)


def test_promo_months_are_clamped(spark):
    df = spark.createDataFrame([(2000, 10, 0, 0), (2000, 10, 2001, 1), (2000, 10, 1999, 2)], "y int, w int, sy int, sw int")
    got = [r[0] for r in df.select(C.promo_months_open(*map(F.col, ("y", "w", "sy", "sw")))).collect()]
    assert got == [0.0, 0.0, 14.0]


def test_ratio_of_zero_is_null(spark):
    assert spark.range(1).select(C.ratio(F.lit(4), F.lit(0))).first()[0] is None


def test_unseen_category_and_numeric_label_order(spark):
    train = spark.createDataFrame([(999,), (3,), (12,), (3,)], "t int")
    codes = {r["t"]: r["code"] for r in E.label_codes(train, "t").collect()}
    assert codes == {3: 0, 12: 1, 999: 2}
    words = spark.createDataFrame([("b",), ("a",)], "w string")
    other = spark.createDataFrame([("a",), ("z",)], "w string")
    got = E.apply_codes(other, E.category_codes(words, "w"), "w", "c").orderBy("w").collect()
    assert [r["c"] for r in got] == [1, None]
    hot = E.one_hot(other, {"w": E.category_list(words, "w")}).orderBy("w").collect()
    assert [(r["w_a"], r["w_b"]) for r in hot] == [(1, 0), (0, 0)]


@pytest.mark.parametrize("op", [E.scale_standard, E.scale_minmax, E.scale_robust])
def test_constant_column_scales_to_null(spark, op):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert {r["x"] for r in op(df, ["x"]).collect()} == {None}


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert {r["x"] for r in clean.impute_mean(df, ["x"]).collect()} == {None}


def test_pca_components_are_uncorrelated_and_ordered(spark):
    df = spark.range(400).select(
        "id", *[(C.hash_unit("id", s) * s).alias(f"x{s}") for s in (1, 2, 3)], C.hash_unit("id", 2).alias("x4")
    )
    out = E.pca_project(df, ["x1", "x2", "x3", "x4"], 3).select(*[F.get("pca", F.lit(i)).alias(f"c{i}") for i in range(3)])
    r = out.agg(F.var_pop("c0"), F.var_pop("c1"), F.var_pop("c2"), F.corr("c0", "c1"), F.avg("c0")).first()
    assert r[0] >= r[1] >= r[2] and abs(r[3]) < 1e-6 and abs(r[4]) < 1e-9


def test_log_loss_is_finite_at_certainty(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 2, 0.0), (2, 2, 1, 1.0), (2, 2, 2, 0.0)], "i int, y int, c int, p double")
    assert 0 < K.log_loss(df, ["i"], "y", "c", "p").first()[0] < 40
    binary = spark.createDataFrame([(1, 0.0), (0, 1.0)], "y int, p double")
    assert 0 < K.binary_log_loss(binary, "y", "p").first()[0] < 40


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, p double")
    assert K.roc_auc(df, "y", "p").first()["auc"] == pytest.approx((0.5 + 1 + 1 + 1) / 4)


def test_empty_masks_overlap_fully(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "c int, t int, p int")
    assert K.jaccard(df, "t", "p", "c").first()["jaccard"] == pytest.approx(1.0)


def test_blends_stay_in_range_and_single_weight_is_identity(spark):
    rows = [(i, m, 10.0 * i + k) for i in range(1, 20) for k, m in enumerate(("a", "b", "c"))]
    df = spark.createDataFrame(rows, "Id int, model string, value double")
    one = B.blend_weighted(df, "Id", "model", "value", {"a": 1.0, "b": 0.0, "c": 0.0}).collect()
    assert all(r["value"] == 10.0 * r["Id"] for r in one)
    logs = B.blend_weighted(df, "Id", "model", "value", {"a": 0.2, "b": 0.3, "c": 0.5}, log=True)
    for r in logs.withColumn("v", F.expm1("value")).collect():
        assert 10.0 * r["Id"] <= r["v"] <= 10.0 * r["Id"] + 2


def test_weight_search_prefers_the_good_model(spark):
    rows = [(i, m, p) for i in range(10) for m, p in (("a", 0.9), ("b", 0.4), ("c", 0.1))]
    df = spark.createDataFrame(rows, "i int, m string, p double")
    best = B.best_weights(B.weight_losses(df, "i", "m", "p", ["a", "b", "c"]), 3).first()
    assert (best["w0"], best["w1"], best["w2"]) == (1.0, 0.0, 0.0)
    assert all(abs(sum(w) - 1) < 1e-12 for w in B.simplex_grid(3, 20)) and len(B.simplex_grid(3, 20)) == 231


def test_set_equality(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "x int") for xs in ([1, 2, 2], [2, 1]))
    assert S.same_set(a, b).first()["equal"] is True
    assert S.same_set(a, b.filter("x = 1")).first()["only_left"] == 1


def test_basket_lines_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(v):
        seen.add(1)
        return v

    rows = [(v, 7 * v + k, k + 1, "DAIRY" if k else "MEAT", k, "Monday", 1) for v in range(5) for k in range(4)]
    lines = spark.createDataFrame(
        rows, "VisitNumber long, Upc long, ScanCount int, DepartmentDescription string, FinelineNumber int, Weekday string, TripType int"
    ).withColumn("Upc", F.udf(count, "long")("Upc"))
    assert len(X.build_basket_features(lines).collect()) == 5 and seen.value == len(rows)
