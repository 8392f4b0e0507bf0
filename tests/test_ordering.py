"""Order statistics, skewed joins and sampling against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions.columns import hash_unit
from cairn.operators import joins, ordering as O, sample as M, selection as S


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 else f"k{i % 17}", rng.choice([rng.gauss(0, 100), 7.0, None])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id bigint, key string, v double").repartition(6).cache()


def test_percentiles_of_a_hot_key(skewed):
    rows, df = skewed
    wanted = {"lo": ("v", 0.02), "mid": ("v", 0.5), "hi": ("v", 0.98), "max": ("v", 1.0)}
    got = {r["key"]: r for r in S.percentiles(df, ["key"], wanted).collect()}
    for key in {r[1] for r in rows}:
        values = [v for _, k, v in rows if k == key and v is not None]
        for name, (_, q) in wanted.items():
            assert got[key][name] == pytest.approx(np.percentile(values, q * 100), abs=1e-9)


def test_percentiles_without_keys_and_constant(spark, skewed):
    rows, df = skewed
    values = [v for _, _, v in rows if v is not None]
    got = S.percentiles(df, [], {"a": ("v", 0.25)}).first()["a"]
    assert got == pytest.approx(np.percentile(values, 25))
    same = spark.createDataFrame([("x", 4.0)] * 5, "k string, v double")
    assert S.percentiles(same, ["k"], {"m": ("v", 0.5)}).first()["m"] == 4.0


def test_plain_stats_beside_percentiles(skewed):
    rows, df = skewed
    got = S.group_stats(df, ["key"], {"m": ("v", 0.5)}, {"n": F.count("*")})
    assert sum(r["n"] for r in got.collect()) == len(rows)


def test_distinct_counts_ignore_nulls(skewed):
    rows, df = skewed
    got = O.distinct_counts(df, ["key"], {"d": "v"}, {"n": F.count("*")}).collect()
    for r in got:
        mine = [v for _, k, v in rows if k == r["key"]]
        assert (r["n"], r["d"]) == (len(mine), len({v for v in mine if v is not None}))


def test_null_keys_and_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0), (None, None)], "k string, v double")
    wanted = {"m": ("v", 0.5)}
    want = {("a", 2.0), ("b", None), (None, 5.0)}
    assert {(r["k"], r["m"]) for r in S.percentiles(df, ["k"], wanted).collect()} == want
    beside = S.group_stats(df, ["k"], wanted, {"n": F.count("*")})
    assert {(r["k"], r["n"], r["m"]) for r in beside.collect()} == {("a", 2, 2.0), ("b", 1, None), (None, 2, 5.0)}
    assert [tuple(r) for r in S.group_stats(df, [], wanted, {"n": F.count("*")}).collect()] == [(5, 3.0)]
    assert S.percentiles(df.limit(0), ["k"], wanted).count() == 0
    numbered = O.positions(df, ["v"], O.order_bucket(df, "v", 8), ["k"])
    assert sorted((str(r["k"]), str(r["v"]), r["pos"]) for r in numbered.collect()) == [
        ("None", "5.0", 1), ("None", "None", 0), ("a", "1.0", 0), ("a", "3.0", 1), ("b", "None", 0),
    ]


def test_percentiles_of_a_million_rows_equal_duckdb(spark):
    import duckdb

    df = spark.range(1_200_000).selectExpr(
        "CASE WHEN id % 6 = 0 THEN 'x' WHEN id % 6 = 1 THEN NULL ELSE 'hot' END AS k",
        "CASE WHEN id % 9 = 0 THEN NULL ELSE CAST((id * 7919) % 1000003 AS double) END AS v",
    )
    got = S.group_stats(df, ["k"], {"a": ("v", 0.02), "m": ("v", 0.5)}, {"n": F.count("*")}).collect()
    want = duckdb.sql(
        "SELECT k, count(*), quantile_cont(v, 0.02), quantile_cont(v, 0.5) FROM (SELECT CASE WHEN i % 6 = 0 THEN 'x' "
        "WHEN i % 6 = 1 THEN NULL ELSE 'hot' END AS k, CASE WHEN i % 9 = 0 THEN NULL ELSE "
        "CAST((i * 7919) % 1000003 AS double) END AS v FROM range(1200000) t(i)) GROUP BY k"
    ).fetchall()
    assert {(r["k"], r["n"], round(r["a"], 6), round(r["m"], 6)) for r in got} == {
        (k, n, round(a, 6), round(m, 6)) for k, n, a, m in want
    }


def test_string_buckets_follow_the_strings(spark):
    urls = [f"https://www.site.org/a/{i}" for i in range(19_999)]
    df = spark.createDataFrame([(u,) for u in [*urls, "a", None]], "w string")
    bucket = O.order_bucket(df, "w")
    assert df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] <= 200
    got = {r["w"]: r["pos"] for r in O.positions(df, ["w"], bucket).collect()}
    assert got == {w: i for i, w in enumerate([None, "a", *sorted(urls)])}


def test_positions_number_all_rows(skewed):
    rows, df = skewed
    got = O.positions(df, ["id"], O.order_bucket(df, "id", 16)).collect()
    assert all(r["pos"] == r["id"] for r in got) and len(got) == len(rows)


def test_positions_of_strings_with_common_prefix(spark):
    words = [f"Class_{i}" for i in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["pos"] for r in O.positions(df, ["w"], O.order_bucket(df, "w")).collect()}
    assert got == {w: i for i, w in enumerate(sorted(words))}


def test_attach_salts_hot_keys_without_changing_rows(skewed):
    rows, df = skewed
    stats = df.groupBy("key").agg(F.count("*").alias("n"))
    got = joins.attach(df, stats.filter("key <> 'k3'"), ["key"], "n", ["n"], floor=50).collect()
    size = {}
    for _, k, _ in rows:
        size[k] = size.get(k, 0) + 1
    assert sorted(r["id"] for r in got) == [r[0] for r in rows]
    assert all(r["n"] == (None if r["key"] == "k3" else size[r["key"]]) for r in got)


def test_cap_keeps_small_classes_whole(skewed):
    rows, df = skewed
    got = M.cap_per_class(df, "key", ["id"], 70, 1).groupBy("key").count().collect()
    size = {}
    for _, k, _ in rows:
        size[k] = size.get(k, 0) + 1
    assert {r["key"]: r["count"] for r in got} == {k: min(n, 70) for k, n in size.items()}


def test_sampling_does_not_depend_on_partitions(skewed):
    _, df = skewed
    for op in (
        lambda d: M.cap_per_class(d, "key", ["id"], 40, 1),
        lambda d: M.draw_with_replacement(d, "key", "id", 30, 2),
        lambda d: M.split_kfold(d, "id", 7),
        lambda d: M.bootstrap(d, "id", 3),
        lambda d: M.shuffle_rows(d, "id", 3),
        lambda d: M.one_per_group(d, "key", 3),
    ):
        one, eight = (sorted(map(str, op(df.repartition(n)).collect())) for n in (1, 8))
        assert one == eight


def test_folds_partition_the_rows(skewed):
    rows, df = skewed
    got = M.split_kfold(df, "id", 7).groupBy("fold").agg(F.count("*").alias("n"), F.max("id"), F.min("id")).collect()
    sizes = sorted(r["n"] for r in got)
    assert sum(sizes) == len(rows) and sizes[-1] - sizes[0] <= 1 and len(got) == 7


def test_draws_from_exploded_rows_are_not_broadcast(spark):
    """Spark's estimate of 40,000 rows made by an ``explode`` is smaller than that of the draws."""
    df = spark.range(4).selectExpr("CAST(id % 2 AS int) AS key", "explode(sequence(id * 10000, id * 10000 + 9999)) AS id")
    out = M.draw_with_replacement(df, "key", "id", 500, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BuildLeft" not in plan
    rows = out.collect()
    assert sorted((r["key"], r["draw"]) for r in rows) == [(k, i) for k in (0, 1) for i in range(500)]
    assert all(r["id"] // 10000 % 2 == r["key"] for r in rows)


def test_draw_with_replacement_sizes(skewed):
    rows, df = skewed
    got = {r["key"]: r["count"] for r in M.draw_with_replacement(df, "key", "id", 100, 2).groupBy("key").count().collect()}
    size = {}
    for _, k, _ in rows:
        size[k] = size.get(k, 0) + 1
    assert got == {k: min(n, 100) for k, n in size.items()}


def test_bootstrap_mean_is_one(spark):
    draws = M.bootstrap(spark.range(20000), "id", 1).agg(F.avg("draws"), F.avg((F.col("draws") == 0).cast("int"))).first()
    assert draws[0] == pytest.approx(1.0, abs=0.03) and draws[1] == pytest.approx(np.exp(-1), abs=0.02)


def test_hash_unit_is_uniform(spark):
    got = spark.range(20000).select(hash_unit("id", 9).alias("h")).agg(F.avg("h"), F.min("h"), F.max("h")).first()
    assert got[0] == pytest.approx(0.5, abs=0.01) and 0 <= got[1] and got[2] < 1


def test_crowded_values_are_still_split(spark):
    """Nearly all rows lie in a billionth of the range; buckets must follow the rows, not the range."""
    df = spark.range(4000).select("id", (F.exp(-F.col("id") / 40)).alias("v")).withColumn("k", F.lit("a"))
    bucket = O.order_bucket(df, "v", 64)
    worst = df.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0]
    assert worst < 400
    got = O.positions(df, ["v"], bucket).collect()
    assert all(r["pos"] == 3999 - r["id"] for r in got)
    assert S.percentiles(df, ["k"], {"m": ("v", 0.5)}).first()["m"] == pytest.approx(
        np.median(np.exp(-np.arange(4000) / 40))
    )


def test_order_keys_follow_the_doubles(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(-(1 << 63), (1 << 63) - 1, 3000, np.int64).view(np.float64)
    powers = [x for e in range(-1074, 1024) for x in (2.0**e, np.nextafter(2.0**e, 0), -(2.0**e))]
    odd = [0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308]
    values = [float(x) for x in [*bits[~np.isnan(bits)], *powers, *odd, *range(-300, 300)]]
    df = S.with_order_key(spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "v double"), "v", "k")
    got = [(r["v"], r["k"]) for r in df.collect()]
    nan = next(k for v, k in got if v is not None and v != v)
    assert next(k for v, k in got if v is None) is None
    plain = sorted((v, k) for v, k in got if v is not None and v == v)
    assert all((a[0] < b[0]) == (a[1] < b[1]) and (a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(plain, plain[1:]))
    assert nan > plain[-1][1]


def test_percentiles_of_close_values_take_all_passes(spark):
    rng = np.random.default_rng(4)
    close = 1.0 + rng.integers(0, 4000, 5000) * 2.0**-52
    wide = np.where(rng.random(5000) < 0.5, 1, -1) * 10.0 ** rng.uniform(-300, 300, 5000)
    rows = [(k, float(a), float(b)) for k, a, b in zip(rng.choice(["x", "y"], 5000, p=[0.9, 0.1]), close, wide)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    wanted = {f"{c}{q}": (c, q / 100) for c in "ab" for q in (0, 1, 25, 50, 99, 100)}
    for r in S.group_stats(df, ["k"], wanted, rows="n").collect():
        mine = [x for x in rows if x[0] == r["k"]]
        assert r["n"] == len(mine)
        for name, (c, q) in wanted.items():
            values = np.sort([x["kab".index(c)] for x in mine])
            at = q * (len(values) - 1)
            lo, hi = values[int(np.floor(at))], values[int(np.ceil(at))]
            assert r[name] == lo + (hi - lo) * (at - np.floor(at)), name
    assert S.percentiles(df, [], {"m": ("a", 0.5)}).first()["m"] == np.percentile(close, 50)


def test_distinct_counts_of_codes_are_sets_of_bits(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(200)]), rng.choice([None, 0, 62, 63, 125, 126]), rng.random()) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, c int, d int, w double")
    got = O.distinct_counts(df, ["k"], {"x": "c", "y": "d", "z": "w"}, {"n": F.count("*")}, {"c": 199, "d": 126})
    assert got.columns == ["k", "x", "y", "z", "n"] and dict(got.dtypes)["x"] == "bigint"
    for r in got.collect():
        mine = [q for q in rows if q[0] == r["k"]]
        assert tuple(r)[1:] == (*(len({q[i] for q in mine} - {None}) for i in (1, 2, 3)), len(mine))


def test_ranges_follow_long_common_prefixes(spark):
    from cairn.operators.encode import category_codes

    words = [f"{'p' * 300}{i:05}" for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in [*words, *words[:50], None]], "w string")
    parts = O.ranged(df.na.drop().distinct(), ["w"], rows=100)
    sizes = [r["count"] for r in parts.groupBy("_range").count().collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 25 and max(sizes) <= 300
    ranked = O.positions(parts, ["w"], F.col("_range"))
    assert {r["w"]: r["pos"] for r in ranked.collect()} == {w: i for i, w in enumerate(words)}
    codes = {r["w"]: (r["code"], r["n_rows"]) for r in category_codes(df, "w").collect()}
    assert codes == {w: (i + 1, 2 if i < 50 else 1) for i, w in enumerate(words)}
    assert category_codes(df.limit(0), "w").count() == 0
