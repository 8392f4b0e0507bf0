"""Pixels scored by a classifier fitted on drawn rows: what each job plans, and the fit's own rows."""

import math

import pytest
from pyspark.sql import functions as F

from cairn.operators import models as L
from cairn.plans import q_models as Q, views as V

PARTS = 600


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def scored(spark, tmp_path_factory):
    """The scored pixels, and the rows and the model of the fit."""
    d = str(tmp_path_factory.mktemp("parts"))
    spark.range(PARTS).selectExpr("id AS p_partkey", "CAST(1 + id % 50 AS int) AS p_size").write.parquet(f"{d}/part.parquet")
    fits = []

    class Seen:
        def __init__(self, estimator):
            self.estimator = estimator

        def fit(self, rows):
            sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
            fits.append((self.estimator.fit(rows), sizes))
            return fits[0][0]

    frames = []
    cached, logistic = L.cached, L.logistic
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L, "cached", lambda *f: [frames.extend(plan(x) for x in f), cached(*f)][1])
        patch.setattr(L, "logistic", lambda *a, **k: Seen(logistic(*a, **k)))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            out = Q.score_pixels(spark, d)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    return out, frames, *fits[0]


def test_fit_and_scores_read_written_rows(scored):
    """Before, each job of the fit and the scoring planned the masks, the pixels and their joins again."""
    out, frames, _, _ = scored
    for text in (*frames, plan(out)):
        assert "Join" not in text and "Generate" not in text and "Aggregate" not in text


def test_fit_sees_one_block_of_rows_a_task(scored):
    """The first loss is the entropy of the classes, also with one partition of shuffles."""
    _, _, model, sizes = scored
    assert max(sizes) < 2 * Q.FIT_ROWS
    labels = model.summary.predictions.groupBy("label").count().collect()
    n = sum(r["count"] for r in labels)
    entropy = -sum(r["count"] / n * math.log(r["count"] / n) for r in labels)
    assert n > 4 * Q.FIT_ROWS and model.summary.objectiveHistory[0] == pytest.approx(entropy, abs=1e-6)


def test_every_pixel_is_scored_once(scored):
    out, _, _, _ = scored
    pixels = V.RASTER * V.RASTER * len({(i // 100, i % 3) for i in range(PARTS)})
    assert out.count() == pixels == out.select("ImageId", "y", "x").distinct().count()
    assert {r[0] for r in out.select("ClassType").distinct().collect()} <= set(range(1, 6))
