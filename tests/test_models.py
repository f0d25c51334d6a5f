"""Models beat a constant guess; evaluation matches its definitions."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import ml as M
from lakeloom.plans.registry import as_callable, load_all


@pytest.fixture(scope="module")
def labelled(spark):
    x, y = F.rand(1), F.rand(2)
    df = spark.range(2000).select("id", x.alias("x"), y.alias("y"))
    return df.select(
        "id",
        F.array("x", "y").alias("features"),
        (10 * F.col("x") + F.col("y")).alias("target"),
        (F.col("x") > 0.5).cast("double").alias("label"),
    ).cache()


def test_regression_beats_the_mean(labelled):
    data = M.train_test_split(labelled, "id")
    model = M.rf_regress(data.where("split = 'train'"), "features", "target", trees=20)
    scored = M.predict(model, data.where("split = 'test'"), "features")
    got = M.regression_metrics(scored, "target", "prediction").first()
    assert got["n"] == 400 and got["r2"] > 0.9 and got["mae"] <= got["rmse"]
    table = M.feature_importance_table(model, ["x", "y"], labelled.sparkSession).collect()
    weights = {r["feature"]: r["importance"] for r in table}
    assert sum(weights.values()) == pytest.approx(1.0, abs=1e-3) and weights["x"] > weights["y"]


def test_classifier_is_reproducible_and_accurate(labelled):
    data = M.train_test_split(labelled, "id")
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    runs = []
    for _ in range(2):
        scored = M.predict(M.rf_classify(train, "features", "label", trees=10), test, "features")
        runs.append(sorted((r["id"], r["prediction"]) for r in scored.collect()))
    assert runs[0] == runs[1]
    report = {r["label"]: r for r in M.classification_report(scored, "label", "prediction").collect()}
    assert report["accuracy"]["precision"] > 0.95
    assert report["0.0"]["support"] + report["1.0"]["support"] == 400


def test_perfect_and_constant_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0)], "y double, p double")
    got = M.regression_metrics(df, "y", "p").first()
    assert (got["r2"], got["mae"], got["rmse"], got["n"]) == (1.0, 0.0, 0.0, 2)
    flat = M.regression_metrics(df.withColumn("y", F.lit(2.0)), "y", "p").first()
    assert flat["r2"] is None


def test_registered_models_beat_their_baseline(spark, sf):
    rows = as_callable(load_all()["rf_regress"])(spark, "/root/testdata/sf0.01").collect()
    assert {r["split"] for r in rows} == {"train", "test"}
    for r in rows:
        if r["split"] == "train":
            assert r["rmse"] < r["baseline_rmse"]
    parts = {r["split"]: r["n"] for r in as_callable(load_all()["rf_classify"])(spark, sf).collect()}
    total = sum(parts.values())
    assert parts["train"] == int(total * 0.8)
