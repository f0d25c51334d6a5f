"""Splits, models and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import ml as M
from lakeloom.plans.registry import query
from lakeloom.plans.relational import FEATURES, master_table
from lakeloom.session import materialize


@query(
    "train_test_split",
    "M1",
    """WITH r AS (SELECT o_orderkey, row_number() OVER
                    (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rank,
                  count(*) OVER () AS n FROM orders)
       SELECT o_orderkey, CASE WHEN rank <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
       FROM r""",
)
def _(t):
    return M.train_test_split(t.orders.select("o_orderkey"), "o_orderkey")


def split_reviews(t):
    keyed = master_table(t).withColumn(
        "review", F.concat_ws("/", F.col("shuttle_id").cast("string"), F.col("company_id").cast("string"))
    )
    return materialize(M.train_test_split(keyed, "review"), "reviews")


@query("rf_regress", "M2")
def _(t):
    """Test and train metrics of the price model next to those of a constant guess."""
    data = split_reviews(t)
    train = data.where("split = 'train'")
    model = M.rf_regress(train, "features", "target")
    scored = M.predict(model, data, "features")
    guess = train.agg(F.avg("target")).scalar()
    metrics = M.regression_metrics(scored, "target", "prediction", by=["split"])
    baseline = M.regression_metrics(
        data.withColumn("guess", guess), "target", "guess", by=["split"]
    ).select("split", F.col("rmse").alias("baseline_rmse"))
    return metrics.join(baseline, "split")


@query("rf_classify", "M3")
def _(t):
    """Accuracy of the label model on both parts."""
    data = materialize(
        M.train_test_split(t.embeddings, "vec_id").withColumn(
            "label", F.col("label").cast("double")
        ),
        "embeddings",
    )
    model = M.rf_classify(data.where("split = 'train'"), "embedding", "label")
    scored = M.predict(model, data, "embedding")
    return scored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 4).alias("accuracy"),
    )


@query("feature_importance_table", "M6")
def _(t):
    data = split_reviews(t)
    model = M.rf_regress(data.where("split = 'train'"), "features", "target")
    return M.feature_importance_table(model, FEATURES, t.spark)
