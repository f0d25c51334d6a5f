"""Feature, training and evaluation operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.scalars import _col


def train_test_split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 42) -> DataFrame:
    """Seeded shuffle cut at exactly ``int(n * frac)``: adds ``split`` train or test.

    Rows are ordered by a seeded hash of their unique key. Counts per leading
    hash digits tell which of 65,536 ranges holds the cut, only that range is
    ranked, and the row found there is the scalar every row is compared with.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    place = F.struct(digest.alias("digest"), F.col(key).alias("key"))
    places = df.select(place.alias("_at"), F.substring(digest, 1, 4).alias("_range"))
    counts = (
        places.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_end", F.sum("_n").over(Window.orderBy("_range")))
    )
    # the rank of the last training row within its range, when that range is this one
    cut = F.floor(df.agg(F.count(F.lit(1))).scalar() * F.lit(frac))
    holder = counts.select(
        "_range", (cut - F.col("_end") + F.col("_n")).alias("_rank"), "_n"
    ).where((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
    inside = Window.partitionBy("_range").orderBy("_at")
    last = (
        places.join(holder, "_range")
        .withColumn("_at_rank", F.row_number().over(inside))
        .where(F.col("_at_rank") == F.col("_rank"))
        .agg(F.max("_at"))
        .scalar()
    )
    return df.withColumn("split", F.when(place <= last, "train").otherwise("test"))


def _with_vector(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(F.col(features).cast("array<double>")))


def rf_regress(
    train: DataFrame, features: str, target: str, trees: int = 50, seed: int = 42, depth: int = 5
):
    return RandomForestRegressor(
        featuresCol="_features",
        labelCol=target,
        predictionCol="prediction",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
    ).fit(_with_vector(train, features))


def rf_classify(
    train: DataFrame, features: str, label: str, trees: int = 50, seed: int = 42, depth: int = 5
):
    return RandomForestClassifier(
        featuresCol="_features",
        labelCol=label,
        predictionCol="prediction",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
    ).fit(_with_vector(train, features))


def predict(model, df: DataFrame, features: str) -> DataFrame:
    out = model.transform(_with_vector(df, features))
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability"))
    return out.drop("_features", "rawPrediction")


def regression_metrics(
    df: DataFrame, y: str, yhat: str, by: Sequence[str] = ()
) -> DataFrame:
    """r2 (4 digits), mae and rmse (2 digits) and n, overall or per ``by``."""
    error = F.col(y) - F.col(yhat)
    n = F.count(error)
    sse = F.sum(error * error)
    spread = F.var_pop(F.when(error.isNotNull(), F.col(y))) * n
    return df.groupBy(*by).agg(
        n.alias("n"),
        F.round(F.when(spread > 0, 1 - sse / spread), 4).alias("r2"),
        F.round(F.avg(F.abs(error)), 2).alias("mae"),
        F.round(F.sqrt(sse / n), 2).alias("rmse"),
    )


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Per class precision, recall, f1 and support, with the averages and accuracy.

    All of it follows from the confusion counts, one row per (actual, predicted).
    """
    cells = (
        df.groupBy(_col(y).cast("string").alias("a"), _col(yhat).cast("string").alias("p"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("label"), F.col("n").alias("support"),
                             F.lit(0).cast("bigint").alias("predicted"),
                             F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                    F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("support"),
                             F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hits")),
                )
            ).alias("c")
        )
        .select("c.*")
    )
    per_class = cells.groupBy("label").agg(
        F.sum("support").alias("support"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    precision = ratio(F.col("hits"), F.col("predicted"))
    recall = ratio(F.col("hits"), F.col("support"))
    scored = per_class.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
    metrics = ["precision", "recall", "f1"]
    total = F.sum("support")
    averages = scored.agg(
        total.alias("support"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in metrics],
    )
    summary = averages.select(
        F.explode(
            F.array(
                F.struct(F.lit("accuracy").alias("label"), *[F.col("accuracy").alias(m) for m in metrics], "support"),
                F.struct(F.lit("macro avg").alias("label"), *[F.col(f"macro_{m}").alias(m) for m in metrics], "support"),
                F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"weighted_{m}").alias(m) for m in metrics], "support"),
            )
        ).alias("s")
    ).select("s.*")
    return scored.select("label", *metrics, "support").unionByName(summary)


def feature_importance_table(model, names: Sequence[str], spark) -> DataFrame:
    """Feature name and importance, as many rows as the model has features."""
    weights = model.featureImportances.toArray()
    rows = [(n, round(float(w), 4)) for n, w in zip(names, weights, strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")
