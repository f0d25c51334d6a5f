"""Joins.

No side carries a broadcast hint: the optimizer broadcasts a side only when its
measured size is below ``spark.sql.autoBroadcastJoinThreshold``, and AQE splits
the skewed partitions of the joins that shuffle. One-row inputs are attached as
scalar subqueries, which need no join at all.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_default(
    facts: DataFrame, dim: DataFrame, key: str, column: str, default: str
) -> DataFrame:
    """Attach one attribute of ``dim``; facts without a match get ``default``."""
    attribute = dim.select(key, column)
    return facts.join(attribute, key, "left").withColumn(
        column, F.coalesce(F.col(column), F.lit(default))
    )


def inner_star_join(
    facts: DataFrame,
    dims: Mapping[str, DataFrame],
    features: Sequence[str],
    target: str,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Facts that match every dimension, with the feature vector and its target."""
    out = facts
    for key, dim in dims.items():
        out = out.join(dim, key)
    return out.select(
        *keep,
        F.array(*[F.col(f).cast("double") for f in features]).alias("features"),
        F.col(target).cast("double").alias("target"),
    )


def unique_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, failing the job when a key occurs more than once."""
    rest = [c for c in df.columns if c not in keys]
    found = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.any_value(F.struct(*rest) if rest else F.lit(1)).alias("_row"),
    )
    label = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("partition key is not unique: "), label))
    )
    out = found.withColumn("_row", checked)
    return out.select(*keys, *([f"_row.{c}" for c in rest]))


def aligned_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partition ``k`` of the left side meets only partition ``k`` of the right side.

    ``right`` must hold one row per key; the check shares the join's shuffle.
    """
    return left.join(unique_per_key(right, keys), list(keys))


def broadcast_input(partitioned: DataFrame, one_row: DataFrame) -> DataFrame:
    """Make the columns of a one-row input visible to every partition."""
    packed = one_row.select(F.struct("*").alias("s")).scalar()
    return partitioned.withColumns({c: packed.getField(c) for c in one_row.columns})


def scalar_feedback(rows: DataFrame, total: DataFrame, out: str, combine) -> DataFrame:
    """Feed one aggregate of a layer into each row of the next.

    ``combine`` gets the scalar as a column and returns the new value.
    """
    return rows.withColumn(out, combine(total.scalar()))


def _successes(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    return log.where(F.col("status") == "success").select(*keys).distinct()


def semi_join_hits(
    steps: DataFrame, log: DataFrame, keys: Sequence[str] = ("node_id", "run_hash")
) -> DataFrame:
    """Steps whose key has a success row in the log."""
    return steps.join(_successes(log, keys), list(keys), "left_semi")


def anti_join_misses(
    steps: DataFrame, log: DataFrame, keys: Sequence[str] = ("node_id", "run_hash")
) -> DataFrame:
    """Steps to recompute."""
    return steps.join(_successes(log, keys), list(keys), "left_anti")


def semi_join_repeated(
    log: DataFrame, keys: Sequence[str] = ("node_id", "run_hash")
) -> DataFrame:
    """Log rows whose key occurs more than once."""
    repeated = log.groupBy(*keys).count().where(F.col("count") > 1).drop("count")
    return log.join(repeated, list(keys), "left_semi")


def range_join_ticks(state: DataFrame, ticks: DataFrame, now: Column) -> DataFrame:
    """Ticks strictly after the schedule's last fire and not after ``now``.

    ``state`` has one row per schedule (schedule_id, last_fired_at), so the
    equality on the schedule bounds every match to one row and only the tick
    side can be skewed.
    """
    return (
        ticks.where(F.col("tick_at") <= now)
        .join(state, "schedule_id")
        .where(F.col("tick_at") > F.col("last_fired_at"))
    )
