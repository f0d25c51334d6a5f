"""Set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_branches(branches: Mapping[str, DataFrame]) -> DataFrame:
    """Concatenate prepared branches, each row tagged with its branch."""
    return reduce(
        DataFrame.unionByName,
        [df.withColumn("branch", F.lit(name)) for name, df in branches.items()],
    )


def universe_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key universe with state new, retained or removed; nothing is deleted."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    state = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "removed")
        .otherwise("retained")
    )
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def merge_logs(base: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Replay one ledger onto another; rows already present are ignored."""
    fresh = incoming.dropDuplicates([key]).join(base.select(key), key, "left_anti")
    return base.unionByName(fresh)
