"""Connected components by alternating stars: every step is an aggregate and a join, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v), each once. Hot nodes are split by the joins' skew handling."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    side = both if large else both.where("v < u")
    least = side.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = side.where("v > u") if large else side
    linked = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        linked = linked.unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of edges (u, v), v < u, is a centre or hangs on one centre only: no step moves such edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.count_if(F.expr("up > 0 and up + down > 1"))).first()[0]


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, root): the smallest id of its component for every id that an edge (a, b) names, the root itself too.

    Null ends and loops are ignored; an edge may repeat in either direction.
    Each round is written to the shared folder, so lost executors cost one
    round. Rounds grow with the logarithm of the component's size.
    """
    now = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and u <> v")
        .distinct(),
        f"{label}0",
    )
    number = 0
    while not _all_stars(now):
        number += 1
        now = materialize(_star(_star(now, True), False), f"{label}{number}")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("root", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
