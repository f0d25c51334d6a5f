"""Aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.scalars import exact_sum, round_money
from lakeloom.operators.joins import left_join_default
from lakeloom.session import materialize


def monthly_metrics(orders: DataFrame) -> DataFrame:
    revenue = F.sum("total")
    return (
        orders.groupBy("month")
        .agg(
            F.count(F.lit(1)).alias("order_count"),
            round_money(revenue).alias("revenue"),
            round_money(revenue / F.count(F.lit(1))).alias("avg_order_value"),
        )
        .orderBy("month")
    )


def customer_lifetime(orders: DataFrame, customers: DataFrame) -> DataFrame:
    per_customer = orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"),
        round_money(F.sum("total")).alias("lifetime_value"),
    )
    return left_join_default(per_customer, customers, "customer_id", "tier", "UNKNOWN")


def product_sales(orders: DataFrame, products: DataFrame) -> DataFrame:
    per_product = orders.groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"),
        round_money(F.sum("total")).alias("revenue"),
    )
    return left_join_default(per_product, products, "product_id", "category", "unknown")


def mart_summary(orders: DataFrame) -> DataFrame:
    """One row over all marts.

    Grouping sets give the customer, product and month totals from a single
    pass over the orders; only those totals reach the final aggregate.
    """
    totals = (
        orders.select("customer_id", "product_id", "month", "total")
        .groupingSets(
            [[F.col("customer_id")], [F.col("product_id")], [F.col("month")]],
            "customer_id",
            "product_id",
            "month",
        )
        .agg(F.sum("total").alias("value"), F.grouping_id().alias("gid"))
    )
    # grouping_id has a set bit for each column that is not in the group
    customer, product, month = (F.col("gid") == g for g in (0b011, 0b101, 0b110))
    value = F.col("value")
    months = F.count_if(month)
    revenue = F.coalesce(F.sum(F.when(month, value)), F.lit(0).cast("decimal(38,2)"))
    return totals.agg(
        F.count_if(customer).alias("customer_count"),
        months.alias("months_tracked"),
        F.count_if(product).alias("product_count"),
        round_money(revenue).alias("total_revenue"),
        round_money(revenue / F.greatest(months, F.lit(1))).alias("avg_revenue_per_month"),
        round_money(
            F.coalesce(F.max(F.when(customer, value)), F.lit(0).cast("decimal(38,2)"))
        ).alias("top_customer_ltv"),
    )


def pair_means(
    df: DataFrame, keys: Sequence[str], means: Mapping[str, tuple[str, int]]
) -> DataFrame:
    """Rounded mean per key pair; ``means`` maps output to (column, digits)."""
    return df.groupBy(*keys).agg(
        *[
            F.round(exact_sum(c) / F.count(c), digits).alias(out)
            for out, (c, digits) in means.items()
        ]
    )


def type_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def share_of_total(counts: DataFrame) -> DataFrame:
    """Share of each group's count, rounded to 4 digits, and the total."""
    total = counts.agg(F.sum("count")).scalar()
    share = F.round(F.col("count").cast("decimal(20,0)") / total, 4)
    return counts.withColumns({"rate": share, "total": total})


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, min, max of every column and the row count, from one aggregate."""
    stats = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))) / F.count(F.lit(1)), F.lit(0.0))
                .cast("double")
                .alias("mean"),
                F.coalesce(F.min(c), F.lit(0)).cast("double").alias("min"),
                F.coalesce(F.max(c), F.lit(0)).cast("double").alias("max"),
            ).alias(f"s_{i}")
            for i, c in enumerate(columns)
        ],
    )
    packed = F.array(*[F.col(f"s_{i}") for i in range(len(columns))])
    return stats.select(F.explode(packed).alias("s"), "row_count").select("s.*", "row_count")


def dimension_rollup(dims: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and score sum of each dimension table."""
    tagged = [
        df.select(F.lit(name).alias("dim"), F.col("score").cast("double").alias("score"))
        for name, df in dims.items()
    ]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("dim")
        .agg(F.count(F.lit(1)).alias("dimension_rows"), exact_sum("score").alias("score"))
    )


def collect_totals(reports: DataFrame) -> DataFrame:
    """Fan-in over all partitions as an aggregate rather than a list."""
    return reports.agg(
        F.count(F.lit(1)).alias("regions"),
        F.sum("users").alias("total_users"),
        F.round(exact_sum("revenue"), 2).alias("total_revenue"),
    )


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(column).alias("total_hashes"), F.count_distinct(column).alias("unique")
    )


def top_n_average(df: DataFrame, feature: str, tie: Sequence[str], n: int = 100) -> DataFrame:
    top = df.orderBy(F.col(feature).desc(), *tie).limit(n)
    return top.agg(
        F.coalesce(F.round(F.avg(feature), 6), F.lit(0.0)).alias("avg_top_feature"),
        F.count(F.lit(1)).alias("top_count"),
    ).withColumn("total_rows", df.agg(F.count(F.lit(1))).scalar())


def ticker_rollup(tickers: DataFrame) -> DataFrame:
    price = F.col("price").cast("decimal(18,4)") / 100
    volume = F.col("volume").cast("decimal(18,0)") / 1_000_000
    return tickers.agg(
        F.count(F.lit(1)).alias("tickers"),
        F.round(F.sum(price) / F.count(F.lit(1)), 4).alias("avg_price"),
        F.round(F.sum(volume), 4).alias("total_volume"),
    )


def layer_sum(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    return df.agg(F.round(F.sum(column), digits).alias("sum"), F.count(F.lit(1)).alias("count"))


def minmax_normalize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns rescaled to [0, 1]; a column without spread becomes 0."""
    bounds = df.agg(
        F.struct(
            *[F.min(c).alias(f"lo_{c}") for c in columns],
            *[F.max(c).alias(f"hi_{c}") for c in columns],
        )
    ).scalar()

    def scaled(c: str) -> Column:
        lo, hi = bounds.getField(f"lo_{c}"), bounds.getField(f"hi_{c}")
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))

    return df.withColumns({c: scaled(c) for c in columns})


def max_scale(
    df: DataFrame, column: str, condition: Column, out: str, filter_first: bool, digits: int = 4
) -> DataFrame:
    """Divide by the column's maximum and keep the rows that meet ``condition``.

    The maximum is taken after the filter when ``filter_first``, else over all rows.
    """
    kept = df.where(condition)
    top = (kept if filter_first else df).agg(F.max(column)).scalar()
    return kept.withColumn(out, F.round(F.col(column) / top, digits))


#: 65,536 to the fourth power covers every 64-bit index.
DIGEST_LEVELS = 4


def ordered_digest(df: DataFrame, index: str, digest: str, fanout: int = 65_536) -> DataFrame:
    """One sha256 over digests in index order; indexes are distinct and from 0 to 2**63 - 1.

    A tree of four levels whatever the number of digests: each node is the sha256
    of the digests of up to ``fanout`` consecutive indexes one level below, so no
    task ever holds more than ``fanout`` digests.
    """
    level = df.select(F.col(index).cast("bigint").alias("i"), F.col(digest).alias("h"))
    level = level.withColumn("n", F.lit(1).cast("bigint"))
    for _ in range(DIGEST_LEVELS):
        items = F.sort_array(F.collect_list(F.struct("i", "h")))
        level = (
            level.groupBy(F.floor(F.col("i") / fanout).cast("bigint").alias("i"))
            .agg(items.alias("items"), F.sum("n").alias("n"))
            .select("i", F.sha2(F.concat_ws("", F.col("items.h")), 256).alias("h"), "n")
        )
    return level.select(F.col("n").alias("count"), F.col("h").alias("combined_hash"))
