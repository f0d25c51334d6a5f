"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.scalars import money, month_of, round_money


def filter_equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def filter_threshold(df: DataFrame, column: str, threshold) -> DataFrame:
    """Strictly greater than ``threshold``."""
    return df.where(F.col(column) > F.lit(threshold))


def filter_all_true(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Null counts as false."""
    return df.where(reduce(and_, [F.col(f) for f in flags]))


def all_le(df: DataFrame, columns: Sequence[str], threshold) -> Column:
    """Every column at most ``threshold``; a missing column or value counts as 0."""
    present = set(df.columns)
    tests = [
        (F.coalesce(F.col(c), F.lit(0)) if c in present else F.lit(0)) <= F.lit(threshold)
        for c in columns
    ]
    return reduce(and_, tests)


def filter_all_le(df: DataFrame, columns: Sequence[str], threshold) -> DataFrame:
    return df.where(all_le(df, columns, threshold))


def removed_count(df: DataFrame, columns: Sequence[str], threshold) -> DataFrame:
    """How many rows :func:`filter_all_le` keeps and removes, in one pass."""
    keep = all_le(df, columns, threshold)
    return df.agg(
        F.count_if(keep).alias("kept"),
        F.count_if(~keep).alias("removed"),
    )


def project_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def derive_total(df: DataFrame, quantity: str, unit_price: str, date: str) -> DataFrame:
    return df.withColumns(
        {
            "total": round_money(money(quantity) * money(unit_price)),
            "month": month_of(date),
        }
    )


def derive_margin(df: DataFrame, cost: str, rate: float = 0.3) -> DataFrame:
    return df.withColumn("margin", round_money(money(cost) * money(F.lit(rate))))


def derive_features(
    df: DataFrame,
    products: Mapping[str, Sequence[str]],
    sums: Mapping[str, Sequence[str]],
    means: Mapping[str, Sequence[str]],
) -> DataFrame:
    """Named products, sums and means over columns of the same row."""
    new = {name: reduce(lambda a, b: a * b, map(F.col, cols)) for name, cols in products.items()}
    new |= {name: reduce(lambda a, b: a + b, map(F.col, cols)) for name, cols in sums.items()}
    new |= {
        name: reduce(lambda a, b: a + b, map(F.col, cols)) / len(cols)
        for name, cols in means.items()
    }
    return df.withColumns(new)


def encode_categories(
    df: DataFrame, column: str, mapping: Mapping[str, int] | DataFrame, out: str, default: int = 0
) -> DataFrame:
    """Category to integer code; unknown categories get ``default``.

    A mapping written in code becomes a literal map. A mapping held in a table
    (columns ``category`` and ``code``) is joined, and its measured size decides
    between a broadcast and a shuffle.
    """
    if isinstance(mapping, DataFrame):
        codes = mapping.select(F.col("category").alias(column), F.col("code").alias(out))
        return df.join(codes, column, "left").withColumn(
            out, F.coalesce(F.col(out), F.lit(default))
        )
    literal = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(literal, F.col(column)), F.lit(default)))


def add_constant(df: DataFrame, **values) -> DataFrame:
    return df.withColumns({name: F.lit(v) for name, v in values.items()})


def above_threshold(df: DataFrame, column: str, threshold: float, out: str = "above") -> DataFrame:
    return df.withColumns(
        {out: F.col(column) > F.lit(threshold), "threshold": F.lit(float(threshold))}
    )


def expectations(df: DataFrame, checks: Mapping[str, Column], strict: bool = False) -> DataFrame:
    """Table of ``(check_name, passed, violations, observed)``, all from one aggregate.

    Each check is a predicate every row has to meet; ``nonempty`` is always
    added. In strict mode reading the table fails at the first broken check.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("observed"),
        *[
            F.count_if(~F.coalesce(test, F.lit(False))).alias(f"bad_{i}")
            for i, test in enumerate(checks.values())
        ],
    )
    rows = [
        F.struct(
            F.lit("nonempty").alias("check_name"),
            (F.col("observed") > 0).alias("passed"),
            F.when(F.col("observed") > 0, F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias(
                "violations"
            ),
        )
    ] + [
        F.struct(
            F.lit(name).alias("check_name"),
            (F.col(f"bad_{i}") == 0).alias("passed"),
            F.col(f"bad_{i}").alias("violations"),
        )
        for i, name in enumerate(checks)
    ]
    table = counts.select(F.explode(F.array(*rows)).alias("r"), "observed").select("r.*", "observed")
    if strict:
        failure = F.raise_error(F.concat(F.lit("expectation failed: "), F.col("check_name")))
        table = table.withColumn(
            "passed", F.when(F.col("passed"), F.lit(True)).otherwise(failure.cast("boolean"))
        )
    return table
