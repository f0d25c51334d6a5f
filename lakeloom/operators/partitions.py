"""Partitioned assets: the key universe is a DataFrame, a partition is a row of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.functions.scalars import unit_score
from lakeloom.operators.ordered import mark_hot, order_block
from lakeloom.operators.sets import universe_diff


def declared_keys(spark: SparkSession, dims: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the values written in the declaration."""
    keys = spark.range(1).select()
    for dim, values in dims.items():
        keys = keys.withColumn(dim, F.explode(F.array(*[F.lit(v) for v in values])))
    return keys


def static_partitions(df: DataFrame, dims: Mapping[str, Sequence]) -> DataFrame:
    """Rows of the declared keys only; a key without rows keeps one empty row.

    The declared keys are small and reach the rows as the build side of an inner
    join; the keys that found no rows are added apart, so rows are never
    gathered by key.
    """
    keys = declared_keys(df.sparkSession, dims)
    rows = df.join(keys, list(dims))
    missing = keys.join(df.select(*dims).distinct(), list(dims), "left_anti")
    return rows.unionByName(missing, allowMissingColumns=True)


def derived_partitions(upstream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key universe taken from data."""
    return upstream.select(*keys).distinct()


def explicit_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multi-dimensional keys given row by row; a null in any dimension is no key."""
    return rows.select(*keys).na.drop().distinct()


def dense_position(keys: DataFrame, column: str, out: str = "position") -> DataFrame:
    """Positions 0..n-1 for the distinct values of ``column``.

    Values are counted per hash bucket; only the 4096 bucket counts pass
    through one window, and each bucket numbers its own values.
    """
    bucket = F.substring(F.md5(F.col(column).cast("string")), 1, 3)
    rows = keys.select(column).distinct().withColumn("_bucket", bucket)
    starts = (
        rows.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n"))
        .drop("_n")
    )
    inside = Window.partitionBy("_bucket").orderBy(column)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(starts, "_bucket")
        .select(column, (F.col("_start") + F.col("_rank") - 1).alias(out))
    )


#: Positions of a dimension that one row is expanded to at once.
SPAN = 65_536


def partition_combos(dims: Mapping[str, DataFrame]) -> DataFrame:
    """Product of derived dimensions.

    The product is the result asked for. Each combination is addressed by the
    dense position of its next value and met by an equality join, so the work
    shuffles evenly and no side is replicated to every task. Positions are
    expanded span by span: no row holds those of a whole dimension.
    """
    (first, table), *others = dims.items()
    combos = table.select(first).distinct()
    for dim, values in others:
        numbered = dense_position(values, dim, "_at")
        size = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
        combos = (
            combos.withColumn("_size", size)
            .where(F.col("_size") > 0)
            .withColumn("_span", F.explode(F.expr(f"sequence(0L, _size - 1, {SPAN}L)")))
            .withColumn("_at", F.explode(F.expr(f"sequence(_span, least(_size, _span + {SPAN}L) - 1)")))
            .join(numbered, "_at")
            .drop("_at", "_span", "_size")
        )
    return combos


def key_suffix(keys: Column) -> Column:
    """``k1=v1,k2=v2`` of a map column, dimensions sorted."""
    entries = F.sort_array(F.map_entries(keys))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def step_id(base: Column, keys: Column) -> Column:
    return F.when(F.size(keys) == 0, base).otherwise(
        F.concat(base, F.lit("["), key_suffix(keys), F.lit("]"))
    )


def parse_step_id(text: Column) -> Column:
    """Inverse of :func:`step_id`: struct of base and key map.

    Values may hold commas: a comma ends a value only when ``name=`` follows it.
    Of a repeated name the last value counts.
    """
    base = F.regexp_extract(text, r"^([^\[]*)", 1)
    inner = F.regexp_replace(F.substring(text, F.length(base) + 2, F.length(text)), r"\]+\s*$", "")
    pairs = F.filter(F.split(inner, r",(?=[^,=]*=)"), lambda p: F.contains(p, F.lit("=")))
    keys = F.transform(pairs, lambda p: F.regexp_extract(p, r"^([^=]*)=", 1))
    values = F.transform(pairs, lambda p: F.regexp_replace(p, r"^[^=]*=", ""))
    names = F.array_distinct(keys)
    n = F.size(keys)
    last = F.transform(
        names, lambda k: F.element_at(values, (n + 1 - F.array_position(F.reverse(keys), k)).cast("int"))
    )
    return F.struct(base.alias("base"), F.map_from_arrays(names, last).alias("keys"))


def map_aligned_chain(keys: DataFrame, key: str, price: Column) -> DataFrame:
    """fetch, normalize and score of every key as one projection over the key table."""
    fetched = keys.withColumn("price", price)
    normalized = fetched.withColumn("normalized", F.col("price") / 100)
    token = F.concat(F.col(key), F.lit(":"), F.col("normalized").cast("string"))
    return normalized.withColumn("score", unit_score(token))


def enrich_with_hash(df: DataFrame, *parts: str) -> DataFrame:
    token = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return df.withColumn("hash", F.substring(F.sha2(token, 256), 1, 8))


def _chunked(df: DataFrame, order: str, chunk_rows: int) -> DataFrame:
    return df.withColumn("chunk", order_block(order, chunk_rows))


def collect_list_by(
    df: DataFrame, parent: str, order: str, value: str, chunk_rows: int = 1_000_000
) -> DataFrame:
    """Ordered fan-in: (parent, chunk, items), items sorted by ``order``.

    Every parent's list is delivered in chunks over consecutive ranges of the
    integer ``order``, ``chunk`` = floor(order / chunk_rows) however long it is:
    read in chunk order they are the whole list. Where orders are distinct, none
    exceeds ``chunk_rows``.
    """
    return (
        _chunked(df, order, chunk_rows)
        .groupBy(parent, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_items"))
        .select(parent, "chunk", F.col(f"_items.{value}").alias("items"))
    )


def collect_map_by(
    df: DataFrame, parent: str, key: str, value: str, order: str, chunk_rows: int = 1_000_000
) -> DataFrame:
    """As :func:`collect_list_by`, but each chunk is a map from partition key to value."""
    return (
        _chunked(df, order, chunk_rows)
        .groupBy(parent, "chunk")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("items")
        )
        .select(parent, "chunk", "items")
    )


def collect_gate(df: DataFrame, parents: Sequence[str], status: str = "status") -> DataFrame:
    """Rows of the parents all of whose partitions succeeded."""
    ready = (
        df.groupBy(*parents)
        .agg(F.bool_and(F.col(status) == "success").alias("_ready"))
        .where("_ready")
        .drop("_ready")
    )
    return df.join(ready, list(parents), "left_semi")


def inherit_keys(df: DataFrame, keys: Sequence[str], **derived: Column) -> DataFrame:
    """A downstream asset on the partitions of its input: the key columns pass through."""
    return df.select(*keys, *[c.alias(name) for name, c in derived.items()])


def single_partition(df: DataFrame, keys: Mapping[str, object]) -> DataFrame:
    """Exactly one partition; prunes directories when ``df`` is laid out by key."""
    return df.where(reduce(and_, [F.col(k) == F.lit(v) for k, v in keys.items()]))


def key_predicate(wanted: DataFrame, keys: Sequence[str], limit: int = 1000) -> Column | None:
    """Predicate naming the keys of ``wanted``, or None when there are more than ``limit``.

    It never evaluates to null, so its negation names all other keys.
    """
    few = wanted.select(*keys).distinct().limit(limit + 1).collect()
    if len(few) > limit:
        return None
    if not few:
        return F.lit(False)
    if len(keys) == 1:
        values = [row[0] for row in few]
        named = F.col(keys[0]).isin([v for v in values if v is not None])
        if None in values:
            named = named | F.col(keys[0]).isNull()
        return F.coalesce(named, F.lit(False)) if None in values else named
    each = [reduce(and_, [F.col(k).eqNullSafe(F.lit(row[k])) for k in keys]) for row in few]
    return reduce(or_, each)


def restrict(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the wanted keys, null ones included, by a semi join.

    Few keys are also named by a literal predicate, which prunes directories and
    row groups before anything is read.
    """
    listed = key_predicate(wanted, keys)
    return null_safe_join(df if listed is None else df.where(listed), wanted, keys, "left_semi")


def null_safe_join(df: DataFrame, keyed: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on keys, where a null key equals a null key."""
    named = keyed.select(*[F.col(k).alias(f"_key_{k}") for k in keys]).distinct()
    return df.join(named, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]), how)


def partition_completeness(keys: DataFrame, log: DataFrame, on: Sequence[str]) -> DataFrame:
    """Materializations per expected key, flagged lost (0) or duplicated (more than 1)."""
    seen = (
        log.where(F.col("status") == "success")
        .groupBy(*on)
        .agg(F.count(F.lit(1)).alias("materializations"))
    )
    n = F.coalesce(F.col("materializations"), F.lit(0))
    return (
        keys.select(*on)
        .distinct()
        .join(seen, list(on), "left")
        .withColumns(
            {
                "state": F.when(n == 0, "lost").when(n > 1, "duplicated").otherwise("once"),
                "materializations": n,
            }
        )
    )


def partition_listing(
    old: DataFrame, new: DataFrame, stale: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Key universe as active, stale or historical."""
    marked = stale.select(*keys).distinct().withColumn("_stale", F.lit(True))
    state = (
        F.when(F.col("state") == "removed", "historical")
        .when(F.col("_stale") | (F.col("state") == "new"), "stale")
        .otherwise("active")
    )
    return (
        universe_diff(old, new, keys)
        .join(marked, list(keys), "left")
        .select(*keys, state.alias("state"))
    )
