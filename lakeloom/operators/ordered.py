"""Ordered computations per key, built so that one hot key is spread over many tasks.

A plain window over a key sends all of the key's rows to one task. The scans
here cut each key into blocks along its order, summarise every block in
parallel, run the window over block summaries only, and then finish inside the
blocks. A block number must not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import materialize

BLOCK_ROWS = 1_000_000
#: Bits of a value that one pass of ``rank_select`` counts by; 64 is a multiple.
DIGIT = 16

# Weights of the cost estimate.
ALPHA_RISE = 0.5
ALPHA_FALL = 0.25
FLOOR_FACTOR = 0.7


def order_block(order: str, block_rows: int = BLOCK_ROWS) -> Column:
    """Block of an integer order: at most ``block_rows`` distinct positions each."""
    return F.floor(F.col(order) / block_rows).cast("bigint")


def mark_hot(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Adds ``_hot_rows``: the row count of keys with more than ``limit`` rows, else null.

    There are at most rows / limit such keys, so the joined table is tiny next
    to the data and its measured size lets the optimizer broadcast it.
    """
    hot = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_hot_rows"))
        .where(F.col("_hot_rows") > limit)
    )
    return df.join(hot, list(keys), "left")


def latest_success(
    log: DataFrame, keys: Sequence[str] = ("node_id", "run_hash"), order: str = "id"
) -> DataFrame:
    """Newest success row per key, by partial aggregation instead of a sort."""
    rest = [c for c in log.columns if c not in keys]
    newest = (
        log.where(F.col("status") == "success")
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("r"))
    )
    return newest.select(*keys, "r.*")


def recent_n_per_node(log: DataFrame, n: int = 10, key: str = "node_id") -> DataFrame:
    """Last ``n`` rows per node.

    The rank filter is pushed below the shuffle as a group limit, so each task
    forwards at most ``n`` rows of a node however many it holds.
    """
    recent = Window.partitionBy(key).orderBy(F.col("id").desc())
    return log.withColumn("rank", F.row_number().over(recent)).where(F.col("rank") <= n)


def running_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    out: str = "running",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running total of ``value`` along ``order`` within each key.

    A null adds nothing; the total is null until the first value. Rows of equal
    order are taken by value, nulls first.
    """
    keys = list(keys)
    rows = df.withColumn("_block", order_block(order, block_rows))
    up_to = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_carry", F.sum("_sum").over(up_to))
        .drop("_sum")
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order, value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.withColumn("_local", F.sum(value).over(inside))
    return (
        local.join(carry, [*keys, "_block"])
        .withColumn(out, F.coalesce(F.col("_carry") + F.col("_local"), F.col("_carry"), F.col("_local")))
        .drop("_block", "_local", "_carry")
    )


def ewma_step(previous: Column, seen: Column) -> Column:
    """One observation folded into the estimate: rises fast, falls slowly."""
    rise = ALPHA_RISE * seen + (1 - ALPHA_RISE) * previous
    fall = F.greatest(ALPHA_FALL * seen + (1 - ALPHA_FALL) * previous, previous * FLOOR_FACTOR)
    return F.when(seen > previous, rise).otherwise(fall)


def asym_ewma(
    df: DataFrame,
    key: str,
    order: str,
    value: str,
    initial: DataFrame | None = None,
    block_rows: int = 100_000,
    fanout: int = 1000,
) -> DataFrame:
    """Final estimate per key after all observations: (key, estimate, samples).

    The fold is not associative, but it is monotone in the previous estimate
    and each step shrinks the distance between two estimates to at most 3/4.
    Every block is therefore folded from both ends of the possible range. When
    the results meet (to the last bits of a double), the block's result is known
    without what came before it; otherwise the block is short, a hundred-odd
    observations at most, and keeps them. Blocks are merged ``fanout`` at a time
    by the same rule, so every group at every level stays small.

    ``order`` is a non-negative integer, unique within a key. ``initial`` (key,
    estimate, samples) continues earlier estimates.
    """
    seen = df.select(
        F.col(key),
        F.col(order).cast("bigint").alias("_o"),
        F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("_x"),
    ).where(F.col("_x").isNotNull())
    bounds = seen.agg(F.max("_o").alias("o"), F.max("_x").alias("x")).first()
    # every estimate lies between 0 and the largest value seen or carried in
    top = bounds["x"] or 0.0
    if initial is not None:
        top = max(top, initial.agg(F.max("estimate")).first()[0] or 0.0)

    def settle(start: Column, xs: Column) -> list[Column]:
        """State of a block: a known result, or else its observations."""
        low = F.aggregate(xs, F.coalesce(start, F.lit(0.0)), ewma_step)
        high = F.aggregate(xs, F.coalesce(start, F.lit(top)), ewma_step)
        known = start.isNotNull() | (high - low <= top * 1e-15)
        return [
            F.when(known, low).alias("_start"),
            F.when(known, F.array().cast("array<double>")).otherwise(xs).alias("_xs"),
        ]

    level = (
        seen.groupBy(key, F.floor(F.col("_o") / block_rows).alias("_block"))
        .agg(
            F.sort_array(F.collect_list(F.struct("_o", "_x"))).alias("_obs"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(key, "_block", "_n", *settle(F.lit(None).cast("double"), F.col("_obs._x")))
    )
    last_block = (bounds["o"] or 0) // block_rows
    while last_block > 0:
        last_block //= fanout
        merged = level.groupBy(key, F.floor(F.col("_block") / fanout).alias("_up")).agg(
            F.sum("_n").alias("_n"),
            F.sort_array(F.collect_list(F.struct("_block", "_start", "_xs"))).alias("_parts"),
            F.max(F.when(F.col("_start").isNotNull(), F.col("_block"))).alias("_known"),
        )
        # whatever precedes the last block with a known result has no influence
        known = F.col("_known")
        tail = F.filter("_parts", lambda p: known.isNull() | (p["_block"] >= known))
        start = F.element_at(F.concat(tail["_start"], F.array(F.lit(None).cast("double"))), 1)
        level = merged.withColumns({"_first": start, "_rest": F.flatten(tail["_xs"])}).select(
            key, F.col("_up").alias("_block"), "_n", *settle(F.col("_first"), F.col("_rest"))
        )
    if initial is not None:
        before = initial.select(
            key, F.col("estimate").alias("_before"), F.col("samples").alias("_samples")
        )
        level = level.join(before, key, "full_outer")
    else:
        level = level.withColumns({"_before": F.lit(None).cast("double"), "_samples": F.lit(0)})
    start = F.coalesce(F.col("_start"), F.col("_before"))
    xs = F.coalesce(F.col("_xs"), F.array().cast("array<double>"))
    # a key without a start value begins with its first observation
    begin = F.coalesce(start, F.try_element_at(xs, F.lit(1)))
    rest = F.when(start.isNull() & (F.size(xs) > 0), F.slice(xs, F.lit(2), F.size(xs))).otherwise(xs)
    samples = F.coalesce("_n", F.lit(0)) + F.coalesce("_samples", F.lit(0))
    return level.select(
        key,
        F.aggregate(rest, begin, ewma_step).alias("estimate"),
        samples.cast("bigint").alias("samples"),
    )


def sortable_bits(value: Column) -> Column:
    """A bigint that orders as Spark orders the double ``value``: 0.0 equals -0.0, NaN is the largest."""
    plain = F.when(value.isNull() | (value == 0), F.lit(0.0)).otherwise(value)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("bigint")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def rank_select(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Mapping[str, Callable[[Column], Column]],
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Exact order statistics per key: (keys, n, one column per rank).

    ``ranks`` maps an output name to its 0-based rank, given the group size.
    A null value does not count; NaN does, as the largest. A key without values
    has no row.

    Rows are counted by the first ``DIGIT`` bits of their sortable form, which
    says what block of a key holds a wanted rank. Blocks of more than
    ``block_rows`` rows are counted again by the next bits, rows of other blocks
    no more, so after at most four passes a block is small or of one value. Only
    the rows of blocks that hold a rank are ordered in the end.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    rows = df.where(number.isNotNull()).select(*keys, number.alias("_v"))
    rows = rows.withColumn("_u", sortable_bits(F.col("_v")))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    targets, shift = None, 64
    while shift > 0:
        shift -= DIGIT
        inside, block = rows, keys
        if targets is not None:
            inside, block = _of_blocks(rows, targets, keys, shift + DIGIT), [*keys, "_b", "_n", "_before", "_want"]
        digit = F.shiftright("_u", shift)
        counted = inside.groupBy(*block, digit.alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
        per_block = Window.partitionBy(*block)
        placed = counted.withColumn("_past", F.sum("_c").over(per_block.orderBy("_d")) - F.col("_c"))
        if targets is None:
            placed = placed.withColumn("_n", F.sum("_c").over(per_block)).withColumns(
                {"_want": wanted, "_before": F.lit(0).cast("bigint")}
            )
        start = F.col("_start")
        here = F.filter("_want", lambda w: (w["rank"] >= start) & (w["rank"] < start + F.col("_c")))
        found = placed.withColumn("_start", F.col("_before") + F.col("_past")).withColumn("_here", here)
        found = found.where(F.size("_here") > 0).select(
            *keys, F.col("_d").alias("_b"), "_n", start.alias("_before"), "_c", F.col("_here").alias("_want")
        )
        targets = materialize(found, "blocks_of_ranks")
        if (targets.agg(F.max("_c")).first()[0] or 0) <= block_rows:
            break
    # Equal values are counted before they are ordered.
    block = [*keys, "_b", "_n", "_before", "_want"]
    values = _of_blocks(rows, targets, keys, shift).groupBy(*block, "_u").agg(
        F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v")
    )
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_u"))
    hits = F.filter("_want", lambda w: (w["rank"] < F.col("_end")) & (w["rank"] >= F.col("_end") - F.col("_c")))
    picked = (
        values.withColumn("_end", end)
        .withColumn("_hit", F.explode(hits))
        .select(*keys, "_n", F.col("_hit.name").alias("_name"), "_v")
    )
    return picked.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks],
    )


def _of_blocks(rows: DataFrame, targets: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """The rows whose key and bits above ``shift`` name a block of ``targets``; null keys are keys."""
    at = targets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_b", "_n", "_before", "_want")
    same = F.shiftright("_u", shift) == F.col("_b")
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(F.col(f"_k{i}"))
    return rows.join(at, same).drop(*[f"_k{i}" for i in range(len(keys))])


def interpolated(df: DataFrame, out: str, fraction: float, lower: str, upper: str) -> DataFrame:
    """Linear interpolation at rank ``fraction * (n - 1)`` between two order statistics."""
    rank = F.lit(fraction) * (F.col("n") - 1)
    part = rank - F.floor(rank)
    return df.withColumn(out, F.col(lower) * (1 - part) + F.col(upper) * part).drop(lower, upper)


def asof_last(
    probes: DataFrame,
    entries: DataFrame,
    key: str,
    probe_at: str,
    entry_at: str,
    payload: Sequence[str],
    block_span: int,
) -> DataFrame:
    """Each probe with the newest entry of its key strictly before it.

    Times are integers. Entries and probes meet inside blocks of ``block_span``
    time units; a probe before the first entry of its block takes the last entry
    of the blocks before, found by a window over one row per block.
    """
    rest = [c for c in probes.columns if c not in (key, probe_at)]
    entry = entries.select(
        F.col(key), F.col(entry_at).alias("_t"), F.struct(entry_at, *payload).alias("_entry")
    )
    probe = probes.select(
        F.col(key), F.col(probe_at).alias("_t"), F.struct(probe_at, *rest).alias("_probe")
    )
    both = probe.unionByName(entry, allowMissingColumns=True).withColumn(
        "_block", F.floor(F.col("_t") / block_span).cast("bigint")
    )
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(key, "_block")
        .agg(F.max("_entry").alias("_newest"))
        .withColumn("_carry", F.max("_newest").over(before))
        .select(key, "_block", "_carry")
    )
    inside = (
        Window.partitionBy(key, "_block").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
    )
    matched = both.withColumn("_local", F.max("_entry").over(inside)).where(
        F.col("_probe").isNotNull()
    )
    entry_col = F.coalesce(F.col("_local"), F.col("_carry"))
    return (
        matched.join(carry, [key, "_block"])
        .withColumn("_hit", entry_col)
        .select(key, "_probe.*", F.col("_hit").alias("last_entry"))
    )
