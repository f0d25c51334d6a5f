"""Statistics over materialization logs, schedules and fires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.ordered import asof_last, interpolated, rank_select

# Fixed value: the estimate for a node without any history, in seconds.
COLD_START_SECONDS = 30.0


def node_stats(log: DataFrame) -> DataFrame:
    """Per node: total rows, mean, median, p95 and max duration, repeat rate.

    Durations count when positive. The repeat rate is the share of rows whose
    run hash occurs more than once, 0 for a single row.
    """
    timed = F.when(F.col("elapsed_seconds") > 0, F.col("elapsed_seconds"))
    per_hash = log.groupBy("node_id", "run_hash").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count(timed).alias("_timed"),
        F.sum(timed).alias("_sum"),
        F.max(timed).alias("_max"),
    )
    rows = F.sum("_rows")
    repeated = F.sum(
        F.when(
            (F.col("_rows") > 1) & F.col("run_hash").isNotNull() & (F.col("run_hash") != ""),
            F.col("_rows"),
        ).otherwise(0)
    )
    totals = per_hash.groupBy("node_id").agg(
        rows.alias("total_runs"),
        (F.sum("_sum") / F.sum("_timed")).alias("avg_elapsed"),
        F.max("_max").alias("max_elapsed"),
        F.when(rows > 1, repeated / rows).otherwise(F.lit(0.0)).alias("repeat_hash_rate"),
    )
    at = lambda p, fn: lambda n: fn(F.lit(p) * (n - 1))
    ranks = rank_select(
        log.where(F.col("elapsed_seconds") > 0),
        ["node_id"],
        "elapsed_seconds",
        {
            "m_lo": at(0.5, F.floor),
            "m_hi": at(0.5, F.ceil),
            "p_lo": at(0.95, F.floor),
            "p_hi": at(0.95, F.ceil),
        },
    )
    ranks = interpolated(ranks, "median_elapsed", 0.5, "m_lo", "m_hi")
    ranks = interpolated(ranks, "p95_elapsed", 0.95, "p_lo", "p_hi").drop("n")
    return totals.join(ranks, "node_id", "left")


def base_average(log: DataFrame) -> DataFrame:
    """Mean duration of a base over all its partitions."""
    return log.groupBy("base_id").agg(
        F.avg("elapsed_seconds").alias("avg_elapsed"), F.count(F.lit(1)).alias("rows")
    )


def estimate_remaining(plan: DataFrame, log: DataFrame) -> DataFrame:
    """Estimated seconds of a plan (base_id, partitions): sum of average times count.

    A base without history adds nothing, as it has no average.
    """
    return (
        plan.join(base_average(log).drop("rows"), "base_id", "left")
        .agg(
            F.sum("partitions").alias("steps"),
            F.coalesce(
                F.sum(F.col("avg_elapsed") * F.col("partitions")), F.lit(0.0)
            ).alias("estimated_seconds"),
        )
    )


def cost_prior(nodes: DataFrame, estimates: DataFrame) -> DataFrame:
    """Estimate per node: its own, else the upper median of its base, else the default.

    ``estimates`` is (node_id, base_id, estimate_seconds).
    """
    siblings = rank_select(
        estimates, ["base_id"], "estimate_seconds", {"sibling": lambda n: F.floor(n / 2)}
    ).drop("n")
    own = estimates.select("node_id", F.col("estimate_seconds").alias("_own"))
    source = (
        F.when(F.col("_own").isNotNull(), "node")
        .when(F.col("sibling").isNotNull(), "base")
        .otherwise("default")
    )
    return (
        nodes.select("node_id", "base_id")
        .join(own, "node_id", "left")
        .join(siblings, "base_id", "left")
        .select(
            "node_id",
            F.coalesce("_own", "sibling", F.lit(COLD_START_SECONDS)).alias("estimate_seconds"),
            source.alias("source"),
        )
    )


def peak_resource(log: DataFrame, cpu: str, rss: str) -> DataFrame:
    """Largest memory, last CPU time and sample count per node."""
    return log.groupBy("node_id").agg(
        F.max(rss).alias("max_rss_bytes"),
        F.max_by(cpu, "id").alias("cpu_seconds"),
        F.count(F.lit(1)).alias("samples"),
    )


def failure_summary(log: DataFrame) -> DataFrame:
    """Failures, attempts and the last error per node."""
    failed = F.col("status") == "failed"
    return log.groupBy("node_id").agg(
        F.count_if(failed).alias("failures"),
        F.sum("attempts").alias("attempts"),
        F.max_by("error_message", F.when(failed, F.col("id"))).alias("last_error"),
    )


def run_rollup(log: DataFrame) -> DataFrame:
    """One row per run: steps, outcome and elapsed time."""
    cached = F.col("cached")
    return log.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("steps_total"),
        F.count_if(~cached).alias("steps_executed"),
        F.count_if(cached).alias("steps_cached"),
        F.when(F.bool_or(F.col("status") == "failed"), "failed").otherwise("success").alias(
            "status"
        ),
        F.sum("elapsed_seconds").alias("elapsed_seconds"),
    )


def trigger_lateness(fires: DataFrame, label: str, seconds: str) -> DataFrame:
    """Seconds past the minute per label: count, min, median, p95, max.

    Percentiles pick the nearest index, ``round(p * (n - 1))`` with ties to even.
    """
    late = fires.select(label, F.pmod(F.col(seconds), F.lit(60)).cast("double").alias("late"))
    pick = lambda p: lambda n: F.bround(F.lit(p) * (n - 1), 0)
    ranks = rank_select(
        late,
        [label],
        "late",
        {
            "min_s": lambda n: F.lit(0),
            "median_s": pick(0.5),
            "p95_s": pick(0.95),
            "max_s": lambda n: n - 1,
        },
    )
    return ranks.select(
        label,
        F.col("n").alias("fires"),
        *[F.round(c, 3).alias(c) for c in ("min_s", "median_s", "p95_s", "max_s")],
    )


def due_ticks(schedules: DataFrame, start: Column, end: Column) -> DataFrame:
    """Tick times (epoch seconds) of each schedule (schedule_id, period_s, offset_s).

    Ticks are ``offset + k * period`` in [start, end]. A schedule is first
    spread over spans of 10,000 ticks, so a per-second schedule over years is
    generated by many tasks.
    """
    per_span = 10_000
    first = F.ceil((start - F.col("offset_s")) / F.col("period_s")).cast("bigint")
    last = F.floor((end - F.col("offset_s")) / F.col("period_s")).cast("bigint")
    ranged = schedules.withColumns({"_first": first, "_last": last}).where(
        F.col("_first") <= F.col("_last")
    )
    spans = ranged.withColumn(
        "_span",
        F.explode(
            F.sequence(
                F.floor(F.col("_first") / per_span), F.floor(F.col("_last") / per_span)
            )
        ),
    ).hint("rebalance")
    low = F.greatest(F.col("_first"), F.col("_span") * per_span)
    high = F.least(F.col("_last"), (F.col("_span") + 1) * per_span - 1)
    return spans.withColumn("_k", F.explode(F.sequence(low, high))).select(
        "schedule_id", (F.col("offset_s") + F.col("_k") * F.col("period_s")).alias("tick_at")
    )


def missed_ticks(schedules: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Catch-up decision per schedule (schedule_id, period_s, offset_s).

    A schedule fires once when its next tick after the last fire is already
    due, however many ticks were missed; one never seen is only anchored. Times
    are epoch seconds.
    """
    last, period, offset = F.col("last_fired_at"), F.col("period_s"), F.col("offset_s")
    following = offset + (F.floor((last - offset) / period) + 1) * period
    missed = F.greatest(
        F.floor((now - offset) / period) - F.floor((last - offset) / period), F.lit(0)
    )
    action = (
        F.when(last.isNull(), "anchor").when(following <= now, "catch_up").otherwise("none")
    )
    return schedules.join(state, "schedule_id", "left").select(
        "schedule_id",
        action.alias("action"),
        F.coalesce(missed, F.lit(0)).cast("bigint").alias("missed"),
        F.when(action == "none", last).otherwise(now).alias("new_last_fired"),
    )


def overlap_skips(ticks: DataFrame, runs: DataFrame, block_span: int = 3_600_000_000) -> DataFrame:
    """Whether each tick (schedule_id, tick_at) meets a run still in flight.

    ``runs`` is (schedule_id, started_at, finished_at); the newest run started
    before the tick decides. Times are integers of one unit.
    """
    joined = asof_last(
        ticks, runs, "schedule_id", "tick_at", "started_at", ["finished_at"], block_span
    )
    busy = F.col("last_entry.finished_at") > F.col("tick_at")
    return joined.select(
        "schedule_id",
        "tick_at",
        F.when(busy, "skip").otherwise("fire").alias("action"),
    )


def upsert_last_fired(state: DataFrame, fires: DataFrame) -> DataFrame:
    """Newest fire per node over the stored state and new fires."""
    columns = ["node_id", "last_fired_at"]
    return (
        state.select(columns)
        .unionByName(fires.select(columns))
        .groupBy("node_id")
        .agg(F.max("last_fired_at").alias("last_fired_at"))
    )
