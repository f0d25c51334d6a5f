"""Run-log statistics, ordered folds and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalars import epoch_micros
from lakeloom.operators import ordered as W
from lakeloom.operators import runlog as R
from lakeloom.operators.topk import run_history
from lakeloom.plans.registry import query


@query(
    "recent_n_per_node",
    "W2",
    """SELECT node_id, id, status, row_number() OVER (PARTITION BY node_id ORDER BY id DESC) AS rank
       FROM v_log QUALIFY rank <= 10""",
)
def _(t):
    recent = W.recent_n_per_node(t.v_log, 10)
    return recent.select("node_id", "id", "status", F.col("rank").cast("bigint").alias("rank"))


@query(
    "running_fold",
    "W3",
    """SELECT event_id, user_id, (sum(value::DECIMAL(18,4)) OVER
         (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::DOUBLE AS running
       FROM events""",
)
def _(t):
    rows = t.events.select(
        "event_id", "user_id", F.col("value").cast("decimal(18,4)").alias("value")
    )
    out = W.running_fold(rows, ["user_id"], "event_id", "value")
    return out.select("event_id", "user_id", F.col("running").cast("double").alias("running"))


SQL_EWMA = """
    SELECT event_type, round(list_reduce(list(greatest(value, 0) ORDER BY event_id),
             lambda v, x: CASE WHEN x > v THEN 0.5::DOUBLE * x + 0.5::DOUBLE * v
               ELSE greatest(0.25::DOUBLE * x + 0.75::DOUBLE * v, v * 0.7::DOUBLE) END), 6) AS estimate,
           count(*) AS samples
    FROM events GROUP BY event_type"""


@query("asym_ewma", "W4", SQL_EWMA)
def _(t):
    return W.asym_ewma(t.events, "event_type", "event_id", "value").withColumn(
        "estimate", F.round("estimate", 6)
    )


@query(
    "run_history",
    "T4",
    """SELECT run_id, count(*) AS steps_total FROM v_log GROUP BY run_id
       ORDER BY run_id DESC LIMIT 20""",
)
def _(t):
    runs = t.v_log.groupBy("run_id").agg(F.count(F.lit(1)).alias("steps_total"))
    return run_history(runs, 20)


@query(
    "node_stats",
    "R1",
    """WITH h AS (SELECT *, count(*) OVER (PARTITION BY node_id, run_hash) AS c,
                    CASE WHEN elapsed_seconds > 0 THEN elapsed_seconds END AS e FROM v_log)
       SELECT node_id, count(*) AS total_runs, round(avg(e), 9) AS avg_elapsed,
              max(e) AS max_elapsed, round(quantile_cont(e, 0.5), 9) AS median_elapsed,
              round(quantile_cont(e, 0.95), 9) AS p95_elapsed,
              CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE c > 1) / count(*) ELSE 0 END
                AS repeat_hash_rate
       FROM h GROUP BY node_id""",
)
def _(t):
    rounded = ["avg_elapsed", "median_elapsed", "p95_elapsed"]
    return R.node_stats(t.v_log).withColumns({c: F.round(c, 9) for c in rounded})


@query(
    "base_average",
    "R2",
    """SELECT base_id, round(avg(elapsed_seconds), 9) AS avg_elapsed, count(*) AS rows
       FROM v_log GROUP BY base_id""",
)
def _(t):
    return R.base_average(t.v_log).withColumn("avg_elapsed", F.round("avg_elapsed", 9))


@query(
    "estimate_remaining",
    "R3",
    """WITH p AS (SELECT event_type AS base_id, count(DISTINCT user_id) AS partitions FROM events
                  GROUP BY 1 UNION ALL SELECT 'never_run', 7),
            a AS (SELECT base_id, avg(elapsed_seconds) AS m FROM v_log GROUP BY 1)
       SELECT sum(partitions)::BIGINT AS steps, round(sum(m * partitions), 6) AS estimated_seconds
       FROM p LEFT JOIN a USING (base_id)""",
)
def _(t):
    plan = t.events.groupBy(F.col("event_type").alias("base_id")).agg(
        F.count_distinct("user_id").alias("partitions")
    )
    fresh = t.spark.createDataFrame([("never_run", 7)], "base_id string, partitions bigint")
    out = R.estimate_remaining(plan.unionByName(fresh), t.v_log)
    return out.withColumn("estimated_seconds", F.round("estimated_seconds", 6))


SQL_ESTIMATES = """
    e AS (SELECT event_type || '[user=' || user_id || ']' AS node_id,
                 event_type || (user_id % 7) AS base_id, max(value) AS estimate_seconds
          FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type, user_id),
    n AS (SELECT DISTINCT
            CASE WHEN length(props) = 9 THEN 'click' ELSE event_type END || '[user=' || user_id ||
              CASE WHEN value > 60 THEN 'x' ELSE '' END || ']' AS node_id,
            CASE WHEN length(props) = 9 THEN 'click' ELSE event_type END || (user_id % 7) AS base_id
          FROM events)"""


@query(
    "cost_prior",
    "R4",
    f"""WITH {SQL_ESTIMATES},
          s AS (SELECT base_id, list_sort(list(estimate_seconds))[count(*) // 2 + 1] AS sibling
                FROM e GROUP BY 1)
        SELECT n.node_id, coalesce(e.estimate_seconds, sibling, 30.0::DOUBLE) AS estimate_seconds,
               CASE WHEN e.node_id IS NOT NULL THEN 'node' WHEN sibling IS NOT NULL THEN 'base'
                    ELSE 'default' END AS source
        FROM n LEFT JOIN e ON e.node_id = n.node_id LEFT JOIN s ON s.base_id = n.base_id""",
)
def _(t):
    user = F.col("user_id").cast("string")
    family = (F.col("user_id") % 7).cast("string")
    estimates = (
        t.events.where(F.col("event_type").isin("click", "error"))
        .groupBy("event_type", "user_id")
        .agg(F.max("value").alias("estimate_seconds"))
        .select(
            F.concat("event_type", F.lit("[user="), user, F.lit("]")).alias("node_id"),
            F.concat("event_type", family).alias("base_id"),
            "estimate_seconds",
        )
    )
    kind = F.when(F.length("props") == 9, "click").otherwise(F.col("event_type"))
    mark = F.when(F.col("value") > 60, "x").otherwise("")
    nodes = t.events.select(
        F.concat(kind, F.lit("[user="), user, mark, F.lit("]")).alias("node_id"),
        F.concat(kind, family).alias("base_id"),
    ).distinct()
    return R.cost_prior(nodes, estimates)


@query(
    "peak_resource",
    "R5",
    """SELECT node_id, max(rss) AS max_rss_bytes, arg_max(cpu, id) AS cpu_seconds,
              count(*) AS samples FROM
         (SELECT l.*, elapsed_seconds * 0.8 AS cpu, length(error_message || node_id || run_hash)
                 * 1024 + id % 4096 AS rss0, (id * 7919) % 100003 AS rss FROM v_log l)
       GROUP BY node_id""",
)
def _(t):
    log = t.v_log.withColumns(
        {"cpu": F.col("elapsed_seconds") * 0.8, "rss": (F.col("id") * 7919) % 100003}
    )
    return R.peak_resource(log, "cpu", "rss")


@query(
    "failure_summary",
    "R6",
    """SELECT node_id, count(*) FILTER (WHERE status = 'failed') AS failures,
              sum(attempts)::BIGINT AS attempts,
              arg_max(error_message, id) FILTER (WHERE status = 'failed') AS last_error
       FROM v_log GROUP BY node_id""",
)
def _(t):
    return R.failure_summary(t.v_log)


@query(
    "run_rollup",
    "R7",
    """SELECT run_id, count(*) AS steps_total, count(*) FILTER (WHERE attempts > 1) AS steps_executed,
              count(*) FILTER (WHERE attempts = 1) AS steps_cached,
              CASE WHEN bool_or(status = 'failed') THEN 'failed' ELSE 'success' END AS status,
              round(sum(elapsed_seconds), 6) AS elapsed_seconds
       FROM v_log GROUP BY run_id""",
)
def _(t):
    log = t.v_log.withColumn("cached", F.col("attempts") == 1)
    return R.run_rollup(log).withColumn("elapsed_seconds", F.round("elapsed_seconds", 6))


@query(
    "trigger_lateness",
    "R8",
    """WITH s AS (SELECT event_type, (epoch_us(ts) % 60000000) / 1000000.0::DOUBLE AS late FROM events),
            l AS (SELECT event_type, list_sort(list(late)) AS v, count(*) AS n FROM s GROUP BY 1)
       SELECT event_type, n AS fires, round(v[1], 3) AS min_s,
              round(v[round_even(0.5 * (n - 1), 0)::BIGINT + 1], 3) AS median_s,
              round(v[round_even(0.95 * (n - 1), 0)::BIGINT + 1], 3) AS p95_s,
              round(v[n], 3) AS max_s FROM l""",
)
def _(t):
    fires = t.events.select(
        "event_type", (epoch_micros("ts").cast("decimal(20,0)") / 1_000_000).alias("at")
    )
    return R.trigger_lateness(fires, "event_type", "at")


DAY = 86_400
START, END = 1_704_067_200, 1_704_153_600  # first day of 2024

SQL_SCHEDULES = """
    s AS (SELECT c_custkey AS schedule_id, 3600 * (1 + c_custkey % 5) AS period_s,
                 60 * c_nationkey AS offset_s FROM customer)"""


def schedules(t):
    return t.customer.select(
        F.col("c_custkey").alias("schedule_id"),
        (3600 * (1 + F.col("c_custkey") % 5)).alias("period_s"),
        (60 * F.col("c_nationkey")).cast("bigint").alias("offset_s"),
    )


@query(
    "due_ticks",
    "R9",
    f"""WITH {SQL_SCHEDULES}
        SELECT schedule_id, offset_s + k * period_s AS tick_at FROM (
          SELECT *, unnest(range(ceil(({START} - offset_s) / period_s)::BIGINT,
                                 floor(({END} - offset_s) / period_s)::BIGINT + 1)) AS k FROM s)""",
)
def _(t):
    return R.due_ticks(schedules(t), F.lit(START), F.lit(END))


@query(
    "missed_ticks",
    "R10",
    f"""WITH {SQL_SCHEDULES},
          f AS (SELECT c_custkey AS schedule_id, {START} + (c_acctbal * 7)::BIGINT AS last_fired_at
                FROM customer WHERE c_acctbal > 0),
          j AS (SELECT s.*, last_fired_at AS l,
                  greatest(floor(({END} - offset_s) / period_s)
                           - floor((last_fired_at - offset_s) / period_s), 0)::BIGINT AS m
                FROM s LEFT JOIN f USING (schedule_id))
        SELECT schedule_id, CASE WHEN l IS NULL THEN 'anchor' WHEN m > 0 THEN 'catch_up'
                 ELSE 'none' END AS action, coalesce(m, 0) AS missed,
               CASE WHEN l IS NOT NULL AND m = 0 THEN l ELSE {END} END AS new_last_fired FROM j""",
)
def _(t):
    fired = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("schedule_id"),
        (F.lit(START) + F.round(F.col("c_acctbal") * 7).cast("bigint")).alias("last_fired_at"),
    )
    return R.missed_ticks(schedules(t), fired, F.lit(END).cast("bigint"))


@query(
    "overlap_skips",
    "R11",
    """WITH r AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + (value * 1000000)::BIGINT AS f
                  FROM events WHERE event_type IN ('click', 'error')),
            t AS (SELECT CASE WHEN event_type = 'view' THEN 'click' ELSE 'error' END AS event_type,
                         epoch_us(ts) AS tick FROM events
                  WHERE event_type NOT IN ('click', 'error'))
       SELECT t.event_type AS schedule_id, tick AS tick_at,
              CASE WHEN f > tick THEN 'skip' ELSE 'fire' END AS action
       FROM t ASOF LEFT JOIN r ON t.event_type = r.event_type AND t.tick > r.s""",
)
def _(t):
    kind, at = F.col("event_type"), epoch_micros("ts")
    started = kind.isin("click", "error")
    runs = t.events.where(started).select(
        kind.alias("schedule_id"),
        at.alias("started_at"),
        (at + F.round(F.col("value") * 1_000_000).cast("bigint")).alias("finished_at"),
    )
    ticks = t.events.where(~started).select(
        F.when(kind == "view", "click").otherwise("error").alias("schedule_id"),
        at.alias("tick_at"),
    )
    return R.overlap_skips(ticks, runs)


@query(
    "upsert_last_fired",
    "R12",
    """SELECT event_type || '#' || user_id AS node_id, max(epoch_us(ts) // 1000000) AS last_fired_at
       FROM events GROUP BY 1""",
)
def _(t):
    fires = t.events.select(
        F.concat("event_type", F.lit("#"), F.col("user_id").cast("string")).alias("node_id"),
        F.floor(epoch_micros("ts") / 1_000_000).cast("bigint").alias("last_fired_at"),
        "ts",
    )
    state = fires.where(F.expr("ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    newer = fires.where(F.expr("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return R.upsert_last_fired(R.upsert_last_fired(state, state), newer)
