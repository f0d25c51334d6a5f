"""Sensors and refreshes run to the end of the available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalars import epoch_micros, fixed_units
from lakeloom.operators import lineage as L
from lakeloom.plans.registry import query
from lakeloom.plans.runlog import SQL_EWMA
from lakeloom.session import scratch_path
from lakeloom.streaming import streams as S

EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


def event_parts(t, parts: int = 2):
    """All events, cut into consecutive ranges of ids as they would arrive."""
    events = t.events.select(*EVENT_COLUMNS)
    step = (events.agg(F.max("event_id")).first()[0] or 0) // parts + 1
    return [events.where(F.floor(F.col("event_id") / step) == i) for i in range(parts)]


def arrive(t, parts, take_up):
    """Drop each part into an inbox and let ``take_up(stream, root)`` run after it.

    Every run resumes from the checkpoint of the one before and sees the new
    files only; the result of the last run is returned.
    """
    inbox, root = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "stream")
    out = None
    for part in parts:
        part.write.mode("append").parquet(inbox)
        out = take_up(S.sensor_file_stream(t.spark, inbox, part.schema), root)
    return out


@query("sensor_file_stream", "ST1", "SELECT event_id, user_id, event_type, value FROM events")
def _(t):
    inbox, root = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "stream")
    out = None
    for part in event_parts(t):
        part.write.mode("append").parquet(inbox)
        out = S.ingest_files(t.spark, inbox, part.schema, max_files=100, root=root)
    return out.select("event_id", "user_id", "event_type", "value")


@query(
    "observe_change",
    "ST2",
    """SELECT 'orders' AS sensor, poll, poll <> 1 AS update_detected, (SELECT count(*) FROM orders)
         AS row_count FROM (VALUES (0), (1), (2)) v(poll)""",
)
def _(t):
    """Three polls of the order table: first seen, unchanged, one price changed."""
    rows = t.orders.select("o_orderkey", fixed_units("o_totalprice", 2).alias("cents"))
    first = rows.agg(F.min("o_orderkey")).scalar()
    bump = F.when(F.col("o_orderkey") == first, 1).otherwise(0)
    changed = rows.withColumn("cents", F.col("cents") + bump)
    log = arrive(
        t,
        [rows, rows, changed],
        lambda stream, root: S.observation_log(
            t.spark, stream, "orders", ["o_orderkey", "cents"], root
        ),
    )
    return log.select("sensor", F.col("poll").cast("int").alias("poll"), "update_detected", "row_count")


@query(
    "propagate_if_updated",
    "ST3",
    """WITH RECURSIVE a AS (SELECT o_custkey, count(*) AS n FROM orders
                             WHERE o_orderdate < TIMESTAMP '2001-07-01' GROUP BY 1),
            b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
            u AS (SELECT o_custkey AS node_id FROM b LEFT JOIN a USING (o_custkey)
                  WHERE a.n IS DISTINCT FROM b.n),
            r AS (SELECT node_id FROM u
                  UNION SELECT downstream FROM v_edges JOIN r ON upstream = node_id)
       SELECT node_id FROM r""",
)
def _(t):
    """One sensor per customer, polled before and after the last month of orders."""

    def poll(orders, number):
        return (
            orders.groupBy(F.col("o_custkey").alias("sensor"))
            .agg(F.count(F.lit(1)).alias("digest"))
            .withColumn("poll", F.lit(number))
        )

    before = poll(t.orders.where(F.expr("o_orderdate < TIMESTAMP_NTZ '2001-07-01 00:00:00'")), 0)
    after = poll(t.orders, 1)
    last = before.select("sensor", F.col("digest").alias("last"))
    observed = after.join(last, "sensor", "left").select(
        "sensor", "poll", (~F.col("digest").eqNullSafe(F.col("last"))).alias("update_detected")
    )
    first = before.select("sensor", "poll", F.lit(True).alias("update_detected"))
    updated = S.updated_sources(first.unionByName(observed))
    return L.downstream_closure(t.v_edges, updated.select(F.col("sensor").alias("node_id")))


@query(
    "stream_type_counts",
    "ST4",
    "SELECT event_type, count(*) AS count FROM events WHERE value > 0.1 GROUP BY 1",
)
def _(t):
    return arrive(
        t,
        event_parts(t),
        lambda stream, root: S.stream_type_counts(
            t.spark, stream.where("value > 0.1"), "event_type", root
        ),
    )


@query(
    "stream_daily_counts",
    "ST5",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS count FROM events GROUP BY 1, 2""",
)
def _(t):
    # a last sentinel row moves the watermark past the final day, which closes it
    sentinel = t.events.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("bigint").alias("event_id"),
        (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("ts"),
        F.lit(-1).cast("bigint").alias("user_id"),
        F.lit("sentinel").alias("event_type"),
        F.lit(0.0).alias("value"),
    )

    def take_up(stream, root):
        # the zoneless event time becomes the instant with the same UTC clock
        timed = stream.withColumn("ts", F.timestamp_micros(epoch_micros("ts")))
        return S.stream_daily_counts(t.spark, timed, "ts", ["event_type"], "1 day", root)

    daily = arrive(t, [*event_parts(t), sentinel], take_up)
    return daily.where("event_type <> 'sentinel'")


def per_type(df):
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(fixed_units("value", 2)).alias("cents"),
        F.count_distinct("user_id").alias("users"),
    )


@query(
    "stream_partition_refresh",
    "ST6",
    """SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents,
              count(DISTINCT user_id) AS users FROM events GROUP BY 1""",
)
def _(t):
    return arrive(
        t,
        event_parts(t),
        lambda stream, root: S.stream_partition_refresh(
            t.spark, stream.drop("file_name"), ["event_type"], per_type, root
        ),
    )


@query("stream_dedupe", "ST7", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    # the second arrival repeats every row of the first
    events = t.events.select(*EVENT_COLUMNS)
    out = arrive(
        t,
        [events, events],
        lambda stream, root: S.stream_dedupe(
            t.spark,
            stream.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")),
            ["event_id"],
            "ts",
            "1 day",
            root,
        ),
    )
    return out.drop("ts")


@query("stream_ewma", "ST8", SQL_EWMA)
def _(t):
    out = arrive(
        t,
        event_parts(t),
        lambda stream, root: S.stream_ewma(
            t.spark, stream, "event_type", "event_id", "value", root
        ),
    )
    return out.withColumn("estimate", F.round("estimate", 6))


@query(
    "scheduled_refresh",
    "ST9",
    """SELECT run, n FROM (SELECT 0 AS run, count(*) AS n FROM events
         WHERE event_id <= (SELECT max(event_id) FROM events) // 2
         UNION ALL SELECT 1, count(*) FROM events
         WHERE event_id > (SELECT max(event_id) FROM events) // 2)""",
)
def _(t):
    """Two runs of one schedule: the second takes up what came while it was down."""
    root = scratch_path(t.spark, "refresh")
    folder = f"{root}/inbox"
    events = t.events.select(*EVENT_COLUMNS)
    middle = (events.agg(F.max("event_id")).first()[0] or 0) // 2

    def refresh(batch, batch_id):
        batch.agg(
            F.lit(batch_id).alias("run"), F.count(F.lit(1)).alias("n")
        ).write.mode("overwrite").parquet(f"{root}/runs/run_{batch_id}")

    for part in (events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)):
        part.write.mode("append").parquet(folder)
        S.scheduled_refresh(
            t.spark,
            lambda: S.sensor_file_stream(t.spark, folder, events.schema),
            refresh,
            f"{root}/checkpoint",
        )
    return t.spark.read.schema("run int, n bigint").parquet(f"{root}/runs/*")
