"""Partitioned assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalars import hex_to_int, md5_8
from lakeloom.operators import partitions as G
from lakeloom.operators.incremental import partition_digest, stale_partitions
from lakeloom.plans.registry import query
from lakeloom.session import scratch_path
from lakeloom.sources.sinks import sink_partitioned


@query(
    "static_partitions",
    "G1",
    """SELECT k.event_type, count(event_id) AS n FROM
         (VALUES ('click'), ('error'), ('refund')) k(event_type)
         LEFT JOIN events USING (event_type) GROUP BY 1""",
)
def _(t):
    rows = G.static_partitions(t.events, {"event_type": ["click", "error", "refund"]})
    return rows.groupBy("event_type").agg(F.count("event_id").alias("n"))


@query("derived_partitions", "G2", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return G.derived_partitions(t.events, ["user_id", "event_type"])


@query(
    "partition_combos",
    "G3",
    """SELECT event_type, lang, user_id FROM (SELECT DISTINCT event_type FROM events),
         (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT user_id FROM events)""",
)
def _(t):
    return G.partition_combos(
        {
            "event_type": t.events.select("event_type"),
            "lang": t.documents.select("lang"),
            "user_id": t.events.select("user_id"),
        }
    )


@query(
    "explicit_keys",
    "G4",
    "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
)
def _(t):
    return G.explicit_keys(t.customer, ["c_nationkey", "c_mktsegment"])


@query(
    "key_suffix",
    "G5",
    """SELECT o_orderkey, 'orders.py:fetch[priority=' || o_orderpriority || ',status=' ||
         o_orderstatus || ']' AS step FROM orders""",
)
def _(t):
    keys = F.create_map(
        F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"
    )
    return t.orders.select(
        "o_orderkey", G.step_id(F.lit("orders.py:fetch"), keys).alias("step")
    )


@query(
    "parse_step_id",
    "G6",
    """SELECT o_orderkey, 'orders.py:fetch' AS base, 'a,' || o_orderpriority || ',b' AS priority,
         o_orderstatus AS status FROM orders""",
)
def _(t):
    keys = F.create_map(
        F.lit("status"),
        "o_orderstatus",
        F.lit("priority"),
        F.concat(F.lit("a,"), "o_orderpriority", F.lit(",b")),
    )
    ids = t.orders.select("o_orderkey", G.step_id(F.lit("orders.py:fetch"), keys).alias("step"))
    parsed = G.parse_step_id(F.col("step"))
    return ids.select(
        "o_orderkey",
        parsed["base"].alias("base"),
        parsed["keys"]["priority"].alias("priority"),
        parsed["keys"]["status"].alias("status"),
    )


@query(
    "map_aligned_chain",
    "G7",
    """SELECT ticker, price, price / 100 AS normalized,
         ('0x' || substr(md5(ticker || ':' || (price / 100)::VARCHAR), 1, 8))::BIGINT
           / 4294967296.0::DOUBLE AS score
       FROM (SELECT c_name AS ticker,
               ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 9000 + 500 AS price FROM customer)""",
)
def _(t):
    price = hex_to_int(md5_8("ticker")) % 9000 + 500
    return G.map_aligned_chain(t.customer.select(F.col("c_name").alias("ticker")), "ticker", price)


@query(
    "partitioned_etl",
    "G7",
    """SELECT ticker, price, substr(sha256(ticker || ':' || price), 1, 8) AS hash
       FROM (SELECT DISTINCT 'TICK_' || lpad(user_id::VARCHAR, 6, '0') AS ticker,
             length('TICK_' || lpad(user_id::VARCHAR, 6, '0')) * 100 + user_id AS price FROM events)""",
)
def _(t):
    universe = G.derived_partitions(t.events, ["user_id"])
    tickers = universe.select(F.format_string("TICK_%06d", "user_id").alias("ticker"), "user_id")
    priced = G.inherit_keys(
        tickers, ["ticker"], price=F.length("ticker") * 100 + F.col("user_id")
    )
    return G.enrich_with_hash(priced, "ticker", "price")


@query(
    "collect_list_by",
    "G8",
    """SELECT o_custkey, o_orderkey // 1000000 AS chunk, count(*) AS n,
              string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS items
       FROM orders GROUP BY 1, 2""",
)
def _(t):
    # the order key is repeated as the value, since it doubles as the sort position
    df = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("item"))
    lists = G.collect_list_by(df, "o_custkey", "o_orderkey", "item")
    return lists.select(
        "o_custkey",
        "chunk",
        F.size("items").cast("bigint").alias("n"),
        F.array_join("items", "|").alias("items"),
    )


@query(
    "collect_map_by",
    "G9",
    """SELECT o_custkey, o_orderkey // 1000000 AS chunk,
              string_agg(o_orderkey || '=' || o_orderstatus, ',' ORDER BY o_orderkey::VARCHAR) AS items
       FROM orders GROUP BY 1, 2""",
)
def _(t):
    df = t.orders.select(
        "o_custkey", "o_orderkey", F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus"
    )
    maps = G.collect_map_by(df, "o_custkey", "k", "o_orderstatus", "o_orderkey")
    return maps.select("o_custkey", "chunk", G.key_suffix(F.col("items")).alias("items"))


@query(
    "collect_gate",
    "G10",
    """SELECT event_id, user_id FROM events e WHERE NOT EXISTS
         (SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error'
          AND (f.props->>'$.k') = (e.props->>'$.k'))""",
)
def _(t):
    rows = t.events.select(
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
    )
    return G.collect_gate(rows, ["user_id", "k"]).select("event_id", "user_id")


@query(
    "inherit_keys",
    "G11",
    """SELECT c_custkey, c_mktsegment, length(c_name) * 100 / 100.0::DOUBLE AS normalized FROM customer""",
)
def _(t):
    return G.inherit_keys(
        t.customer, ["c_custkey", "c_mktsegment"], normalized=F.length("c_name") * 100 / 100.0
    )


@query(
    "single_partition",
    "G12",
    "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'O'",
)
def _(t):
    path = scratch_path(t.spark, "by-status")
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    sink_partitioned(df, path, ["o_orderstatus"])
    return G.single_partition(
        t.spark.read.schema(df.schema).parquet(path), {"o_orderstatus": "O"}
    )


@query(
    "partition_completeness",
    "G13",
    """WITH k AS (SELECT DISTINCT event_type AS base_id, user_id FROM events),
            s AS (SELECT event_type AS base_id, user_id, count(*) AS n FROM events
                  WHERE event_id % 3 = 0 GROUP BY 1, 2)
       SELECT base_id, user_id, coalesce(n, 0) AS materializations,
              CASE WHEN coalesce(n, 0) = 0 THEN 'lost' WHEN n > 1 THEN 'duplicated' ELSE 'once' END
                AS state FROM k LEFT JOIN s USING (base_id, user_id)""",
)
def _(t):
    keys = t.events.select(F.col("event_type").alias("base_id"), "user_id")
    log = t.events.select(
        F.col("event_type").alias("base_id"),
        "user_id",
        F.when(F.col("event_id") % 3 == 0, "success").otherwise("failed").alias("status"),
    )
    return G.partition_completeness(keys, log, ["base_id", "user_id"])


@query(
    "partition_listing",
    "G14",
    """WITH o AS (SELECT user_id, event_type, count(*) AS c, sum(value::DECIMAL(18,4)) AS v FROM events
                  WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2),
            n AS (SELECT user_id, event_type, count(*) AS c, sum(value::DECIMAL(18,4)) AS v FROM events
                  WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1, 2)
       SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.event_type, n.event_type)
                AS event_type,
              CASE WHEN n.user_id IS NULL THEN 'historical'
                   WHEN o.user_id IS NULL OR o.c <> n.c OR o.v <> n.v THEN 'stale'
                   ELSE 'active' END AS state
       FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""",
)
def _(t):
    keys = ["user_id", "event_type"]

    def content(condition):
        return (
            t.events.where(F.expr(condition))
            .groupBy(*keys)
            .agg(
                F.count(F.lit(1)).alias("c"),
                F.sum(F.col("value").cast("decimal(18,4)")).alias("v"),
            )
        )

    old = content("ts < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    new = content("ts >= TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    columns = ["c", "v"]
    stale = stale_partitions(
        partition_digest(new, keys, columns), partition_digest(old, keys, columns), keys
    )
    return G.partition_listing(old, new, stale, keys)
