"""Sources and sinks, read back after writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.incremental import run_fingerprint_of
from lakeloom.plans.registry import query
from lakeloom.session import scratch_path
from lakeloom.sources import readers as R
from lakeloom.sources import sinks as K

SQL_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_parquet", "SC1", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def _(t):
    df = R.scan_parquet(t.spark, f"{t.sf_dir}/orders.parquet")
    return df.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("scan_json", "SC2", SQL_CUSTOMER)
def _(t):
    path = scratch_path(t.spark, "customer.json")
    t.customer.write.json(path)
    return R.scan_json(t.spark, path, CUSTOMER)


@query(
    "inbox_scan",
    "SC3",
    """SELECT c_custkey, c_name, c_acctbal, c_mktsegment AS dropped_in FROM customer""",
)
def _(t):
    inbox = scratch_path(t.spark, "inbox")
    columns = ["c_custkey", "c_name", "c_acctbal"]
    t.customer.select(*columns, F.col("c_mktsegment").alias("part")).write.partitionBy("part").option(
        "header", "true"
    ).csv(inbox)
    rows = R.inbox_scan(t.spark, f"{inbox}/*", "c_custkey bigint, c_name string, c_acctbal double")
    return rows.select(
        *columns, F.regexp_extract("file_path", r"part=([^/]*)/", 1).alias("dropped_in")
    )


@query("scan_uri", "SC4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _(t):
    df = R.scan_uri(
        t.spark, f"file://{t.sf_dir}/supplier.parquet", options={"mergeSchema": "false"}
    )
    return df.select("s_suppkey", "s_name", "s_acctbal")


def _draw(name: str, modulus: int) -> str:
    return f"('0x' || substr(md5('42:{name}:' || o_orderkey), 1, 8))::BIGINT % {modulus}"


@query(
    "synthesize_rows",
    "SC5",
    f"""SELECT o_orderkey AS order_id, {_draw("customer", 10000)} AS customer_id,
        {_draw("product", 500)} AS product_id, {_draw("quantity", 20)} + 1 AS quantity,
        ({_draw("price", 49501)} + 500) / 100 AS unit_price,
        '2022-' || lpad(({_draw("month", 12)} + 1)::VARCHAR, 2, '0') || '-' ||
          lpad(({_draw("day", 28)} + 1)::VARCHAR, 2, '0') AS order_date,
        (['completed', 'completed', 'completed', 'returned', 'cancelled'])[{_draw("status", 5)} + 1]
          AS status,
        (['bronze', 'silver', 'gold', 'platinum'])[{_draw("tier", 4)} + 1] AS tier
        FROM orders""",
)
def _(t):
    return R.synthesize_rows(t.orders.select("o_orderkey"), "o_orderkey")


@query("sink_parquet", "SK1", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    path = scratch_path(t.spark, "orders.parquet")
    df = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    K.sink_parquet(df, path)
    return R.scan_parquet(t.spark, path)


@query("sink_json", "SK2", SQL_CUSTOMER)
def _(t):
    path = scratch_path(t.spark, "customer.json")
    K.sink_json(t.customer, path)
    return R.scan_json(t.spark, path, CUSTOMER)


@query("sink_text", "SK3", "SELECT c_name || '|' || c_mktsegment AS value FROM customer")
def _(t):
    path = scratch_path(t.spark, "customer.txt")
    K.sink_text(t.customer.select(F.concat_ws("|", "c_name", "c_mktsegment").alias("value")), path)
    return t.spark.read.text(path)


@query(
    "sink_all",
    "SK4",
    """SELECT sink, format, status, has_size,
              CASE WHEN status = 'ok' THEN (SELECT count(*) FROM customer) ELSE 0 END AS n_rows,
              CASE WHEN status = 'ok' AND format <> 'text' THEN (SELECT sum(c_custkey) FROM customer)::BIGINT
                   ELSE 0 END AS key_sum
       FROM (VALUES ('a.parquet', 'parquet', 'ok', true), ('b.json', 'json', 'ok', true),
         ('c.txt', 'text', 'ok', true), ('d.pkl', 'pickle', 'error', false),
         ('e', 'parquet', 'ok', true), ('f.json', 'yaml', 'error', false))
         v(sink, format, status, has_size)""",
)
def _(t):
    root = scratch_path(t.spark, "sinks")
    sinks = [K.Sink(f"{root}/{n}") for n in ("a.parquet", "b.json", "c.txt", "d.pkl", "e")]
    sinks.append(K.Sink(f"{root}/f.json", "yaml"))
    outcomes = K.sink_all(t.customer, sinks)
    # what the sinks hold, read back from where they were to write
    schema = t.customer.schema
    keyed = {
        "a.parquet": t.spark.read.schema(schema).parquet(f"{root}/a.parquet"),
        "b.json": t.spark.read.schema(schema).json(f"{root}/b.json"),
        "c.txt": t.spark.read.text(f"{root}/c.txt").select(F.lit(0).alias("c_custkey")),
        "e": t.spark.read.schema(schema).parquet(f"{root}/e"),
    }
    held = reduce(
        DataFrame.unionByName,
        [df.select(F.lit(n).alias("sink"), F.col("c_custkey").cast("bigint").alias("c_custkey")) for n, df in keyed.items()],
    )
    held = held.groupBy("sink").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("c_custkey").alias("key_sum"))
    return outcomes.withColumn("sink", F.substring_index("path", "/", -1)).join(held, "sink", "left").select(
        "sink",
        "format",
        "status",
        (F.coalesce("size_bytes", F.lit(0)) > 0).alias("has_size"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("key_sum", F.lit(0)).alias("key_sum"),
    )


@query(
    "sink_partitioned",
    "SK5",
    """SELECT o_orderkey, o_totalprice + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END
              AS o_totalprice, o_orderstatus FROM orders""",
)
def _(t):
    path = scratch_path(t.spark, "orders-by-status")
    df = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    K.sink_partitioned(df, path, ["o_orderstatus"])
    # a second write of one key leaves the others as they are
    changed = df.where("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    K.sink_partitioned(changed, path, ["o_orderstatus"])
    return t.spark.read.schema(df.schema).parquet(path)


@query(
    "publish_versioned",
    "SK6",
    """SELECT o_orderkey, o_totalprice, false AS first_reused, true AS second_reused FROM orders""",
)
def _(t):
    root = scratch_path(t.spark, "published")
    df = t.orders.select("o_orderkey", "o_totalprice")
    none = F.lit(None).cast("string")
    ids = F.array().cast("array<string>")
    run_hash = (
        t.spark.range(1)
        .select(run_fingerprint_of(F.lit("orders-v1"), none, ids, none).alias("h"))
        .first()["h"]
    )
    _, first = K.publish_versioned(df, root, "orders", run_hash)
    # the same address again: the stored dataset answers, the new input is not even read
    out, second = K.publish_versioned(df.where("false"), root, "orders", run_hash)
    return out.withColumns({"first_reused": F.lit(first), "second_reused": F.lit(second)})


@query(
    "task_action",
    "SK7",
    "SELECT status, sum(row_count)::BIGINT AS row_count FROM (SELECT 'ok' AS status, count(*) AS row_count FROM events) GROUP BY 1",
)
def _(t):
    def notify(pdf):
        if pdf["event_type"].isna().any():
            raise ValueError("event without type")

    audit = K.task_action(t.events.select("event_id", "event_type"), notify, "notify")
    return audit.groupBy("status").agg(F.sum("row_count").alias("row_count"))
