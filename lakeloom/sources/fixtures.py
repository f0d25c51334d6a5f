"""Views that give the test tables the shape of asset pipelines.

Each view exists twice: as a DataFrame (for the queries) and as SQL (for the
checks), under the same name.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.functions.scalars import fixed_units, hex_to_int, month_of

SQL_VIEWS = {
    "v_orders": """
        SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
               l_quantity AS quantity,
               round(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4)), 2) AS total,
               strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_completed": "SELECT * FROM v_orders WHERE status = 'F'",
    "v_branches": """
        SELECT event_type AS branch, event_id AS id, value / 1000 AS val FROM events""",
    "v_dims": """
        SELECT 'region' AS dim, r_regionkey::BIGINT AS id, r_name AS name, 0.0 AS score FROM region
        UNION ALL SELECT 'nation', n_nationkey, n_name, n_regionkey FROM nation
        UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier
        UNION ALL SELECT 'part', p_partkey, p_name, p_retailprice FROM part
        UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal FROM customer""",
    "v_regions": """
        SELECT c_name AS region, h % 10000 AS users, (h % 1000000) / 100.0 AS revenue
        FROM (SELECT c_name, ('0x' || substr(md5(c_name), 1, 8))::BIGINT AS h FROM customer)""",
    "v_tickers": """
        SELECT c_name AS ticker,
               ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 10000 / 100.0 AS price,
               ('0x' || substr(md5(c_name), 9, 8))::BIGINT % 1000000 AS volume
        FROM customer""",
    "v_edges": """
        SELECT (c_custkey - 1) // 2 AS upstream, c_custkey AS downstream,
               CASE WHEN c_custkey % 5 = 0 THEN 'ordering' ELSE 'data' END AS kind
        FROM customer WHERE c_custkey >= 1
        UNION ALL
        SELECT c_custkey // 3, c_custkey,
               CASE WHEN c_custkey % 5 = 0 THEN 'ordering' ELSE 'data' END
        FROM customer
        WHERE c_custkey >= 1 AND c_custkey % 3 = 0 AND c_custkey // 3 <> (c_custkey - 1) // 2""",
    "v_log": """
        SELECT event_id AS id, event_type AS base_id,
               event_type || '[user=' || (user_id % 16) || ']' AS node_id,
               md5(event_type || (user_id % 16) || (event_id % 50)) AS run_hash,
               event_id % 200 AS run_id, value / 100 AS elapsed_seconds,
               CASE WHEN event_id % 17 = 0 THEN 'failed' ELSE 'success' END AS status,
               1 + event_id % 3 AS attempts,
               CASE WHEN event_id % 17 = 0 THEN 'error ' || props END AS error_message,
               ts AS created_at
        FROM events""",
    "v_universe_old": """
        SELECT DISTINCT user_id AS user, props->>'$.k' AS k
        FROM events WHERE ts < TIMESTAMP '2024-01-16'""",
    "v_universe_new": """
        SELECT DISTINCT user_id AS user, props->>'$.k' AS k
        FROM events WHERE ts >= TIMESTAMP '2024-01-16'""",
    "v_src_old": """
        SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m') AS month
        FROM orders""",
    "v_src_new": """
        SELECT o_orderkey, o_custkey,
               o_totalprice + CASE WHEN month = '1996-03' THEN 1 ELSE 0 END AS o_totalprice, month
        FROM v_src_old WHERE month <> '1995-01'""",
}


# Schemas of tables already opened, so that later queries start no inference job.
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """The test tables of one scale factor, and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        path = f"{self.sf_dir}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    @property
    def v_orders(self) -> DataFrame:
        # price * (1 - discount) in units of 1e-8, rounded half up to cents
        product = fixed_units("l_extendedprice") * (10_000 - fixed_units("l_discount"))
        cents = F.call_function("div", product + 500_000, F.lit(1_000_000))
        lines = self.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            (cents.cast("decimal(14,0)") * F.lit(Decimal("0.01"))).alias("total"),
        )
        heads = self.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            month_of("o_orderdate").alias("month"),
            F.col("o_orderstatus").alias("status"),
        )
        return lines.join(heads, "order_id").select(
            "order_id", "customer_id", "product_id", "quantity", "total", "month", "status"
        )

    @property
    def v_completed(self) -> DataFrame:
        return self.v_orders.where(F.col("status") == "F")

    @property
    def v_customers(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("name"),
            F.upper("c_mktsegment").alias("tier"),
        )

    @property
    def v_products(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("cost"),
        )

    @property
    def v_shuttles(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("shuttle_id"),
            F.col("p_type").alias("shuttle_type"),
            (F.col("p_size") % 6 + 1).alias("num_engines"),
            F.col("p_size").alias("capacity"),
            (F.col("p_size") % 2 == 0).alias("d_check"),
            (F.col("p_retailprice") > 950).alias("moon_clearance"),
        )

    @property
    def v_companies(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("company_id"),
            F.col("s_name").alias("company_name"),
            F.col("s_acctbal").alias("rating"),
            (F.col("s_nationkey") + 1).alias("fleet"),
            (F.col("s_acctbal") > 0).alias("approved"),
        )

    @property
    def v_reviews(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_partkey").alias("shuttle_id"),
            F.col("l_suppkey").alias("company_id"),
            F.col("l_quantity").alias("score"),
            F.col("l_extendedprice").alias("price"),
        )

    @property
    def v_branches(self) -> DataFrame:
        return self.events.select(
            F.col("event_type").alias("branch"),
            F.col("event_id").alias("id"),
            (F.col("value") / 1000).alias("val"),
        )

    @property
    def v_numeric(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("price"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
        )

    @property
    def v_dims(self) -> dict[str, DataFrame]:
        def shape(df, key, name, score):
            return df.select(
                F.col(key).cast("bigint").alias("id"),
                F.col(name).alias("name"),
                score.cast("double").alias("score"),
            )

        return {
            "region": shape(self.region, "r_regionkey", "r_name", F.lit(0.0)),
            "nation": shape(self.nation, "n_nationkey", "n_name", F.col("n_regionkey")),
            "supplier": shape(self.supplier, "s_suppkey", "s_name", F.col("s_acctbal")),
            "part": shape(self.part, "p_partkey", "p_name", F.col("p_retailprice")),
            "customer": shape(self.customer, "c_custkey", "c_name", F.col("c_acctbal")),
        }

    @property
    def v_regions(self) -> DataFrame:
        h = hex_to_int(F.substring(F.md5("c_name"), 1, 8))
        return self.customer.select(
            F.col("c_name").alias("region"),
            (h % 10000).alias("users"),
            ((h % 1000000) / 100.0).alias("revenue"),
        )

    @property
    def v_tickers(self) -> DataFrame:
        digest = F.md5("c_name")
        return self.customer.select(
            F.col("c_name").alias("ticker"),
            (hex_to_int(F.substring(digest, 1, 8)) % 10000 / 100.0).alias("price"),
            (hex_to_int(F.substring(digest, 9, 8)) % 1000000).alias("volume"),
        )

    @property
    def v_edges(self) -> DataFrame:
        """Customer tree with a second parent for every third node."""
        key = F.col("c_custkey")
        half = F.floor((key - 1) / 2).cast("bigint")
        third = F.floor(key / 3).cast("bigint")
        parents = F.array_distinct(
            F.filter(
                F.array(half, F.when(key % 3 == 0, third)), lambda p: p.isNotNull()
            )
        )
        return self.customer.where(key >= 1).select(
            F.explode(parents).alias("upstream"),
            key.alias("downstream"),
            F.when(key % 5 == 0, "ordering").otherwise("data").alias("kind"),
        )

    @property
    def v_log(self) -> DataFrame:
        shard = (F.col("user_id") % 16).cast("string")
        failed = F.col("event_id") % 17 == 0
        return self.events.select(
            F.col("event_id").alias("id"),
            F.col("event_type").alias("base_id"),
            F.concat("event_type", F.lit("[user="), shard, F.lit("]")).alias("node_id"),
            F.md5(
                F.concat("event_type", shard, (F.col("event_id") % 50).cast("string"))
            ).alias("run_hash"),
            (F.col("event_id") % 200).alias("run_id"),
            (F.col("value") / 100).alias("elapsed_seconds"),
            F.when(failed, "failed").otherwise("success").alias("status"),
            (1 + F.col("event_id") % 3).alias("attempts"),
            F.when(failed, F.concat(F.lit("error "), "props")).alias("error_message"),
            F.col("ts").alias("created_at"),
        )

    def _universe(self, condition) -> DataFrame:
        return (
            self.events.where(condition)
            .select(
                F.col("user_id").alias("user"),
                F.get_json_object("props", "$.k").alias("k"),
            )
            .distinct()
        )

    @property
    def v_universe_old(self) -> DataFrame:
        return self._universe(F.expr("ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"))

    @property
    def v_universe_new(self) -> DataFrame:
        return self._universe(F.expr("ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'"))

    @property
    def v_src_old(self) -> DataFrame:
        return self.orders.select(
            "o_orderkey", "o_custkey", "o_totalprice", month_of("o_orderdate").alias("month")
        )

    @property
    def v_src_new(self) -> DataFrame:
        bump = F.when(F.col("month") == "1996-03", F.lit(1.0)).otherwise(F.lit(0.0))
        return self.v_src_old.where(F.col("month") != "1995-01").withColumn(
            "o_totalprice", F.col("o_totalprice") + bump
        )
