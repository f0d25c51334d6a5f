"""Filters, projections, joins, aggregates, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalars import hex_to_int, money
from lakeloom.operators import aggregates as A
from lakeloom.operators import joins as J
from lakeloom.operators import ml as M
from lakeloom.operators import sets as U
from lakeloom.operators import topk as T
from lakeloom.operators import transforms as P
from lakeloom.plans.registry import query


def sql_mean(column: str, digits: int) -> str:
    """Mean of a four-decimal column rounded half up in integer arithmetic."""
    total, unit = f"sum(({column}::DECIMAL(18,4) * 10000)::BIGINT)", 10 ** (4 - digits)
    return f"((2 * {total} + {unit} * count(*)) // (2 * {unit} * count(*)))::DOUBLE / {10**digits}"


def dbl(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- filters and projections -------------------------------------------------


@query(
    "filter_equals",
    "P1",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    df = P.filter_equals(t.orders, "o_orderstatus", "F")
    return df.select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_threshold", "P2", "SELECT event_id, value FROM events WHERE value > 50")
def _(t):
    return P.filter_threshold(t.events, "value", 50.0).select("event_id", "value")


@query(
    "filter_all_true",
    "P3",
    """SELECT p_partkey AS shuttle_id, p_size % 6 + 1 AS num_engines FROM part
       WHERE p_size % 2 = 0 AND p_retailprice > 950""",
)
def _(t):
    df = P.filter_all_true(t.v_shuttles, ["d_check", "moon_clearance"])
    return df.select("shuttle_id", "num_engines")


NUMERIC = ["quantity", "price", "discount", "tax"]

SQL_NORMALIZED = """
    b AS (SELECT min(l_quantity) q0, max(l_quantity) q1, min(l_extendedprice) p0,
                 max(l_extendedprice) p1, min(l_discount) d0, max(l_discount) d1,
                 min(l_tax) t0, max(l_tax) t1 FROM lineitem),
    z AS (SELECT l_orderkey,
                 CASE WHEN q1 > q0 THEN (l_quantity - q0) / (q1 - q0) ELSE 0 END AS quantity,
                 CASE WHEN p1 > p0 THEN (l_extendedprice - p0) / (p1 - p0) ELSE 0 END AS price,
                 CASE WHEN d1 > d0 THEN (l_discount - d0) / (d1 - d0) ELSE 0 END AS discount,
                 CASE WHEN t1 > t0 THEN (l_tax - t0) / (t1 - t0) ELSE 0 END AS tax
          FROM lineitem, b)"""


@query(
    "filter_all_le",
    "P4",
    f"""WITH {SQL_NORMALIZED}
        SELECT round(quantity, 6) AS quantity, round(price, 6) AS price,
               round(discount, 6) AS discount, round(tax, 6) AS tax
        FROM z WHERE quantity <= 0.95 AND price <= 0.95 AND discount <= 0.95 AND tax <= 0.95""",
)
def _(t):
    kept = P.filter_all_le(A.minmax_normalize(t.v_numeric, NUMERIC), NUMERIC, 0.95)
    return kept.select(*[F.round(c, 6).alias(c) for c in NUMERIC])


@query(
    "filter_removed_count",
    "P4",
    f"""WITH {SQL_NORMALIZED}, k AS (
          SELECT quantity <= 0.95 AND price <= 0.95 AND discount <= 0.95 AND tax <= 0.95 AS keep
          FROM z)
        SELECT count(*) FILTER (WHERE keep) AS kept, count(*) FILTER (WHERE NOT keep) AS removed
        FROM k""",
)
def _(t):
    return P.removed_count(A.minmax_normalize(t.v_numeric, NUMERIC), NUMERIC, 0.95)


@query(
    "project_columns",
    "P5",
    "SELECT l_extendedprice, l_orderkey, l_quantity FROM lineitem",
)
def _(t):
    return P.project_columns(t.lineitem, ["l_extendedprice", "l_orderkey", "l_quantity"])


@query(
    "derive_total",
    "P6",
    """SELECT l_orderkey, strftime(o_orderdate, '%Y-%m') AS month,
              round(l_quantity::DECIMAL(18,4) * l_extendedprice::DECIMAL(18,4), 2)::DOUBLE AS total
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice")
    heads = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    df = P.derive_total(
        lines.join(heads, "l_orderkey"), "l_quantity", "l_extendedprice", "o_orderdate"
    )
    return dbl(df.select("l_orderkey", "month", "total"), "total")


@query(
    "derive_margin",
    "P7",
    """SELECT p_partkey, round(p_retailprice::DECIMAL(18,4) * 0.3::DECIMAL(18,4), 2)::DOUBLE AS margin
       FROM part""",
)
def _(t):
    return dbl(P.derive_margin(t.part, "p_retailprice").select("p_partkey", "margin"), "margin")


@query(
    "derive_features",
    "P8",
    """SELECT l_orderkey, round(l_quantity * l_extendedprice, 4) AS qp_product,
              round(l_discount + l_tax, 6) AS dt_sum,
              round((l_quantity + l_discount + l_tax) / 3, 6) AS qdt_mean FROM lineitem""",
)
def _(t):
    df = P.derive_features(
        t.lineitem,
        {"qp_product": ["l_quantity", "l_extendedprice"]},
        {"dt_sum": ["l_discount", "l_tax"]},
        {"qdt_mean": ["l_quantity", "l_discount", "l_tax"]},
    )
    return df.select(
        "l_orderkey",
        F.round("qp_product", 4).alias("qp_product"),
        F.round("dt_sum", 6).alias("dt_sum"),
        F.round("qdt_mean", 6).alias("qdt_mean"),
    )


@query(
    "encode_categories",
    "P9",
    """SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2
              WHEN 'PROMO' THEN 3 ELSE 0 END AS code FROM part""",
)
def _(t):
    codes = {"ECONOMY": 1, "STANDARD": 2, "PROMO": 3}
    return P.encode_categories(t.part, "p_type", codes, "code").select("p_partkey", "code")


@query(
    "encode_categories_table",
    "P9",
    """WITH r AS (SELECT p_type, CAST(count(*) AS BIGINT) AS code FROM part GROUP BY p_type
                  HAVING avg(p_size) > 25)
       SELECT p_partkey, coalesce(code, 0) AS code FROM part LEFT JOIN r USING (p_type)""",
)
def _(t):
    codes = (
        t.part.groupBy(F.col("p_type").alias("category"))
        .agg(F.count(F.lit(1)).alias("code"), F.avg("p_size").alias("s"))
        .where("s > 25")
    )
    return P.encode_categories(t.part, "p_type", codes, "code").select("p_partkey", "code")


@query(
    "add_constant",
    "P10",
    "SELECT c_custkey, true AS enriched, 'v1' AS version FROM customer",
)
def _(t):
    return P.add_constant(t.customer.select("c_custkey"), enriched=True, version="v1")


@query(
    "above_threshold",
    "P11",
    "SELECT c_custkey, c_acctbal > 0.5 AS above, 0.5::DOUBLE AS threshold FROM customer",
)
def _(t):
    return P.above_threshold(t.customer, "c_acctbal", 0.5).select("c_custkey", "above", "threshold")


@query(
    "assert_nonempty",
    "P12",
    """SELECT 'nonempty' AS check_name, count(*) > 0 AS passed,
              (CASE WHEN count(*) > 0 THEN 0 ELSE 1 END)::BIGINT AS violations, count(*) AS observed
       FROM events
       UNION ALL
       SELECT 'value_positive', count(*) FILTER (WHERE NOT coalesce(value > 0.5, false)) = 0,
              count(*) FILTER (WHERE NOT coalesce(value > 0.5, false)), count(*) FROM events
       UNION ALL
       SELECT 'has_type', count(*) FILTER (WHERE event_type IS NULL) = 0,
              count(*) FILTER (WHERE event_type IS NULL), count(*) FROM events""",
)
def _(t):
    checks = {"value_positive": F.col("value") > 0.5, "has_type": F.col("event_type").isNotNull()}
    return P.expectations(t.events, checks)


# --- joins -------------------------------------------------------------------


@query(
    "left_join_default",
    "J1",
    """WITH a AS (SELECT customer_id, count(*) AS order_count FROM v_orders GROUP BY 1),
            d AS (SELECT c_custkey, upper(c_mktsegment) AS tier FROM customer WHERE c_acctbal > 0)
       SELECT customer_id, order_count, coalesce(tier, 'UNKNOWN') AS tier
       FROM a LEFT JOIN d ON customer_id = c_custkey""",
)
def _(t):
    counts = t.v_orders.groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"))
    dim = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("customer_id"), F.upper("c_mktsegment").alias("tier")
    )
    return J.left_join_default(counts, dim, "customer_id", "tier", "UNKNOWN")


SQL_MASTER = f"""
    r AS (SELECT l_partkey AS shuttle_id, l_suppkey AS company_id,
                 {sql_mean('l_quantity', 4)} AS mean_score,
                 {sql_mean('l_extendedprice', 2)} AS mean_price
          FROM lineitem GROUP BY 1, 2),
    s AS (SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2
                 WHEN 'PROMO' THEN 3 ELSE 0 END AS type_code,
                 p_size % 6 + 1 AS num_engines, p_size AS capacity
          FROM part WHERE p_size % 2 = 0 AND p_retailprice > 950),
    c AS (SELECT s_suppkey, round(s_acctbal / (SELECT max(s_acctbal) FROM supplier), 4) AS rating_norm,
                 s_nationkey + 1 AS fleet FROM supplier WHERE s_acctbal > 0)"""


def master_table(t):
    """Feature vectors and targets of the reviews that match both dimensions."""
    reviews = A.pair_means(
        t.v_reviews,
        ["shuttle_id", "company_id"],
        {"mean_score": ("score", 4), "mean_price": ("price", 2)},
    )
    shuttles = P.encode_categories(
        P.filter_all_true(t.v_shuttles, ["d_check", "moon_clearance"]),
        "shuttle_type",
        {"ECONOMY": 1, "STANDARD": 2, "PROMO": 3},
        "type_code",
    ).select("shuttle_id", "type_code", "num_engines", "capacity")
    companies = A.max_scale(
        t.v_companies, "rating", F.col("approved"), "rating_norm", filter_first=False
    ).select("company_id", "rating_norm", "fleet")
    return J.inner_star_join(
        reviews,
        {"shuttle_id": shuttles, "company_id": companies},
        FEATURES,
        "mean_price",
        keep=["shuttle_id", "company_id"],
    )


FEATURES = ["type_code", "num_engines", "capacity", "rating_norm", "fleet", "mean_score"]


@query(
    "inner_star_join",
    "J2",
    f"""WITH {SQL_MASTER}
        SELECT shuttle_id, company_id, type_code::DOUBLE AS f0, num_engines::DOUBLE AS f1,
               capacity::DOUBLE AS f2, rating_norm AS f3, fleet::DOUBLE AS f4, mean_score AS f5,
               mean_price AS target
        FROM r JOIN s ON shuttle_id = p_partkey JOIN c ON company_id = s_suppkey""",
)
def _(t):
    m = master_table(t)
    return m.select(
        "shuttle_id",
        "company_id",
        *[F.col("features")[i].alias(f"f{i}") for i in range(len(FEATURES))],
        "target",
    )


@query(
    "aligned_join",
    "J3",
    """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
            m AS (SELECT user_id, event_type, max(value) AS top FROM events GROUP BY 1, 2)
       SELECT user_id, event_type, n, top FROM e JOIN m USING (user_id, event_type)""",
)
def _(t):
    keys = ["user_id", "event_type"]
    fetched = t.events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    enriched = t.events.groupBy(*keys).agg(F.max("value").alias("top"))
    return J.aligned_join(fetched, enriched, keys)


@query(
    "broadcast_input",
    "J4",
    """SELECT c_custkey, first_price, last_price FROM customer,
       (SELECT min(o_totalprice) AS first_price, max(o_totalprice) AS last_price FROM orders)""",
)
def _(t):
    config = t.orders.agg(
        F.min("o_totalprice").alias("first_price"), F.max("o_totalprice").alias("last_price")
    )
    return J.broadcast_input(t.customer.select("c_custkey"), config)


@query(
    "scalar_feedback",
    "J5",
    """SELECT c_custkey, round(
         (SELECT sum(c_acctbal::DECIMAL(18,4))::DOUBLE FROM customer) * cos(c_custkey * 0.2), 0)
         AS value FROM customer""",
)
def _(t):
    layer = t.customer.agg(F.sum(money("c_acctbal")).cast("double"))
    out = J.scalar_feedback(
        t.customer.select("c_custkey"), layer, "value", lambda s: s * F.cos(F.col("c_custkey") * 0.2)
    )
    return out.select("c_custkey", F.round("value", 0).alias("value"))


SQL_STEPS = """
    s AS (SELECT DISTINCT event_type || '[user=' || (user_id % 16) || ']' AS node_id,
                 md5(event_type || (user_id % 16) || ((event_id + 7 * user_id) % 90)) AS run_hash
          FROM events)"""


def wanted_steps(t):
    """Steps a new run asks for; some of their run hashes are in the log, some are not."""
    shard = (F.col("user_id") % 16).cast("string")
    turn = ((F.col("event_id") + 7 * F.col("user_id")) % 90).cast("string")
    return t.events.select(
        F.concat("event_type", F.lit("[user="), shard, F.lit("]")).alias("node_id"),
        F.md5(F.concat("event_type", shard, turn)).alias("run_hash"),
    ).distinct()


@query(
    "semi_join_hits",
    "J6",
    f"""WITH {SQL_STEPS} SELECT node_id, run_hash FROM s WHERE EXISTS
        (SELECT 1 FROM v_log l WHERE l.node_id = s.node_id AND l.run_hash = s.run_hash
         AND l.status = 'success')""",
)
def _(t):
    return J.semi_join_hits(wanted_steps(t), t.v_log)


@query(
    "anti_join_misses",
    "J7",
    f"""WITH {SQL_STEPS} SELECT node_id, run_hash FROM s WHERE NOT EXISTS
        (SELECT 1 FROM v_log l WHERE l.node_id = s.node_id AND l.run_hash = s.run_hash
         AND l.status = 'success')""",
)
def _(t):
    return J.anti_join_misses(wanted_steps(t), t.v_log)


@query(
    "semi_join_repeated",
    "J8",
    """SELECT id, node_id, run_hash FROM v_log
       QUALIFY count(*) OVER (PARTITION BY node_id, run_hash) > 1""",
)
def _(t):
    return J.semi_join_repeated(t.v_log).select("id", "node_id", "run_hash")


@query(
    "range_join_ticks",
    "J9",
    """WITH s AS (SELECT event_type, max(ts) AS last_fired_at FROM events
                  WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
       SELECT event_id, event_type AS schedule_id FROM events JOIN s USING (event_type)
       WHERE ts > last_fired_at AND ts <= TIMESTAMP '2024-01-27'""",
)
def _(t):
    state = (
        t.events.where(F.expr("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
        .groupBy(F.col("event_type").alias("schedule_id"))
        .agg(F.max("ts").alias("last_fired_at"))
    )
    ticks = t.events.select(
        F.col("event_type").alias("schedule_id"), F.col("ts").alias("tick_at"), "event_id"
    )
    now = F.expr("TIMESTAMP_NTZ '2024-01-27 00:00:00'")
    return J.range_join_ticks(state, ticks, now).select("event_id", "schedule_id")


# --- aggregates --------------------------------------------------------------


@query(
    "monthly_metrics",
    "A1",
    """SELECT month, count(*) AS order_count, round(sum(total), 2)::DOUBLE AS revenue,
              round(sum(total) / count(*), 2)::DOUBLE AS avg_order_value
       FROM v_completed GROUP BY month ORDER BY month""",
)
def _(t):
    return dbl(A.monthly_metrics(t.v_completed), "revenue", "avg_order_value")


SQL_LIFETIME = """
    SELECT customer_id, coalesce(upper(c_mktsegment), 'UNKNOWN') AS tier, order_count, lifetime_value
    FROM (SELECT customer_id, count(*) AS order_count,
                 round(sum(total), 2)::DOUBLE AS lifetime_value
          FROM v_completed GROUP BY customer_id) LEFT JOIN customer ON customer_id = c_custkey"""


@query("customer_lifetime", "A2", SQL_LIFETIME)
def _(t):
    return dbl(A.customer_lifetime(t.v_completed, t.v_customers), "lifetime_value")


@query(
    "product_sales",
    "A3",
    """SELECT product_id, coalesce(p_type, 'unknown') AS category, units_sold, revenue
       FROM (SELECT product_id, sum(quantity) AS units_sold,
                    round(sum(total), 2)::DOUBLE AS revenue
             FROM v_completed GROUP BY product_id) LEFT JOIN part ON product_id = p_partkey""",
)
def _(t):
    return dbl(A.product_sales(t.v_completed, t.v_products), "revenue")


@query(
    "mart_summary",
    "A4",
    """SELECT count(DISTINCT customer_id) AS customer_count, count(DISTINCT month) AS months_tracked,
              count(DISTINCT product_id) AS product_count,
              round(coalesce(sum(total), 0), 2)::DOUBLE AS total_revenue,
              round(coalesce(sum(total), 0) / greatest(count(DISTINCT month), 1), 2)::DOUBLE
                AS avg_revenue_per_month,
              (SELECT coalesce(max(v), 0)::DOUBLE FROM
                 (SELECT sum(total) AS v FROM v_completed GROUP BY customer_id)) AS top_customer_ltv
       FROM v_completed""",
)
def mart_summary(t):
    return dbl(
        A.mart_summary(t.v_completed),
        "total_revenue",
        "avg_revenue_per_month",
        "top_customer_ltv",
    )


@query(
    "pair_means",
    "A5",
    f"""SELECT l_partkey AS shuttle_id, l_suppkey AS company_id,
              {sql_mean('l_quantity', 4)} AS mean_score,
              {sql_mean('l_extendedprice', 2)} AS mean_price
       FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    df = A.pair_means(
        t.v_reviews,
        ["shuttle_id", "company_id"],
        {"mean_score": ("score", 4), "mean_price": ("price", 2)},
    )
    return dbl(df, "mean_score", "mean_price")


@query(
    "type_counts",
    "A6",
    "SELECT event_type, count(*) AS count FROM events GROUP BY event_type",
)
def _(t):
    return A.type_counts(t.events, "event_type")


@query(
    "share_of_total",
    "A7",
    """WITH c AS (SELECT event_type, count(*) AS count FROM events GROUP BY 1)
       SELECT event_type, count, round(count::DECIMAL(20,0) / (SELECT sum(count) FROM c), 4)::DOUBLE
                AS rate, (SELECT sum(count) FROM c)::BIGINT AS total FROM c""",
)
def _(t):
    return dbl(A.share_of_total(A.type_counts(t.events, "event_type")), "rate")


@query(
    "column_profile",
    "A8",
    """SELECT c AS column_name, round(m, 6) AS mean, lo AS min, hi AS max, n AS row_count FROM (
         SELECT 'quantity' AS c, avg(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi,
                count(*) AS n FROM lineitem
         UNION ALL SELECT 'price', avg(l_extendedprice), min(l_extendedprice),
                max(l_extendedprice), count(*) FROM lineitem
         UNION ALL SELECT 'discount', avg(l_discount), min(l_discount), max(l_discount), count(*)
                FROM lineitem
         UNION ALL SELECT 'tax', avg(l_tax), min(l_tax), max(l_tax), count(*) FROM lineitem)""",
)
def _(t):
    return A.column_profile(t.v_numeric, NUMERIC).withColumn("mean", F.round("mean", 6))


@query(
    "dimension_rollup",
    "A9",
    """SELECT dim, count(*) AS dimension_rows, sum(score::DECIMAL(18,4))::DOUBLE AS score
       FROM v_dims GROUP BY dim""",
)
def _(t):
    return dbl(A.dimension_rollup(t.v_dims), "score")


@query(
    "collect_totals",
    "A10",
    """SELECT count(*) AS regions, sum(users)::BIGINT AS total_users,
              round(sum(revenue::DECIMAL(18,4)), 2)::DOUBLE AS total_revenue FROM v_regions""",
)
def _(t):
    return dbl(A.collect_totals(t.v_regions), "total_revenue")


@query(
    "distinct_count",
    "A11",
    """SELECT count(h) AS total_hashes, count(DISTINCT h) AS unique
       FROM (SELECT substr(md5(o_custkey::VARCHAR), 1, 16) AS h FROM orders)""",
)
def _(t):
    df = t.orders.select(F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 16).alias("h"))
    return A.distinct_count(df, "h")


SQL_DIAMOND = """
    k AS (SELECT branch, id, val FROM v_branches WHERE val > 0.02),
    f AS (SELECT branch, id, pow(val / max(val) OVER (PARTITION BY branch), 2) AS f,
                 substr(md5(id::VARCHAR), 1, 8) AS h FROM k)"""


def diamond_features(t):
    """Prepared branches: filtered, divided by the branch maximum, squared and hashed.

    One scan serves every branch; the branch maxima come from a partial
    aggregate that is joined back.
    """
    kept = P.filter_threshold(t.v_branches, "val", 0.02)
    tops = kept.groupBy("branch").agg(F.max("val").alias("top"))
    scaled = kept.join(tops, "branch").withColumn("val", F.col("val") / F.col("top"))
    return scaled.select(
        "branch",
        "id",
        F.pow("val", F.lit(2)).alias("f"),
        F.substring(F.md5(F.col("id").cast("string")), 1, 8).alias("h"),
    )


@query(
    "top_n_average",
    "A12",
    f"""WITH {SQL_DIAMOND}, p AS (SELECT f FROM f ORDER BY f DESC, id LIMIT 100)
        SELECT round(avg(f), 6) AS avg_top_feature, count(*) AS top_count,
               (SELECT count(*) FROM f) AS total_rows FROM p""",
)
def _(t):
    return A.top_n_average(diamond_features(t), "f", ["id"], 100)


@query(
    "ticker_rollup",
    "A13",
    """SELECT count(*) AS tickers,
              round(sum(price::DECIMAL(18,4) / 100) / count(*), 4)::DOUBLE AS avg_price,
              round(sum(volume::DECIMAL(18,0) / 1000000), 4)::DOUBLE AS total_volume
       FROM v_tickers""",
)
def _(t):
    return dbl(A.ticker_rollup(t.v_tickers), "avg_price", "total_volume")


@query(
    "layer_sum",
    "A14",
    """SELECT round(sum(sin(c_custkey * 0.3) * 100), 4) AS sum, count(*) AS count FROM customer""",
)
def _(t):
    layer = t.customer.select((F.sin(F.col("c_custkey") * 0.3) * 100).alias("value"))
    return A.layer_sum(layer, "value")


@query(
    "layered_feedback",
    "A14",
    """WITH a AS (SELECT sum(sin(c_custkey * 0.3) * 100) AS s FROM customer),
            b AS (SELECT sum((SELECT s FROM a) * cos(c_custkey * 0.2)) AS s FROM customer),
            c AS (SELECT sum((SELECT s FROM b) * sin(c_custkey * 0.1)) AS s FROM customer)
       SELECT round((SELECT s FROM a), 4) AS layer0, round((SELECT s FROM b), 4) AS layer1,
              round((SELECT s FROM c), 4) AS layer2""",
)
def _(t):
    ids = t.customer.select("c_custkey")
    total = ids.agg(F.sum(F.sin(F.col("c_custkey") * 0.3) * 100).alias("layer0"))
    for i, (fn, step) in enumerate([(F.cos, 0.2), (F.sin, 0.1)], start=1):
        wave = fn(F.col("c_custkey") * step)
        # the scalar is constant over the layer, so it is multiplied in once, after the sum
        total = J.broadcast_input(ids.agg(F.sum(wave).alias("w")), total).select(
            *[f"layer{k}" for k in range(i)], (F.col("w") * F.col(f"layer{i - 1}")).alias(f"layer{i}")
        )
    return total.select(*[F.round(c, 4).alias(c) for c in total.columns])


@query(
    "minmax_normalize",
    "A15",
    f"""WITH {SQL_NORMALIZED} SELECT l_orderkey, round(quantity, 6) AS quantity,
        round(price, 6) AS price FROM z""",
)
def _(t):
    df = A.minmax_normalize(
        t.lineitem.select(
            "l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")
        ),
        ["quantity", "price"],
    )
    return df.select(
        "l_orderkey", F.round("quantity", 6).alias("quantity"), F.round("price", 6).alias("price")
    )


@query(
    "max_scale_all_rows",
    "A16",
    """SELECT s_suppkey AS company_id,
              round(s_acctbal / (SELECT max(s_acctbal) FROM supplier), 4) AS rating_norm
       FROM supplier WHERE s_acctbal > 0""",
)
def _(t):
    df = A.max_scale(t.v_companies, "rating", F.col("approved"), "rating_norm", filter_first=False)
    return df.select("company_id", "rating_norm")


@query(
    "max_scale_after_filter",
    "A16",
    """SELECT event_id, round(value / (SELECT max(value) FROM events WHERE event_type <> 'error'), 4)
         AS scaled FROM events WHERE event_type <> 'error'""",
)
def _(t):
    df = A.max_scale(
        t.events, "value", F.col("event_type") != "error", "scaled", filter_first=True
    )
    return df.select("event_id", "scaled")


@query(
    "ordered_digest",
    "A17",
    """WITH l1 AS (SELECT o_orderkey // 65536 AS i, sha256(string_agg(h, '' ORDER BY o_orderkey)) AS h
                   FROM (SELECT o_orderkey, sha256(o_orderkey::VARCHAR) AS h FROM orders) GROUP BY 1),
            l2 AS (SELECT i // 65536 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l1 GROUP BY 1),
            l3 AS (SELECT i // 65536 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l2 GROUP BY 1)
       SELECT (SELECT count(*) FROM orders) AS count, sha256(string_agg(h, '' ORDER BY i))
         AS combined_hash FROM l3""",
)
def _(t):
    items = t.orders.select(
        "o_orderkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h")
    )
    return A.ordered_digest(items, "o_orderkey", "h")


@query(
    "region_scores",
    "P10",
    """SELECT region, users, revenue, true AS enriched, round(users * revenue, 4) AS score
       FROM v_regions""",
)
def _(t):
    df = P.add_constant(t.v_regions, enriched=True)
    return df.withColumn("score", F.round(F.col("users") * F.col("revenue"), 4))


# --- order, limit, sets ------------------------------------------------------


@query(
    "top_customers",
    "T1",
    f"SELECT * FROM ({SQL_LIFETIME}) ORDER BY lifetime_value DESC, customer_id LIMIT 10",
)
def _(t):
    top = T.top_customers(A.customer_lifetime(t.v_completed, t.v_customers), 10)
    return dbl(top, "lifetime_value")


@query(
    "top_features",
    "T2",
    f"""WITH {SQL_DIAMOND} SELECT branch, id, round(f, 9) AS f, h FROM f
        ORDER BY f DESC, id LIMIT 100""",
)
def _(t):
    return T.top_features(diamond_features(t), 100).withColumn("f", F.round("f", 9))


@query(
    "sorted_report",
    "T3",
    """SELECT user_id, event_type, count(*) AS count FROM events GROUP BY 1, 2
       ORDER BY user_id, event_type""",
)
def _(t):
    counts = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("count"))
    return T.sorted_report(counts, "user_id")


@query(
    "union_branches",
    "U1",
    """SELECT branch, count(*) AS rows, round(sum(val::DECIMAL(18,8)), 6)::DOUBLE AS total FROM (
         SELECT 'orders' AS branch, o_totalprice / 1000 AS val FROM orders
         UNION ALL SELECT 'events', value / 1000 FROM events
         UNION ALL SELECT 'lines', l_extendedprice / 1000 FROM lineitem) GROUP BY branch""",
)
def _(t):
    merged = U.union_branches(
        {
            "orders": t.orders.select((F.col("o_totalprice") / 1000).alias("val")),
            "events": t.events.select((F.col("value") / 1000).alias("val")),
            "lines": t.lineitem.select((F.col("l_extendedprice") / 1000).alias("val")),
        }
    )
    return merged.groupBy("branch").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.sum(F.col("val").cast("decimal(18,8)")), 6).cast("double").alias("total"),
    )


@query(
    "merged_features",
    "U1",
    f"WITH {SQL_DIAMOND} SELECT branch, id, round(f, 9) AS f, h FROM f",
)
def _(t):
    return diamond_features(t).withColumn("f", F.round("f", 9))


@query(
    "universe_diff",
    "U2",
    """SELECT coalesce(o.user, n.user) AS user, coalesce(o.k, n.k) AS k,
              CASE WHEN o.user IS NULL THEN 'new' WHEN n.user IS NULL THEN 'removed'
                   ELSE 'retained' END AS state
       FROM v_universe_old o FULL JOIN v_universe_new n ON o.user = n.user AND o.k = n.k""",
)
def _(t):
    return U.universe_diff(t.v_universe_old, t.v_universe_new, ["user", "k"])


@query(
    "merge_logs",
    "U3",
    "SELECT id, node_id, run_hash, status FROM v_log",
)
def _(t):
    columns = ["id", "node_id", "run_hash", "status"]
    early = t.v_log.where(F.expr("created_at < TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    late = t.v_log.where(F.expr("created_at >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"))
    return U.merge_logs(early.select(columns), late.select(columns))


# --- model evaluation --------------------------------------------------------


@query(
    "regression_metrics",
    "M4",
    """WITH p AS (SELECT l_extendedprice AS y, l_quantity * (SELECT sum(l_extendedprice) /
                    sum(l_quantity) FROM lineitem) AS yhat, l_returnflag FROM lineitem)
       SELECT l_returnflag, count(*) AS n,
              round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 4) AS r2,
              round(avg(abs(y - yhat)), 2) AS mae,
              round(sqrt(sum((y - yhat) * (y - yhat)) / count(*)), 2) AS rmse
       FROM p GROUP BY l_returnflag""",
)
def _(t):
    rate = t.lineitem.agg(F.sum("l_extendedprice") / F.sum("l_quantity")).scalar()
    df = t.lineitem.select(
        "l_returnflag",
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * rate).alias("yhat"),
    )
    return M.regression_metrics(df, "y", "yhat", by=["l_returnflag"])


@query(
    "classification_report",
    "M5",
    """WITH p AS (SELECT o_orderstatus AS y,
              CASE ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 4
                WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE o_orderstatus END AS yhat FROM orders),
       k AS (SELECT y AS label FROM p UNION SELECT yhat FROM p),
       c AS (SELECT label, (SELECT count(*) FROM p WHERE y = label) AS support,
               (SELECT count(*) FROM p WHERE yhat = label) AS predicted,
               (SELECT count(*) FROM p WHERE y = label AND yhat = label) AS hits FROM k),
       q AS (SELECT label, support, hits,
               CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS precision,
               CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM c),
       m AS (SELECT *, CASE WHEN precision + recall > 0
               THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM q),
       w AS (SELECT label, precision, recall, f1, support FROM m
       UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support),
         sum(hits) / sum(support), sum(support) FROM m
       UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
       UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
         sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
       SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall,
              round(f1, 6) AS f1, support::BIGINT AS support FROM w""",
)
def _(t):
    turn = hex_to_int(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8)) % 4
    guess = F.when(turn == 0, "F").when(turn == 1, "O").otherwise(F.col("o_orderstatus"))
    df = M.classification_report(
        t.orders.select(F.col("o_orderstatus").alias("y"), guess.alias("yhat")), "y", "yhat"
    )
    return df.select(
        "label", *[F.round(m, 6).alias(m) for m in ("precision", "recall", "f1")], "support"
    )
