"""Fingerprints, cache lookup and incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions.scalars import fixed_units
from lakeloom.operators import incremental as I
from lakeloom.operators import lineage as L
from lakeloom.operators import manifest as M
from lakeloom.operators import ordered as W
from lakeloom.operators.partitions import key_suffix
from lakeloom.plans.registry import query
from lakeloom.plans.relational import SQL_STEPS, wanted_steps
from lakeloom.session import scratch_path
from lakeloom.sources.commits import remove_path
from lakeloom.sources.sinks import sink_partitioned

SQL_DEFINITION = (
    "sha256('definition:1.0.0' || chr(10) || 'def ' || c_name || '(): pass' || chr(10) || "
    "c_mktsegment || chr(10) || '{\"kind\":\"asset\"}')"
)


def catalog(t):
    """Customers as a catalog of definitions."""
    return t.customer.select(
        "c_custkey",
        I.definition_fingerprint(
            F.concat(F.lit("def "), "c_name", F.lit("(): pass")),
            F.col("c_mktsegment"),
            F.lit('{"kind":"asset"}'),
        ).alias("definition_hash"),
    )


@query(
    "definition_fingerprint",
    "I1",
    f"SELECT c_custkey, {SQL_DEFINITION} AS definition_hash FROM customer",
)
def _(t):
    return catalog(t)


@query(
    "partition_source_fingerprint",
    "I2",
    """SELECT user_id, sha256('partition_source:1.0.0' || chr(10) || '["' ||
              string_agg(DISTINCT event_type, '","' ORDER BY event_type) || '"]') AS source_hash
       FROM events GROUP BY user_id""",
)
def _(t):
    # the values are event types, few however many events a user has
    values = F.to_json(F.sort_array(F.collect_set("event_type")))
    return t.events.groupBy("user_id").agg(
        I.partition_source_fingerprint(values).alias("source_hash")
    )


SQL_RUN_HASH = """
    d AS (SELECT o_orderkey, sha256('definition:1.0.0' || chr(10) || o_orderpriority || chr(10) ||
              chr(10) || '{}') AS definition_hash FROM orders),
    u AS (SELECT l_orderkey, count(*) AS n_upstream,
              'upstream:' || sha256(count(*) || '-' || sum(a) || '-' || sum(b) || '-' || sum(c)
                                    || '-' || sum(d)) || chr(10) AS lines
          FROM (SELECT l_orderkey, ('0x' || h[1:15])::BIGINT AS a, ('0x' || h[16:30])::BIGINT AS b,
                       ('0x' || h[31:45])::BIGINT AS c, ('0x' || h[46:60])::BIGINT AS d
                FROM (SELECT l_orderkey, sha256(md5(l_partkey || ':' || l_suppkey)) AS h FROM lineitem))
          GROUP BY 1)"""


@query(
    "run_fingerprint",
    "I2",
    f"""WITH {SQL_RUN_HASH}
        SELECT o_orderkey::VARCHAR AS step, coalesce(n_upstream, 0) AS n_upstream,
          sha256('run:1.0.0' || chr(10) || definition_hash || chr(10) ||
                 'partition:order=' || o_orderkey || chr(10) || coalesce(lines, '') ||
                 'params:' || 'full' || chr(10)) AS run_hash
        FROM d LEFT JOIN u ON o_orderkey = l_orderkey""",
)
def _(t):
    steps = t.orders.select(
        F.col("o_orderkey").cast("string").alias("step"),
        I.definition_fingerprint(F.col("o_orderpriority"), F.lit(""), F.lit("{}")).alias(
            "definition_hash"
        ),
        key_suffix(
            F.create_map(F.lit("order"), F.col("o_orderkey").cast("string"))
        ).alias("partition"),
        F.lit("full").alias("params"),
    )
    pairs = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("step"),
        F.md5(
            F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
        ).alias("upstream"),
    )
    return I.run_fingerprint(steps, pairs, "step", "upstream")


SQL_HASHES = """
    s AS (SELECT c_custkey AS step, c_mktsegment AS partition FROM customer),
    p AS (SELECT DISTINCT c_mktsegment AS seg FROM customer),
    h AS (SELECT c_custkey AS base_id, NULL AS partition, md5('w' || c_custkey) AS run_hash
            FROM customer WHERE c_acctbal < 2000
          UNION ALL
          SELECT c_custkey, seg, md5('p' || c_custkey || seg) FROM customer, p
            WHERE c_acctbal >= 2000 AND c_acctbal < 5000
          UNION ALL
          SELECT c_custkey, seg, md5('q' || c_custkey || seg) FROM customer, p
            WHERE c_acctbal >= 5000 AND seg < c_mktsegment),
    e AS (SELECT s.step, s.partition, upstream FROM s JOIN v_edges ON downstream = s.step),
    x AS (SELECT e.*, 'exact' AS match, run_hash FROM e JOIN h ON h.base_id = upstream
            AND h.partition IS NULL),
    a AS (SELECT e.*, 'aligned' AS match, run_hash FROM e JOIN h ON h.base_id = upstream
            AND h.partition = e.partition),
    f AS (SELECT e.*, 'fan_in' AS match, run_hash FROM e JOIN h ON h.base_id = upstream
            WHERE h.partition IS NOT NULL
            AND NOT EXISTS (SELECT 1 FROM h g WHERE g.base_id = e.upstream
                            AND g.partition = e.partition))"""


@query(
    "upstream_hashes",
    "I3",
    f"""WITH {SQL_HASHES}
        SELECT * FROM x UNION ALL SELECT * FROM a UNION ALL SELECT * FROM f""",
)
def _(t):
    customers = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    # the partitions of a customer asset are the market segments seen in the data
    segments = F.sort_array(F.collect_set("c_mktsegment"))
    spread = customers.withColumn("seg", F.explode(t.customer.agg(segments).scalar()))

    def hashed(tag, seg):
        return F.md5(F.concat(F.lit(tag), key.cast("string"), seg))

    whole = customers.where(balance < 2000).select(
        key.alias("base_id"),
        F.lit(None).cast("string").alias("partition"),
        hashed("w", F.lit("")).alias("run_hash"),
    )
    full = spread.where((balance >= 2000) & (balance < 5000)).select(
        key.alias("base_id"), F.col("seg").alias("partition"), hashed("p", F.col("seg")).alias("run_hash")
    )
    some = spread.where((balance >= 5000) & (F.col("seg") < F.col("c_mktsegment"))).select(
        key.alias("base_id"), F.col("seg").alias("partition"), hashed("q", F.col("seg")).alias("run_hash")
    )
    steps = customers.select(key.alias("step"), F.col("c_mktsegment").alias("partition"))
    return I.upstream_hashes(steps, t.v_edges, whole.unionByName(full).unionByName(some), fan_in="rows")


@query(
    "latest_success",
    "W1",
    """SELECT node_id, run_hash, id, attempts FROM v_log WHERE status = 'success'
       QUALIFY row_number() OVER (PARTITION BY node_id, run_hash ORDER BY id DESC) = 1""",
)
def _(t):
    return W.latest_success(t.v_log).select("node_id", "run_hash", "id", "attempts")


@query(
    "cache_lookup",
    "I4",
    f"""WITH {SQL_STEPS}, n AS (SELECT node_id, run_hash, max(id) AS artifact_id FROM v_log
          WHERE status = 'success' GROUP BY 1, 2)
        SELECT s.node_id, s.run_hash, coalesce(artifact_id, -1) AS artifact_id,
               artifact_id IS NOT NULL AS hit
        FROM s LEFT JOIN n ON s.node_id = n.node_id AND s.run_hash = n.run_hash""",
)
def _(t):
    return I.cache_lookup(wanted_steps(t), t.v_log).withColumn(
        "artifact_id", F.coalesce("artifact_id", F.lit(-1).cast("bigint"))
    )



def sql_token(view: str) -> str:
    return f"""SELECT month, count(*) AS row_count, count(*) || '-' ||
        sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '-' ||
        sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS token
        FROM (SELECT month, md5(o_orderkey || '|' || o_custkey || '|' ||
                round(o_totalprice * 100)::BIGINT) AS h FROM {view}) GROUP BY month"""


def in_cents(df):
    return df.withColumn("cents", fixed_units("o_totalprice", 2))


def month_tokens(df, portable=False):
    columns = ["o_orderkey", "o_custkey", "cents"]
    return I.partition_digest(in_cents(df), ["month"], columns, portable)


@query("partition_digest", "I6", sql_token("v_src_old"))
def _(t):
    return month_tokens(t.v_src_old, portable=True)


@query(
    "stale_partitions",
    "I5",
    f"""WITH o AS ({sql_token("v_src_old")}), n AS ({sql_token("v_src_new")})
        SELECT month, row_count FROM n WHERE NOT EXISTS
          (SELECT 1 FROM o WHERE o.month = n.month AND o.token = n.token)""",
)
def _(t):
    now = month_tokens(t.v_src_new)
    stale = I.stale_partitions(now, month_tokens(t.v_src_old), ["month"])
    return now.join(stale, ["month", "token"], "left_semi").select("month", "row_count")


def month_totals(df):
    return in_cents(df).groupBy("month").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("cents").alias("revenue_cents"),
        F.count_distinct("o_custkey").alias("customers"),
    )


@query(
    "incremental_refresh",
    "I7",
    """SELECT month, count(*) AS order_count, sum(round(o_totalprice * 100)::BIGINT)::BIGINT
              AS revenue_cents, count(DISTINCT o_custkey) AS customers
       FROM v_src_new GROUP BY month""",
)
def _(t):
    old, new = t.v_src_old, t.v_src_new
    return I.incremental_refresh(
        new, month_tokens(new), month_tokens(old), month_totals(old), ["month"], month_totals
    )


@query(
    "incremental_by_files",
    "I7",
    """SELECT month, count(*) AS order_count, sum(round(o_totalprice * 100)::BIGINT)::BIGINT
              AS revenue_cents, count(DISTINCT o_custkey) AS customers
       FROM v_src_new GROUP BY month""",
)
def _(t):
    """A first refresh of files by month, then one after a month has other rows and another is gone."""
    root = scratch_path(t.spark, "by-files")
    folder, store = f"{root}/orders", f"{root}/store"
    sink_partitioned(t.v_src_old, folder, ["month"])
    schema = t.spark.read.parquet(folder).schema

    def refresh():
        return M.refresh_files(t.spark, folder, store, ["month"], month_totals, schema=schema)

    refresh()
    sink_partitioned(t.v_src_new.where("month = '1996-03'"), folder, ["month"])
    remove_path(t.spark, f"{folder}/month=1995-01")
    return refresh()


SQL_KIND = """CASE base_id WHEN 'error' THEN 'task' WHEN 'signup' THEN 'sensor' ELSE 'asset' END"""


def policy(t, mode, selected=()):
    base = F.substring_index("node_id", "[", 1)
    kind = F.when(base == "error", "task").when(base == "signup", "sensor").otherwise("asset")
    steps = wanted_steps(t).withColumns({"base_id": base, "kind": kind})
    out = I.refresh_policy(steps, t.v_log, mode, selected)
    return out.select("node_id", "run_hash", "kind", "reason", "must_run")


def sql_policy(forced: str) -> str:
    return f"""WITH {SQL_STEPS},
      k AS (SELECT *, split_part(node_id, '[', 1) AS base_id FROM s),
      g AS (SELECT DISTINCT node_id, run_hash, true AS hit FROM v_log WHERE status = 'success'),
      r AS (SELECT node_id, run_hash, {SQL_KIND} AS kind,
              CASE WHEN {SQL_KIND} <> 'asset' THEN 'uncached kind' WHEN {forced} THEN 'forced'
                   WHEN hit IS NULL THEN 'miss' ELSE 'hit' END AS reason
            FROM k LEFT JOIN g USING (node_id, run_hash))
      SELECT *, reason <> 'hit' AS must_run FROM r"""


@query("refresh_policy", "I8", sql_policy("false"))
def _(t):
    return policy(t, "cache-aware")


@query("refresh_policy_forced", "I8", sql_policy("base_id = 'click'"))
def _(t):
    return policy(t, "force-selected", ["click"])


@query(
    "append_materializations",
    "I9",
    """SELECT id, node_id, status, attempts FROM v_log
       WHERE created_at < TIMESTAMP '2024-01-15' OR status = 'failed' OR attempts > 1""",
)
def _(t):
    columns = ["id", "node_id", "status", "attempts"]
    log = t.v_log.where(F.expr("created_at < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    cached = (F.col("status") == "success") & (F.col("attempts") == 1)
    rows = t.v_log.withColumn("cached", cached)
    return I.new_materializations(log.select(columns), rows.select(*columns, "cached"))


SQL_ELIGIBLE = """
    n AS (SELECT c_custkey AS node_id, c_acctbal > -990 AS active,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'manual' WHEN 'MACHINERY' THEN 'schedule'
                 ELSE 'always' END AS freshness, c_nationkey < 12 AS window_open FROM customer),
    stale AS (SELECT c_custkey AS node_id FROM customer WHERE c_acctbal > 9500
              UNION SELECT downstream FROM v_edges JOIN stale ON upstream = node_id),
    blocked AS (SELECT node_id FROM stale JOIN n USING (node_id) WHERE freshness = 'manual'
                UNION SELECT downstream FROM v_edges JOIN blocked ON upstream = node_id),
    w AS (SELECT DISTINCT downstream AS node_id FROM v_edges JOIN stale ON upstream = node_id),
    b AS (SELECT DISTINCT downstream AS node_id FROM v_edges JOIN blocked ON upstream = node_id)"""


@query(
    "refresh_eligibility",
    "I10",
    f"""WITH RECURSIVE {SQL_ELIGIBLE}
        SELECT node_id, CASE WHEN NOT active THEN 'historical'
            WHEN node_id NOT IN (SELECT node_id FROM stale) THEN 'fresh'
            WHEN node_id IN (SELECT node_id FROM w) OR node_id IN (SELECT node_id FROM b)
              THEN 'stale_waiting_for_upstream'
            WHEN freshness = 'manual' OR (freshness = 'schedule' AND NOT window_open)
              THEN 'stale_waiting_for_schedule'
            ELSE 'runnable_stale' END AS state FROM n""",
)
def _(t):
    segment = F.col("c_mktsegment")
    nodes = t.customer.select(
        F.col("c_custkey").alias("node_id"),
        (F.col("c_acctbal") > -990).alias("active"),
        F.when(segment == "BUILDING", "manual")
        .when(segment == "MACHINERY", "schedule")
        .otherwise("always")
        .alias("freshness"),
        (F.col("c_nationkey") < 12).alias("window_open"),
    )
    changed = t.customer.where("c_acctbal > 9500").select(F.col("c_custkey").alias("node_id"))
    edges = t.v_edges

    def below(df):
        hops = edges.select(F.col("upstream").alias("node_id"), "downstream")
        return hops.join(df.hint("merge"), "node_id", "left_semi").select(F.col("downstream").alias("node_id"))

    stale = L.downstream_closure(edges, changed)
    manual = stale.join(nodes.where("freshness = 'manual'").hint("merge"), "node_id", "left_semi")
    blocked = below(L.downstream_closure(edges, manual))
    return I.refresh_eligibility(nodes, stale, below(stale), blocked)


@query(
    "history_diff",
    "I11",
    """SELECT DISTINCT coalesce(o.c_name, n.c_name) AS c_name,
              CASE WHEN n.c_name IS NULL THEN 'inactive' ELSE 'active' END AS status
       FROM (SELECT c_name FROM customer WHERE c_acctbal < 5000) o
       FULL JOIN (SELECT c_name FROM customer WHERE c_acctbal > 1000) n ON o.c_name = n.c_name""",
)
def _(t):
    return I.history_diff(
        t.customer.where("c_acctbal < 5000"), t.customer.where("c_acctbal > 1000"), ["c_name"]
    )


@query(
    "prune_unreachable",
    "I12",
    f"""WITH {SQL_STEPS} SELECT id, node_id FROM v_log l WHERE EXISTS
        (SELECT 1 FROM s WHERE s.node_id = l.node_id AND s.run_hash = l.run_hash)""",
)
def _(t):
    return I.prune_unreachable(t.v_log, wanted_steps(t)).select("id", "node_id")


@query(
    "continuity_key",
    "I13",
    """SELECT key, count(*) AS definitions FROM (
         SELECT CASE WHEN c_acctbal > 0 THEN c_name
                     ELSE 'nation_' || c_nationkey || '.py' || ':' || lower(c_mktsegment) END AS key
         FROM customer) GROUP BY key HAVING count(*) > 1""",
)
def _(t):
    key = I.continuity_key(
        F.when(F.col("c_acctbal") > 0, F.col("c_name")),
        F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"), F.lit(".py")),
        F.lower("c_mktsegment"),
    )
    return I.duplicate_keys(t.customer.select(key.alias("key")), "key")
