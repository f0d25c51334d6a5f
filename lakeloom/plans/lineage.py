"""Closures and propagation over the customer graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators import lineage as L
from lakeloom.plans.registry import query


def nodes_where(t, condition):
    return t.customer.where(condition).select(F.col("c_custkey").alias("node_id"))


@query(
    "upstream_closure",
    "L1",
    """WITH RECURSIVE r AS (SELECT c_custkey AS node_id FROM customer WHERE c_acctbal > 9900
         UNION SELECT upstream FROM v_edges JOIN r ON downstream = node_id)
       SELECT node_id FROM r""",
)
def _(t):
    return L.upstream_closure(t.v_edges, nodes_where(t, "c_acctbal > 9900"))


@query(
    "downstream_closure",
    "L2",
    """WITH RECURSIVE r AS (SELECT c_custkey AS node_id FROM customer WHERE c_acctbal > 9800
         UNION SELECT downstream FROM v_edges JOIN r ON upstream = node_id)
       SELECT node_id FROM r""",
)
def _(t):
    return L.downstream_closure(t.v_edges, nodes_where(t, "c_acctbal > 9800"))


@query(
    "topo_level",
    "L3",
    """WITH RECURSIVE r AS (SELECT c_custkey AS node_id, 0::BIGINT AS level FROM customer
           WHERE c_custkey NOT IN (SELECT downstream FROM v_edges)
         UNION SELECT downstream, level + 1 FROM v_edges JOIN r ON upstream = node_id)
       SELECT node_id, max(level) AS level FROM r GROUP BY node_id""",
)
def _(t):
    return L.topo_level(t.v_edges, t.customer.select(F.col("c_custkey").alias("node_id")))


@query(
    "stale_propagation",
    "L4",
    """WITH RECURSIVE c AS (SELECT c_custkey AS node_id FROM customer WHERE c_acctbal < -900),
         r AS (SELECT node_id FROM c
         UNION SELECT downstream FROM v_edges JOIN r ON upstream = node_id)
       SELECT node_id, CASE WHEN node_id IN (SELECT node_id FROM c) THEN 'changed'
              ELSE 'inherited' END AS cause FROM r""",
)
def _(t):
    return L.stale_propagation(t.v_edges, nodes_where(t, "c_acctbal < -900"))


@query(
    "failure_cascade",
    "L5",
    """WITH RECURSIVE f AS (SELECT c_custkey AS node_id FROM customer WHERE c_acctbal < -800),
         r AS (SELECT node_id FROM f
         UNION SELECT downstream FROM v_edges JOIN r ON upstream = node_id WHERE kind = 'data')
       SELECT c_custkey AS node_id, CASE WHEN c_custkey IN (SELECT node_id FROM f) THEN 'failed'
              WHEN c_custkey IN (SELECT node_id FROM r) THEN 'skipped' ELSE 'success' END AS status
       FROM customer""",
)
def _(t):
    return L.failure_cascade(
        t.v_edges,
        t.customer.select(F.col("c_custkey").alias("node_id")),
        nodes_where(t, "c_acctbal < -800"),
    )


SQL_FAULTY = """
    e AS (SELECT upstream, downstream FROM v_edges
          UNION ALL SELECT c_custkey, (c_custkey - 1) // 2 FROM customer
            WHERE c_custkey >= 1 AND c_acctbal < -900
          UNION ALL SELECT -1 - c_custkey, c_custkey FROM customer WHERE c_acctbal > 9950),
    k AS (SELECT c_custkey AS node_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'task'
              WHEN 'MACHINERY' THEN 'sensor' ELSE 'asset' END AS kind FROM customer),
    reach AS (SELECT upstream AS a, downstream AS b FROM e
              UNION SELECT a, downstream FROM e JOIN reach ON upstream = b)"""


@query(
    "validate_edges",
    "L6",
    f"""WITH RECURSIVE {SQL_FAULTY}
        SELECT 'duplicate_key' AS issue, c_custkey::VARCHAR AS subject FROM customer
          WHERE c_acctbal BETWEEN 5000 AND 5100
        UNION ALL
        SELECT DISTINCT CASE WHEN u.kind IS NULL THEN 'unresolved_input' WHEN d.kind IS NULL THEN 'unresolved_node'
                    WHEN d.kind = 'sensor' THEN 'sensor_with_inputs' ELSE 'task_as_input' END,
               upstream || '->' || downstream
        FROM e LEFT JOIN k d ON d.node_id = downstream LEFT JOIN k u ON u.node_id = upstream
        WHERE u.kind IS NULL OR d.kind IS NULL OR d.kind = 'sensor' OR (u.kind = 'task' AND d.kind <> 'task')
        UNION ALL
        SELECT DISTINCT 'cycle', a::VARCHAR FROM reach WHERE a = b""",
)
def _(t):
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    segment = F.col("c_mktsegment")
    kind = F.when(segment == "BUILDING", "task").when(segment == "MACHINERY", "sensor")
    nodes = t.customer.select(key.alias("node_id"), kind.alias("kind"), balance).fillna(
        "asset", ["kind"]
    )
    twice = nodes.where(balance.between(5000, 5100))
    back = t.customer.where((key >= 1) & (balance < -900)).select(
        key.alias("upstream"), F.floor((key - 1) / 2).cast("bigint").alias("downstream")
    )
    dangling = t.customer.where(balance > 9950).select(
        (-1 - key).alias("upstream"), key.alias("downstream")
    )
    edges = t.v_edges.select("upstream", "downstream").unionByName(back).unionByName(dangling)
    return L.validate_edges(nodes.unionByName(twice).select("node_id", "kind"), edges)


@query(
    "ordering_edges",
    "L7",
    """SELECT upstream, downstream,
              CASE WHEN starts_with(param, '_') THEN 'ordering' ELSE 'data' END AS kind FROM
         (SELECT upstream, downstream,
                 CASE WHEN downstream % 5 = 0 THEN '_after' ELSE 'in_' END || upstream AS param
          FROM v_edges)""",
)
def _(t):
    param = F.concat(
        F.when(F.col("downstream") % 5 == 0, "_after").otherwise("in_"),
        F.col("upstream").cast("string"),
    )
    edges = t.v_edges.select("upstream", "downstream").withColumn("param", param)
    return L.ordering_edges(edges).select("upstream", "downstream", "kind")
