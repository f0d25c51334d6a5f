"""User functions over partitions and rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakeloom.operators import mapping as X
from lakeloom.plans.registry import query
from lakeloom.session import materialize, shuffle_partitions
from lakeloom.sources.fixtures import month_of


def type_profile(key, pdf):
    """Result of one event type."""
    cents = (pdf["value"] * 100).round().astype("int64")
    return pd.DataFrame(
        {
            "event_type": [key[0]],
            "n": [len(pdf)],
            "cents": [int(cents.sum())],
            "top": [float(pdf["value"].max())],
        }
    )


@query(
    "map_by_key",
    "X1",
    """SELECT event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents,
              max(value) AS top FROM events GROUP BY 1""",
)
def _(t):
    return X.map_by_key(
        t.events.select("event_type", "value"),
        ["event_type"],
        type_profile,
        "event_type string, n bigint, cents bigint, top double",
    )


@query(
    "map_aligned",
    "X2",
    """SELECT o_orderkey, o_custkey, upper(c_mktsegment) AS tier,
              round(o_totalprice * 100)::BIGINT AS cents
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    def enrich(key, orders, customers):
        tier = customers["c_mktsegment"].iat[0].upper() if len(customers) else None
        cents = (orders["o_totalprice"].to_numpy() * 100).round()
        whole = np.isfinite(cents).all()
        return {
            "o_orderkey": orders["o_orderkey"].to_numpy(),
            "o_custkey": orders["o_custkey"].to_numpy(),
            "tier": [tier] * len(orders),
            "cents": cents.astype("int64") if whole else [None if np.isnan(c) else int(c) for c in cents],
        }

    out = X.map_aligned(
        t.orders.select(
            F.col("o_custkey").alias("k"), "o_orderkey", "o_custkey", "o_totalprice"
        ),
        t.customer.select(F.col("c_custkey").alias("k"), "c_mktsegment"),
        ["k"],
        enrich,
        "o_orderkey bigint, o_custkey bigint, tier string, cents bigint",
    )
    return out


SQL_ALIGNED = """
    SELECT month, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines,
           count(DISTINCT o_orderkey) FILTER (l_orderkey IS NOT NULL AND q > 150) AS large
    FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders) o
    LEFT JOIN (SELECT l_orderkey, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS q FROM lineitem) l
      ON l_orderkey = o_orderkey
    GROUP BY month"""


def order_lines(t):
    """Orders and their lines, both in partitions by month."""
    orders = t.orders.select("o_orderkey", month_of("o_orderdate").alias("month"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity").join(orders, "o_orderkey")
    return orders, lines


ALIGNED = "month string, orders bigint, lines bigint, large bigint"


@query("map_aligned_partitions", "X2", SQL_ALIGNED)
def _(t):
    def profile(key, orders, lines):
        quantity = lines["l_quantity"].groupby(lines["o_orderkey"]).sum()
        large = orders["o_orderkey"].map(quantity).fillna(0) > 150
        return pd.DataFrame({"month": [key[0]], "orders": [len(orders)], "lines": [len(lines)], "large": [int(large.sum())]})

    return X.map_aligned(*order_lines(t), ["month"], profile, ALIGNED)


@query("map_aligned_batches", "X2", SQL_ALIGNED)
def _(t):
    """The lines of a month come batch by batch; its orders are held."""

    def profile(key, lines, orders):
        quantity, n = pd.Series(0.0, index=orders["o_orderkey"]), 0
        for batch in lines:
            n += len(batch)
            quantity = quantity.add(batch["l_quantity"].groupby(batch["o_orderkey"]).sum(), fill_value=0)
        yield pd.DataFrame({"month": [key[0]], "orders": [len(orders)], "lines": [n], "large": [int((quantity > 150).sum())]})

    orders, lines = order_lines(t)
    return X.map_aligned_batches(lines, orders, ["month"], profile, ALIGNED, how="full")


def halve(price):
    """Fails on every amount whose whole part ends in 7."""
    whole = int(price)
    if whole % 10 == 7:
        raise ValueError(f"bad amount {whole}")
    return whole // 2


SQL_GUARDED = """
    SELECT o_orderkey AS idx, floor(o_totalprice)::BIGINT AS w FROM orders"""


@query(
    "guarded_map",
    "X3",
    f"""SELECT idx, w % 10 <> 7 AS ok, CASE WHEN w % 10 <> 7 THEN (w // 2)::VARCHAR END AS value,
          CASE WHEN w % 10 = 7 THEN 'ValueError: bad amount ' || w END AS error,
          CASE WHEN w % 10 = 7 THEN 2 ELSE 1 END::INTEGER AS attempts FROM ({SQL_GUARDED})""",
)
def _(t):
    return X.guarded_map(
        t.orders, "o_orderkey", "o_totalprice", halve, retries=2, parallelism=shuffle_partitions(t.spark)
    )


class Flaky:
    """Fails the first ``int(x) % 3`` attempts on an item, then returns it."""

    def __init__(self):
        self.failures = {}

    def __call__(self, x):
        seen = self.failures.get(x, 0)
        if seen < int(x) % 3:
            self.failures[x] = seen + 1
            raise RuntimeError(f"attempt {seen + 1}")
        self.failures.pop(x, None)
        return int(x)


@query(
    "retry_policy",
    "X4",
    """SELECT c_custkey AS idx, c_custkey % 3 < 2 AS ok,
              CASE WHEN c_custkey % 3 < 2 THEN c_custkey::VARCHAR END AS value,
              CASE WHEN c_custkey % 3 = 2 THEN 'RuntimeError: attempt 2' END AS error,
              (1 + least(c_custkey % 3, 1))::INTEGER AS attempts FROM customer""",
)
def _(t):
    return X.guarded_map(t.customer, "c_custkey", "c_custkey", Flaky(), retries=2)


def slow_on_negative(balance):
    import time

    if balance < -990:
        time.sleep(1.0)
    return round(balance)


@query(
    "timeout_policy",
    "X5",
    """SELECT c_custkey AS idx, c_acctbal >= -990 AS ok,
              CASE WHEN c_acctbal < -990 THEN 'TimeoutError: no result within 0.25 seconds' END
                AS error, 1 AS attempts FROM customer""",
)
def _(t):
    out = X.guarded_map(
        t.customer, "c_custkey", "c_acctbal", slow_on_negative, timeout=0.25,
        parallelism=shuffle_partitions(t.spark),
    )
    return out.select("idx", "ok", "error", "attempts")


@query(
    "branch_map",
    "X6",
    """SELECT 'initial' AS branch, s_suppkey AS idx, true AS ok, substr(s_name, 1, 1) AS value
       FROM supplier
       UNION ALL
       SELECT 'number', s_suppkey, s_suppkey % 10 <> 3,
              CASE WHEN s_suppkey % 10 <> 3 THEN s_suppkey::VARCHAR END FROM supplier""",
)
def _(t):
    def initial(name):
        return name[0]

    def number(name):
        digits = int(name.split("#")[1])
        if digits % 10 == 3:
            raise ValueError("no number ending in 3")
        return digits

    out = X.branch_map(t.supplier, "s_suppkey", "s_name", {"initial": initial, "number": number})
    return out.select("branch", "idx", "ok", "value")


@query(
    "split_outcomes",
    "X7",
    f"""SELECT w % 10 <> 7 AS ok, count(*) AS items,
               sum(CASE WHEN w % 10 = 7 THEN 2 ELSE 1 END)::BIGINT AS attempts,
               min(idx) AS first_idx
        FROM ({SQL_GUARDED}) GROUP BY 1""",
)
def _(t):
    settled = materialize(
        X.guarded_map(
            t.orders,
            "o_orderkey",
            "o_totalprice",
            halve,
            retries=2,
            parallelism=shuffle_partitions(t.spark),
        ),
        "settled",
    )
    values, errors = X.split_outcomes(settled)
    first = (
        values.select(F.lit(True).alias("ok"), "idx")
        .unionByName(errors.select(F.lit(False).alias("ok"), "idx"))
        .groupBy("ok")
        .agg(F.min("idx").alias("first_idx"))
    )
    return X.outcome_counts(settled).join(first, "ok")


def order_spread(key, pdf):
    price = pdf["o_totalprice"].to_numpy()
    # as pandas has it, a price that is not a number is none
    return {
        "o_custkey": [key[0]],
        "n": [len(price)],
        "low": [np.fmin.reduce(price)],
        "high": [np.fmax.reduce(price)],
    }


@query(
    "collect_udaf",
    "X8",
    """SELECT o_custkey, count(*) AS orders, round(max(o_totalprice) - min(o_totalprice), 4) AS spread
       FROM orders GROUP BY 1""",
)
def _(t):
    out = X.collect_udaf(
        t.orders.select("o_custkey", "o_orderkey", "o_totalprice"),
        ["o_custkey"],
        order_spread,
        "o_custkey bigint, n bigint, low double, high double",
        {
            "orders": F.sum("n"),
            "spread": F.round(F.max("high") - F.min("low"), 4),
        },
        slice_by=["o_orderkey"],
    )
    return out


@query(
    "expand_keys",
    "X9",
    """SELECT event_id, key FROM (SELECT event_id,
         unnest([event_type, user_id::VARCHAR, props->>'$.k']) AS key FROM events)""",
)
def _(t):
    listed = t.events.select(
        "event_id",
        F.concat(
            F.lit('["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit(","),
            F.get_json_object("props", "$.k"), F.lit(',{"not":"a key"},null]'),
        ).alias("keys"),
    )
    return X.expand_keys(listed, "keys").select("event_id", "key")
