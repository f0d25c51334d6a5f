"""Empty inputs, nulls and single rows."""

from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeloom.functions import scalars as S
from lakeloom.operators import aggregates as A
from lakeloom.operators import incremental as I
from lakeloom.operators import joins as J
from lakeloom.operators import partitions as G
from lakeloom.operators import runlog as R
from lakeloom.operators import sets as U
from lakeloom.operators import transforms as P
from lakeloom.session import scratch_path

ORDERS = "customer_id bigint, product_id bigint, month string, quantity double, total decimal(17,2)"


def test_marts_of_nothing(spark):
    none = spark.createDataFrame([], ORDERS)
    got = A.mart_summary(none).first()
    assert (got["customer_count"], got["months_tracked"], got["product_count"]) == (0, 0, 0)
    assert (got["total_revenue"], got["avg_revenue_per_month"], got["top_customer_ltv"]) == (0, 0, 0)
    assert A.monthly_metrics(none).count() == 0


def test_mart_of_one_order(spark):
    from decimal import Decimal

    got = A.mart_summary(spark.createDataFrame([(1, 2, "2024-01", 3.0, Decimal("9.99"))], ORDERS)).first()
    assert [float(x) for x in got] == [1, 1, 1, 9.99, 9.99, 9.99]


def test_profiles_of_nothing(spark):
    none = spark.createDataFrame([], "a double, b double")
    got = A.column_profile(none, ["a", "b"]).collect()
    assert [(r["mean"], r["min"], r["max"], r["row_count"]) for r in got] == [(0, 0, 0, 0)] * 2
    assert A.minmax_normalize(none, ["a"]).count() == 0
    assert rows(P.expectations(none, {}), "check_name", "passed") == [("nonempty", False)]


def test_normalize_without_spread(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "a double")
    assert rows(A.minmax_normalize(df, ["a"])) == [(0.0,), (0.0,)]


def test_outlier_filter_counts_missing_as_zero(spark):
    df = spark.createDataFrame([(0.5, None), (0.99, 0.1), (None, None)], "a double, b double")
    assert P.filter_all_le(df, ["a", "b", "absent"], 0.95).count() == 2
    assert rows(P.removed_count(df, ["a", "b", "absent"], 0.95)) == [(2, 1)]


def test_strict_expectation_raises(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    with pytest.raises(Exception, match="expectation failed: present"):
        P.expectations(df, {"present": F.col("a").isNotNull()}, strict=True).collect()


def test_unmatched_facts_get_the_default(spark):
    facts = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, n int")
    dim = spark.createDataFrame([(1, "GOLD")], "k int, tier string")
    got = J.left_join_default(facts, dim, "k", "tier", "UNKNOWN")
    assert rows(got, "n", "tier") == [(10, "GOLD"), (20, "UNKNOWN"), (30, "UNKNOWN")]


def test_declared_keys_without_rows_stay(spark):
    df = spark.createDataFrame([("a", 1), ("z", 9)], "k string, v int")
    got = G.static_partitions(df, {"k": ["a", "b"]})
    assert rows(got, "k", "v") == [("a", 1), ("b", None)]


def test_explicit_keys_drop_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", None)], "k string, v int")
    assert rows(G.explicit_keys(df, ["k", "v"])) == [("a", 1)]


def test_universe_and_history(spark):
    old = spark.createDataFrame([("a",), ("b",)], "k string")
    new = spark.createDataFrame([("b",), ("c",)], "k string")
    assert dict(rows(U.universe_diff(old, new, ["k"]))) == {"a": "removed", "b": "retained", "c": "new"}
    assert dict(rows(I.history_diff(old, new, ["k"]))) == {"a": "inactive", "b": "active", "c": "active"}


def test_merge_is_idempotent(spark):
    log = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, v string")
    more = spark.createDataFrame([(2, "other"), (3, "z"), (3, "z")], "id bigint, v string")
    once = U.merge_logs(log, more)
    assert rows(once) == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(U.merge_logs(once, more)) == rows(once)


def test_history_table_only_grows(spark):
    path = scratch_path(spark, "history")
    for day, cached in (("d1", False), ("d1", True), ("d2", False)):
        row = spark.createDataFrame([(day, cached)], "created_day string, cached boolean")
        I.append_materializations(path, row.withColumn("node", F.lit("n")))
    assert rows(spark.read.parquet(path), "created_day") == [("d1",), ("d2",)]


def test_node_stats_of_one_row(spark):
    log = spark.createDataFrame(
        [("a", "h", 2.0), ("b", "", 0.0), ("b", "", 0.0)],
        "node_id string, run_hash string, elapsed_seconds double",
    )
    got = {r["node_id"]: r for r in R.node_stats(log).collect()}
    assert (got["a"]["median_elapsed"], got["a"]["p95_elapsed"], got["a"]["repeat_hash_rate"]) == (2, 2, 0)
    assert got["b"]["avg_elapsed"] is None and got["b"]["median_elapsed"] is None
    # an empty run hash is no repeat
    assert got["b"]["repeat_hash_rate"] == 0 and got["b"]["total_runs"] == 2


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(" 　 A b\t\n", "dir/f.py:x[a=1,b=ä ½]")], "s string, n string")
    got = df.select(
        S.strip_lower("s"),
        S.safe_name("n"),
        S.percent_format(F.lit(0.1234)),
        S.zero_pad(F.lit(7), 4, "T"),
        S.parse_int(F.lit("p00042"), 1),
        S.parse_int(F.lit("px"), 1),
        S.merge_maps(
            F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))
        ),
    ).first()
    assert list(got) == [
        "a b", "dir__f.py--x_a_1_b_ä_½", "12.34%", "T0007", 42, None, {"a": 1, "b": 3},
    ]


def test_safe_names_do_not_collide(spark):
    # steps of one folder that differ in one separator, key or value
    ids = ["etl/load.py:run", "etl/load.py/run", "etl:load.py:run", "etl/load.py:run[day=1]", "etl/load.py:run[day=2]", "etl/load.py:run[hour=1]"]
    df = spark.createDataFrame([(i,) for i in ids], "n string")
    assert df.select(S.safe_name("n").alias("s")).distinct().count() == len(ids)


def test_exact_sum_keeps_small_and_large_values(spark):
    def total(values):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
        return df.agg(S.exact_sum("v").alias("s")).first().s

    assert total([0.00004] * 1000) == Decimal("0.04")
    assert total([9.5e14] * 3 + [0.25]) == Decimal("2850000000000000.25")
    assert total([1e17, 0.5, -1e17]) == Decimal("0.5")
    assert total([5e18, 5e18, 1e20, -0.5]) == Decimal(11 * 10**19) - Decimal("0.5")
    assert total([-1e-4] * 7 + [None]) == Decimal("-0.0007")
    assert total([None]) is None and total([1.0, float("nan")]) is None and total([1.0, float("inf")]) is None


def test_exact_sum_ignores_order_and_sign(spark):
    values = [0.1, -0.25, 1234567.8901, -1e-4] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    assert float(df.agg(S.exact_sum("v")).first()[0]) == pytest.approx(1234567.74 * 50, abs=1e-9)
