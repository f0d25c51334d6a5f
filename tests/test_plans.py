"""What the optimizer does with the operators."""

import contextlib
import io

from lakeloom.operators import ordered as W
from lakeloom.operators import transforms as P
from lakeloom.operators.partitions import single_partition
from lakeloom.session import scratch_path
from lakeloom.sources.fixtures import Tables
from lakeloom.sources.sinks import sink_partitioned


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_and_columns_reach_the_scan(spark, sf):
    t = Tables(spark, sf)
    text = plan(P.filter_equals(t.orders, "o_orderstatus", "F").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_projection_reads_two_columns(spark, sf):
    text = plan(P.project_columns(Tables(spark, sf).lineitem, ["l_orderkey", "l_tax"]))
    assert "ReadSchema: struct<l_orderkey:bigint,l_tax:double>" in text


def test_single_partition_prunes_files(spark, sf):
    path = scratch_path(spark, "pruned")
    df = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    sink_partitioned(df, path, ["o_orderstatus"])
    text = plan(single_partition(spark.read.schema(df.schema).parquet(path), {"o_orderstatus": "O"}))
    assert "PartitionFilters: [isnotnull(o_orderstatus" in text


def test_recent_rows_are_limited_before_the_shuffle(spark, sf):
    text = plan(W.recent_n_per_node(Tables(spark, sf).v_log, 10))
    assert text.index("WindowGroupLimit") < text.index("Exchange")
    assert "Partial" in text


def test_no_query_uses_a_cartesian_or_nested_loop_join(spark, sf):
    from lakeloom.plans.registry import as_callable, load_all

    eager = {"rf_regress", "rf_classify", "feature_importance_table"}
    for name, q in load_all().items():
        if q.operator.startswith(("ST", "SK", "SC", "X")) or name in eager:
            continue
        text = plan(as_callable(q)(spark, sf))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_one_row_inputs_need_no_join(spark, sf):
    from lakeloom.operators.aggregates import minmax_normalize

    text = plan(minmax_normalize(Tables(spark, sf).v_numeric, ["quantity", "price"]))
    assert "Join" not in text
