"""All-settled maps, retries, timeouts, sinks."""

import time

from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators import mapping as X
from lakeloom.session import scratch_path
from lakeloom.sources import sinks as K


def test_all_settle_in_argument_order(spark):
    def fn(x):
        if x % 3 == 0:
            raise KeyError(x)
        return x * x

    df = spark.range(30).toDF("i").repartition(6)
    got = X.guarded_map(df, "i", "i", fn).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(30))
    for r in got:
        if r["idx"] % 3 == 0:
            assert (r["ok"], r["value"], r["error"]) == (False, None, f"KeyError: {r['idx']}")
        else:
            assert (r["ok"], r["value"], r["error"]) == (True, str(r["idx"] ** 2), None)


def test_attempts_and_backoff():
    calls = []

    def flaky(_):
        calls.append(time.monotonic())
        if len(calls) < 3:
            raise ValueError("not yet")
        return "done"

    assert X.attempt(flaky, None, retries=3, backoff=0.05) == (True, "done", None, 3)
    # the wait grows with the number of the failed attempt
    assert calls[1] - calls[0] >= 0.05
    assert calls[2] - calls[1] >= 0.10


def test_default_is_one_attempt_and_less_clamps_to_one():
    def bad(_):
        raise RuntimeError("no")

    assert X.attempt(bad, None)[3] == 1
    assert X.attempt(bad, None, retries=0) == (False, None, "RuntimeError: no", 1)


def test_timeout_is_an_error_value():
    call = X.TimedCaller(0.1)
    ok, value, error, attempts = X.attempt(time.sleep, 5, retries=2, call=call)
    assert (ok, value, attempts) == (False, None, 2)
    assert error == "TimeoutError: no result within 0.1 seconds"
    # the caller goes on with a new thread
    assert X.attempt(abs, -3, call=call) == (True, "3", None, 1)


def test_empty_input(spark):
    df = spark.range(0).toDF("i")
    assert X.guarded_map(df, "i", "i", lambda x: x).count() == 0


def test_failing_sink_stays_isolated(spark):
    root = scratch_path(spark, "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "a bigint, b string")
    out = K.sink_all(df, [K.Sink(f"{root}/x.pkl"), K.Sink("nofs://host/x.json"), K.Sink(f"{root}/y.json")])
    got = {r["path"].rsplit("/", 1)[1]: r for r in out.collect()}
    assert got["x.pkl"]["status"] == "error" and "pickle" in got["x.pkl"]["error"]
    assert got["x.json"]["status"] == "error"
    assert got["y.json"]["status"] == "ok" and got["y.json"]["size_bytes"] > 0
    assert rows(spark.read.schema("a bigint, b string").json(f"{root}/y.json")) == rows(df)


def test_task_action_reports_failures(spark):
    def act(pdf):
        if (pdf["id"] == 3).any():
            raise OSError("down")

    audit = K.task_action(spark.range(8).repartition(8), act, "t")
    by = {r["status"]: r["n"] for r in audit.groupBy("status").agg(F.sum("row_count").alias("n")).collect()}
    assert by["error"] >= 1 and by["ok"] + by["error"] == 8


def test_empty_frame_keeps_schema(spark):
    path = scratch_path(spark, "empty")
    df = spark.createDataFrame([], "a bigint, b string")
    K.sink_parquet(df, path)
    assert spark.read.parquet(path).schema == df.schema
