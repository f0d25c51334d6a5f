"""Declared assets: caching, staleness, partitions, sensors and tasks."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeloom.catalog import AssetCatalog, AssetError
from lakeloom.session import scratch_path
from lakeloom.sources.sinks import Sink


@pytest.fixture
def root(spark):
    return scratch_path(spark, "store")


def chain(spark, root, versions=("", "", "")):
    cat = AssetCatalog(spark, root)
    calls = []

    @cat.asset(version=versions[0])
    def a(spark):
        calls.append("a")
        return spark.range(3).withColumn("value", F.col("id") + 1)

    @cat.asset(inputs={"data": a}, version=versions[1])
    def b(data):
        calls.append("b")
        return data.withColumn("value", F.col("value") + 10)

    @cat.asset(inputs={"data": b}, version=versions[2])
    def c(data):
        calls.append("c")
        return data.withColumn("value", F.col("value") * 2)

    return cat, calls


@pytest.mark.parametrize(
    "changed,ran", [(("", "", "x"), ["c"]), (("", "x", ""), ["b", "c"]), (("x", "", ""), ["a", "b", "c"])]
)
def test_only_what_changed_runs(spark, root, changed, ran):
    cat, calls = chain(spark, root)
    first = rows(cat.get("c"))
    assert calls == ["a", "b", "c"]
    assert rows(cat.get("c")) == first and len(calls) == 3
    other, calls = chain(spark, root, changed)
    assert rows(other.get("c")) == first
    assert calls == ran
    # back at the first definition its old artifacts are current again
    again, calls = chain(spark, root)
    assert rows(again.get("c")) == first and calls == []
    top = again.history(1).first()
    assert (top["steps_executed"], top["steps_cached"], top["status"]) == (0, 3, "success")


def test_target_runs_only_what_it_needs(spark, root):
    cat, calls = chain(spark, root)
    cat.get("b")
    assert calls == ["a", "b"]
    assert rows(cat.plan("b")) == [("a", "b", "data")]


def test_no_cache_reruns_everything(spark, root):
    cat, calls = chain(spark, root)
    cat.get("c")
    cat.get("c", no_cache=True)
    assert calls == ["a", "b", "c"] * 2


def test_partitioned_asset_recomputes_stale_keys(spark, root):
    rng = random.Random(1)
    data = {k: [rng.randint(0, 9) for _ in range(4)] for k in "abcd"}
    seen = []
    cat = AssetCatalog(spark, root)

    @cat.sensor
    def inbox(spark):
        return True, spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v bigint")

    @cat.asset(inputs={"rows": inbox}, partitions=["k"])
    def totals(rows):
        seen.append({r[0] for r in rows.select("k").distinct().collect()})
        return rows.groupBy("k").agg(F.sum("v").alias("total"))

    def want():
        return sorted((k, sum(vs)) for k, vs in data.items())

    assert rows(cat.get("totals"), "k", "total") == want()
    assert rows(cat.get("totals"), "k", "total") == want()
    assert seen == [set("abcd")]
    data["b"][0] += 1
    del data["d"]
    data["e"] = [5]
    assert rows(cat.get("totals"), "k", "total") == want()
    assert seen[-1] == {"b", "e"}


def test_sensor_without_update_leaves_downstream_fresh(spark, root):
    state = {"updated": True, "n": 3}
    calls = []
    cat = AssetCatalog(spark, root)

    @cat.sensor
    def beat(spark):
        return state["updated"], spark.range(state["n"])

    @cat.asset(inputs={"beats": beat})
    def seen(beats):
        calls.append(1)
        return beats.agg(F.count(F.lit(1)).alias("n"))

    cat.get("seen")
    state.update(updated=False, n=9)
    assert cat.get("seen").first()["n"] == 3 and len(calls) == 1
    state.update(updated=True)
    assert cat.get("seen").first()["n"] == 9 and len(calls) == 2


def test_forced_results_are_the_newest_and_reused(spark, root):
    cat = AssetCatalog(spark, root)
    calls = []

    @cat.asset
    def counted(spark):
        calls.append(1)
        return spark.range(len(calls))

    assert cat.get("counted", no_cache=True).count() == 1
    assert cat.get("counted").count() == 1 and len(calls) == 1
    assert cat.get("counted", no_cache=True).count() == 2
    assert cat.get("counted").count() == 2 and len(calls) == 2
    for row in cat.log().collect():
        assert spark.read.parquet(row["artifact_path"]).count() in (1, 2)
        assert row["artifact_format"] == "parquet" and row["artifact_size_bytes"] > 0


def test_poll_without_update_serves_the_last_snapshot(spark, root):
    state = {"updated": True, "n": 3}
    cat = AssetCatalog(spark, root)

    @cat.sensor
    def beat(spark):
        return state["updated"], spark.range(state["n"])

    assert cat.get("beat").count() == 3
    state.update(updated=False, n=9)
    assert cat.get("beat").count() == 3

    @cat.asset(inputs={"beats": beat})
    def late(beats):
        return beats.agg(F.count(F.lit(1)).alias("n"))

    assert cat.get("late").first()["n"] == 3
    state.update(updated=True)
    assert cat.get("late").first()["n"] == 9


def test_tasks_always_run_and_burst_selects(spark, root):
    cat, calls = chain(spark, root)
    acted = []

    @cat.task(inputs={"data": "c", "_after": "a"})
    def publish(data, _after):
        assert _after is None
        acted.append(data.count())

    cat.run("publish", burst=[])
    cat.run("publish", burst=["b"])
    assert calls == ["a", "b", "c", "b"]
    cat.run("publish")
    assert calls[4:] == ["a", "b", "c"] and acted == [3, 3, 3]


def test_retries_failures_and_log(spark, root):
    cat = AssetCatalog(spark, root)
    tries = []

    @cat.asset(retries=3)
    def flaky(spark):
        tries.append(1)
        if len(tries) < 3:
            raise ValueError("not yet")
        return spark.range(1)

    @cat.asset(inputs={"x": flaky})
    def broken(x):
        raise KeyError("gone")

    assert cat.get("flaky").count() == 1
    with pytest.raises(AssetError):
        cat.get("broken")
    log = {(r["node_id"], r["cached"]): r for r in cat.log().collect()}
    assert log["flaky", False]["attempts"] == 3
    assert log["broken", False]["status"] == "failed"
    assert "gone" in log["broken", False]["error_message"]
    assert "broken" in log["broken", False]["error_traceback"]
    assert log["broken", False]["artifact_path"] is None
    assert cat.stats().count() == 2


def test_sinks_are_isolated(spark, root):
    cat = AssetCatalog(spark, root)

    @cat.asset(sinks=[Sink(f"{root}/out.json"), Sink(f"{root}/out.pkl")])
    def greeting(spark):
        return spark.createDataFrame([("world",)], "hi string")

    cat.get("greeting")
    assert spark.read.json(f"{root}/out.json").count() == 1
    assert "pickle" in cat.log().first()["sinks_json"]


def test_declaration_errors(spark, root):
    cat, _ = chain(spark, root)
    cat.task(lambda data: None, name="t", inputs={"data": "c"})
    for bad in (
        lambda: cat.asset(lambda x: x, name="d1", inputs={"x": "t"}),
        lambda: cat.asset(lambda x: x, name="d2", inputs={"x": "nobody"}),
        lambda: cat.sensor(lambda x: x, name="s", inputs={"x": "a"}),
        lambda: cat.asset(lambda x: x, name="a"),
        lambda: cat.get("t"),
        lambda: cat.run("c"),
    ):
        with pytest.raises(AssetError):
            bad()


def test_params_make_their_own_version(spark, root):
    cat, _ = chain(spark, root)

    @cat.asset(inputs={"data": "c"})
    def scaled(data, factor=1):
        return data.agg((F.sum("value") * factor).alias("v"))

    one = cat.get("scaled").first()["v"]
    assert cat.get("scaled", params={"factor": 3}).first()["v"] == 3 * one
    assert cat.get("scaled").first()["v"] == one
