"""Streams that keep their state in a state store."""

import random
import time

from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators.ordered import asym_ewma
from lakeloom.session import scratch_path
from lakeloom.streaming import streams as S

COLUMNS = "k string, o bigint, v double"


def inbox(spark):
    root = scratch_path(spark, "stream-state")
    return f"{root}/in", f"{root}/out"


def put(spark, folder, data):
    spark.createDataFrame(data, COLUMNS).repartition(3).write.mode("append").parquet(folder)


def stream(spark, folder):
    return S.sensor_file_stream(spark, folder, spark.createDataFrame([], COLUMNS).schema).drop("file_name")


def rounded(df):
    return rows(df.withColumn("estimate", F.round("estimate", 9)))


def test_estimates_go_on_over_restarts_and_equal_one_fold(spark):
    folder, root = inbox(spark)
    rng = random.Random(4)
    whole = [(rng.choice(["a", "b", None]), k, rng.choice([None, rng.uniform(-5, 300)])) for k in range(600)]
    whole += [("late", 900, 3.5), ("none", 901, None)]
    for at in (0, 200, 400):
        put(spark, folder, whole[at : at + 202 if at == 400 else at + 200])
        got = S.stream_ewma(spark, stream(spark, folder), "k", "o", "v", root)
        upto = spark.createDataFrame(whole[: at + 202 if at == 400 else at + 200], COLUMNS)
        assert rounded(got) == rounded(asym_ewma(upto, "k", "o", "v"))
    # nothing new: the estimates stay
    assert rounded(S.stream_ewma(spark, stream(spark, folder), "k", "o", "v", root)) == rounded(got)


def test_a_batch_touches_its_own_keys_only(spark):
    folder, root = inbox(spark)
    put(spark, folder, [(f"k{i}", i, 1.0) for i in range(500)])
    S.stream_ewma(spark, stream(spark, folder), "k", "o", "v", root)
    put(spark, folder, [("k7", 600, 9.0), ("k8", 601, 9.0)])
    S.stream_ewma(spark, stream(spark, folder), "k", "o", "v", root)
    changed = spark.read.format("statestore").option("readChangeFeed", "true").option("changeStartBatchId", 1)
    touched = [r for r in changed.load(f"{root}/checkpoint").collect() if r.batch_id == 1]
    assert sorted(r.key.k for r in touched) == ["k7", "k8"]


def test_idle_keys_are_forgotten(spark):
    folder, root = inbox(spark)
    put(spark, folder, [("idle", 1, 100.0), ("busy", 2, 1.0)])
    S.stream_ewma(spark, stream(spark, folder), "k", "o", "v", root, idle_ms=1500)
    time.sleep(2)
    put(spark, folder, [("busy", 3, 1.0)])
    got = S.stream_ewma(spark, stream(spark, folder), "k", "o", "v", root, idle_ms=1500)
    assert rows(got) == [("busy", 1.0, 2)]


def test_the_sessions_own_store_is_left_as_it_was(spark):
    before = [spark.conf.get(name, None) for name in S.STATE_STORE]
    with S.configured(spark, S.STATE_STORE):
        assert [spark.conf.get(name) for name in S.STATE_STORE] == list(S.STATE_STORE.values())
    assert [spark.conf.get(name, None) for name in S.STATE_STORE] == before


def test_dedupe_forgets_what_the_watermark_has_passed(spark):
    folder, root = inbox(spark)
    late = "timestamp '2024-01-01 00:00:00'"
    # the same key again within the delay, then long after it, when another row has moved the watermark
    for some in ([("a", 0), ("a", 1)], [("a", 1), ("a", 2)], [("b", 100)], [("a", 101), ("c", 0)]):
        df = spark.createDataFrame(some, "k string, h int")
        df.select("k", F.expr(f"{late} + make_interval(0, 0, 0, 0, h)").alias("ts")).write.mode("append").parquet(folder)
        source = spark.readStream.schema("k string, ts timestamp").parquet(folder)
        got = S.stream_dedupe(spark, source, ["k"], "ts", "5 hours", root)
    assert sorted(r.k for r in got.collect()) == ["a", "a", "b"]
    held = spark.read.format("statestore").load(f"{root}/checkpoint")
    assert sorted(r.key.k for r in held.collect()) == ["a", "b"]
