"""Run, reuse, perturb and refresh cycles."""

import hashlib
import random

from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators import incremental as I
from lakeloom.operators.partitions import key_suffix, parse_step_id, step_id


def totals(df):
    return df.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


def tokens(df):
    return I.partition_digest(df, ["k"], ["k", "v"])


def frame(spark, data):
    return spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v bigint")


def test_random_refresh_cycles_equal_full_recompute(spark):
    rng = random.Random(7)
    data = {f"k{i}": [rng.randint(0, 50) for _ in range(rng.randint(1, 6))] for i in range(8)}
    old = frame(spark, data)
    previous, recorded = totals(old), tokens(old)
    for _ in range(4):
        # nothing changed: nothing is stale
        same = frame(spark, {k: rng.sample(vs, len(vs)) for k, vs in data.items()})
        assert I.stale_partitions(tokens(same), recorded, ["k"]).count() == 0
        # one key changes, one leaves, one arrives
        changed, gone = rng.sample(sorted(data), 2)
        data = dict(data)
        data[changed] = [*data[changed], rng.randint(100, 200)]
        del data[gone]
        arrived = f"n{rng.randint(0, 10**6)}"
        data[arrived] = [1, 2]
        now = frame(spark, data)
        stale = I.stale_partitions(tokens(now), recorded, ["k"])
        assert {r["k"] for r in stale.collect()} == {changed, arrived}
        calls = []

        def compute(df, calls=calls):
            calls.append({r["k"] for r in df.select("k").distinct().collect()})
            return totals(df)

        out = I.incremental_refresh(now, tokens(now), recorded, previous, ["k"], compute)
        assert rows(out, "k", "total", "n") == rows(totals(now), "k", "total", "n")
        assert calls == [{changed, arrived}]
        previous, recorded = totals(now), tokens(now)


def test_token_sees_multiplicity_and_null(spark):
    one = tokens(frame(spark, {"a": [1, 2]})).first()["token"]
    two = tokens(frame(spark, {"a": [1, 2, 2]})).first()["token"]
    null = tokens(frame(spark, {"a": [1, None]})).first()["token"]
    assert len({one, two, null}) == 3


def expected_run_hash(definition, partition, upstream, params):
    text = f"run:1.0.0\n{definition}\n"
    if partition is not None:
        text += f"partition:{partition}\n"
    text += "".join(f"upstream:{u}\n" for u in sorted(upstream))
    if params is not None:
        text += f"params:{params}\n"
    return hashlib.sha256(text.encode()).hexdigest()


def fan_in_token(ids):
    digests = [hashlib.sha256(i.encode()).hexdigest() for i in ids]
    sums = [sum(int(d[k : k + 15], 16) for d in digests) for k in (0, 15, 30, 45)]
    return hashlib.sha256("-".join(map(str, [len(ids), *sums])).encode()).hexdigest()


def test_run_fingerprint_protocol_and_order(spark):
    steps = spark.createDataFrame(
        [("s", "d", "t=X", None), ("r", "d", None, "{}"), ("alone", "d", None, None)],
        "step string, definition_hash string, partition string, params string",
    )
    pairs = [("s", "b"), ("s", "a"), ("s", "c"), ("r", "x")]
    want = {
        "s": expected_run_hash("d", "t=X", [fan_in_token(["a", "b", "c"])], None),
        "r": expected_run_hash("d", None, [fan_in_token(["x"])], "{}"),
        "alone": expected_run_hash("d", None, [], None),
    }
    for order in (pairs, pairs[::-1]):
        df = spark.createDataFrame(order, "step string, upstream string")
        got = I.run_fingerprint(steps, df, "step", "upstream")
        assert {r["step"]: r["run_hash"] for r in got.collect()} == want


def test_wide_fan_in_stays_bounded_and_sensitive(spark):
    steps = spark.createDataFrame([("s", "d")], "step string, definition_hash string")

    def hash_of(ids):
        df = spark.createDataFrame([("s", i) for i in ids], "step string, upstream string")
        lists = I.gather_upstream(df, "step", "upstream")
        return lists.first(), I.run_fingerprint(steps, df, "step", "upstream").first()[
            "run_hash"
        ]

    ids = [f"u{i}" for i in range(500)]
    lists, base = hash_of(ids)
    assert lists["n_upstream"] == 500
    assert all(len(x) == 64 for x in lists["upstream_ids"])
    assert hash_of(ids[::-1])[1] == base
    assert hash_of(ids[:-1])[1] != base
    assert hash_of([*ids[:-1], "other"])[1] != base


def test_reverted_definition_hits_old_artifact_and_failures_never_do(spark):
    log = spark.createDataFrame(
        [("n", "A", "success", 1), ("n", "B", "success", 2), ("n", "C", "failed", 3)],
        "node_id string, run_hash string, status string, id bigint",
    )
    steps = spark.createDataFrame(
        [("n", "A"), ("n", "C"), ("n", "D")], "node_id string, run_hash string"
    )
    got = {r["run_hash"]: (r["hit"], r["artifact_id"]) for r in I.cache_lookup(steps, log).collect()}
    assert got == {"A": (True, 1), "C": (False, None), "D": (False, None)}


def test_step_id_round_trip(spark):
    df = spark.createDataFrame(
        [
            ("f.py:x", {}),
            ("f.py:x", {"b": "2", "a": "1"}),
            ("d/f.py:y", {"k": "one,two,three"}),
            ("f.py:z", {"k": "a,b", "m": "c=d"}),
        ],
        "base string, keys map<string,string>",
    )
    out = df.withColumn("id", step_id(F.col("base"), F.col("keys")))
    back = out.withColumn("p", parse_step_id(F.col("id"))).select(
        "base", key_suffix(F.col("keys")).alias("s"),
        "id", "p.base", key_suffix(F.col("p.keys")).alias("t"),
    )
    for base, suffix, text, got_base, got in (tuple(r) for r in back.collect()):
        assert text == (f"{base}[{suffix}]" if suffix else base)
        assert (got_base, got) == (base, suffix)


def test_key_predicate_covers_nulls_and_limits(spark):
    from lakeloom.operators.partitions import key_predicate, restrict

    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, v int")
    wanted = spark.createDataFrame([("a",), (None,)], "k string")
    named = key_predicate(wanted, ["k"])
    assert rows(df.where(named), "v") == [(1,), (3,)]
    assert rows(df.where(~named), "v") == [(2,), (4,)]
    assert df.where(key_predicate(wanted.where("false"), ["k"])).count() == 0
    assert key_predicate(wanted, ["k"], limit=1) is None
    pairs = spark.createDataFrame([("a", 1), ("c", 9)], "k string, v int")
    assert rows(restrict(df, pairs, ["k", "v"])) == [("a", 1)]


def test_refresh_equals_recompute_with_null_keys(spark):
    """Around and far above the number of keys that a literal predicate names."""
    from lakeloom.operators.partitions import restrict

    for n in (3, 999, 1000, 1001, 1500):
        new = spark.range(n * 2).select(F.when(F.col("id") > 0, (F.col("id") / 2).cast("int")).alias("k"), "id")
        compute = lambda df: df.groupBy("k").agg(F.sum("id").alias("s"))
        tokens = new.groupBy("k").agg(F.sum("id").cast("string").alias("token"))
        old = tokens.withColumn("token", F.when(F.col("k") < 2, F.col("token")).otherwise("old"))
        got = I.incremental_refresh(new, tokens, old, compute(new), ["k"], compute)
        assert sorted(got.collect(), key=repr) == sorted(compute(new).collect(), key=repr)
        assert restrict(new, tokens, ["k"]).count() == n * 2
