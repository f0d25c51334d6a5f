"""Block-wise operators against plain definitions, on hot keys and odd inputs."""

import math
import random

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators import aggregates as A
from lakeloom.operators import mapping as X
from lakeloom.operators import ordered as W
from lakeloom.operators import partitions as G
from lakeloom.operators.joins import aligned_join
from lakeloom.operators.ml import train_test_split
from lakeloom.operators.runlog import cost_prior, due_ticks, overlap_skips


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows share one key, and half of those one value."""
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        value = 5.0 if key == "hot" and i % 2 else round(rng.expovariate(0.01), 3)
        data.append((key, i, value))
    return data, spark.createDataFrame(data, "k string, o bigint, v double").cache()


def groups(data):
    out = {}
    for k, o, v in data:
        out.setdefault(k, []).append((o, v))
    return {k: [v for _, v in sorted(vs)] for k, vs in out.items()}


@pytest.mark.parametrize("block_rows", [7, 100, 100_000])
def test_running_fold(hot, block_rows):
    data, df = hot
    exact = df.withColumn("v", F.col("v").cast("decimal(18,4)"))
    got = {
        (r["k"], r["o"]): float(r["running"])
        for r in W.running_fold(exact, ["k"], "o", "v", block_rows=block_rows).collect()
    }
    assert len(got) == len(data)
    sums = {}
    for k, o, v in sorted(data, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0.0) + v
        assert math.isclose(got[k, o], sums[k], abs_tol=1e-6)


def fold(values, start=None):
    state = start
    for x in values:
        x = max(x, 0.0)
        if state is None:
            state = x
        elif x > state:
            state = 0.5 * x + 0.5 * state
        else:
            state = max(0.25 * x + 0.75 * state, 0.7 * state)
    return state


@pytest.mark.parametrize("block_rows", [1, 50, 400, 100_000])
def test_asym_ewma_any_block_size(hot, block_rows):
    data, df = hot
    got = {r["k"]: r for r in W.asym_ewma(df, "k", "o", "v", block_rows=block_rows).collect()}
    for k, values in groups(data).items():
        assert math.isclose(got[k]["estimate"], fold(values), rel_tol=1e-12)
        assert got[k]["samples"] == len(values)


def test_asym_ewma_continues(hot):
    data, df = hot
    first = W.asym_ewma(df.where("o < 1700"), "k", "o", "v")
    both = W.asym_ewma(df.where("o >= 1700"), "k", "o", "v", initial=first, block_rows=64)
    got = {r["k"]: (r["estimate"], r["samples"]) for r in both.collect()}
    for k, values in groups(data).items():
        assert math.isclose(got[k][0], fold(values), rel_tol=1e-12)
        assert got[k][1] == len(values)


def test_asym_ewma_published_steps(spark):
    df = spark.createDataFrame(
        [("up", 0, 1.0), ("up", 1, 10.0), ("down", 0, 10.0), ("down", 1, 0.01), ("neg", 0, -3.0)],
        "k string, o bigint, v double",
    )
    got = {r["k"]: r["estimate"] for r in W.asym_ewma(df, "k", "o", "v").collect()}
    assert got["up"] == pytest.approx(5.5)
    assert got["down"] == pytest.approx(7.5025)
    assert got["neg"] == 0.0


@pytest.mark.parametrize("block_rows", [5, 1_000_000])
def test_rank_select(hot, block_rows):
    data, df = hot
    picks = {"lo": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "hi": lambda n: n - 1}
    got = {r["k"]: r for r in W.rank_select(df, ["k"], "v", picks, block_rows).collect()}
    want = groups(data)
    assert set(got) == set(want)
    for k, values in want.items():
        s = sorted(values)
        assert (got[k]["n"], got[k]["lo"], got[k]["mid"], got[k]["hi"]) == (
            len(s), s[0], s[len(s) // 2], s[-1],
        )


def test_rank_select_constant_and_empty(spark):
    df = spark.createDataFrame([("a", 2.0)] * 9 + [("b", None)], "k string, v double")
    got = W.rank_select(df, ["k"], "v", {"m": lambda n: F.floor(n / 2)})
    assert rows(got, "k", "n", "m") == [("a", 9, 2.0)]
    assert W.rank_select(df.where("false"), ["k"], "v", {"m": lambda n: F.lit(0)}).count() == 0


@pytest.mark.parametrize("block_rows", [1, 1_000_000])
def test_rank_select_orders_every_double(spark, block_rows):
    """Signs, subnormal and infinite values, NaN as the largest, equal zeros, close neighbours, null keys."""
    values = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, 1.0 + 2**-52, -1.0, 0.1]
    data = [(k, v) for k in ("a", None) for v in values] + [("n", float("nan")), ("n", 1.0), ("n", None)]
    df = spark.createDataFrame(data, "k string, v double")
    picks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(len(values))}
    got = {r["k"]: r for r in W.rank_select(df, ["k"], "v", picks, block_rows).collect()}
    for key in ("a", None):
        assert got[key]["n"] == len(values)
        assert [got[key][name] for name in picks] == sorted(values)
    assert (got["n"]["n"], got["n"]["r0"], got["n"]["r2"]) == (2, 1.0, None)
    assert got["n"]["r1"] != got["n"]["r1"]


def test_overlap_skips_across_blocks(spark):
    rng = random.Random(5)
    runs = [("j", s, s + rng.randint(1, 80)) for s in sorted(rng.sample(range(1000), 60))]
    ticks = [("j", t) for t in rng.sample(range(1100), 300)] + [("other", 5)]
    got = overlap_skips(
        spark.createDataFrame(ticks, "schedule_id string, tick_at bigint"),
        spark.createDataFrame(runs, "schedule_id string, started_at bigint, finished_at bigint"),
        block_span=10,
    )
    got = {(r["schedule_id"], r["tick_at"]): r["action"] for r in got.collect()}
    for job, at in ticks:
        last = [f for j, s, f in runs if j == job and s < at]
        assert got[job, at] == ("skip" if last and last[-1] > at else "fire")


def test_ordered_digest_levels(spark):
    import hashlib

    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    df = spark.createDataFrame(list(enumerate(h)), "i bigint, h string").repartition(7)

    def tree(fanout):
        level = h
        for _ in range(4):
            level = [
                hashlib.sha256("".join(level[j : j + fanout]).encode()).hexdigest()
                for j in range(0, len(level), fanout)
            ]
        return level[0]

    whole = A.ordered_digest(df, "i", "h").first()
    assert whole["combined_hash"] == tree(65_536)
    assert whole["count"] == 50
    assert A.ordered_digest(df, "i", "h", fanout=4).first()["combined_hash"] == tree(4)
    assert A.ordered_digest(df.where("false"), "i", "h").count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 333])
def test_split_is_exact(spark, n):
    df = spark.range(n).toDF("id")
    got = train_test_split(df, "id")
    assert got.where("split = 'train'").count() == int(n * 0.8)
    assert got.count() == n == got.select("id").distinct().count()


def test_partition_combos(spark):
    a = spark.createDataFrame([(x,) for x in "abca"], "a string")
    b = spark.range(5).toDF("b")
    c = spark.createDataFrame([("x",), ("y",)], "c string")
    got = rows(G.partition_combos({"a": a, "b": b, "c": c}), "a", "b", "c")
    assert got == sorted([(i, j, k) for i in "abc" for j in range(5) for k in "xy"], key=repr)
    assert G.partition_combos({"a": a, "b": b.where("false")}).count() == 0


@pytest.mark.parametrize("span", [1, 2, 5])
def test_partition_combos_by_spans(spark, monkeypatch, span):
    monkeypatch.setattr(G, "SPAN", span)
    a, b = spark.createDataFrame([("x",), ("y",)], "a string"), spark.range(5).toDF("b")
    assert rows(G.partition_combos({"a": a, "b": b}), "a", "b") == [(i, j) for i in "xy" for j in range(5)]


def test_dense_position(spark):
    got = G.dense_position(spark.range(500).toDF("x"), "x").select("position").collect()
    assert sorted(r[0] for r in got) == list(range(500))


def test_collect_list_chunks(spark):
    df = spark.range(100).select(F.lit("p").alias("p"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    got = G.collect_list_by(df.repartition(5), "p", "o", "v", chunk_rows=30).orderBy("chunk").collect()
    assert [len(r["items"]) for r in got] == [30, 30, 30, 10]
    assert [x for r in got for x in r["items"]] == [2 * i for i in range(100)]


def test_aligned_join_rejects_duplicate_keys(spark):
    left = spark.createDataFrame([("a", 1)], "k string, x int")
    right = spark.createDataFrame([("a", 1), ("a", 2)], "k string, y int")
    with pytest.raises(Exception, match="partition key is not unique"):
        aligned_join(left, right, ["k"]).collect()


def test_cost_prior_levels(spark):
    est = spark.createDataFrame(
        [("a[1]", "a", 1.0), ("a[2]", "a", 9.0), ("a[3]", "a", 4.0), ("a[4]", "a", 5.0)],
        "node_id string, base_id string, estimate_seconds double",
    )
    nodes = spark.createDataFrame(
        [("a[1]", "a"), ("a[9]", "a"), ("b[1]", "b")], "node_id string, base_id string"
    )
    got = {r["node_id"]: r["estimate_seconds"] for r in cost_prior(nodes, est).collect()}
    assert got == {"a[1]": 1.0, "a[9]": 5.0, "b[1]": 30.0}


def test_due_ticks_spans(spark):
    s = spark.createDataFrame([("a", 1, 0), ("b", 7, 3)], "schedule_id string, period_s bigint, offset_s bigint")
    got = due_ticks(s, F.lit(9_990), F.lit(30_010))
    want = {("a", t) for t in range(9_990, 30_011)} | {
        ("b", t) for t in range(9_990, 30_011) if t % 7 == 3
    }
    assert {tuple(r) for r in got.collect()} == want


def test_map_by_key_calls(hot):
    data, df = hot

    def size(key, pdf):
        assert set(pdf["k"]) == {key[0]}
        return pd.DataFrame({"k": [key[0]], "n": [len(pdf)], "total": [pdf["o"].sum()]})

    got = rows(X.map_by_key(df, ["k"], size, "k string, n bigint, total bigint"))
    assert got == sorted(
        ((k, len(values), sum(o for kk, o, _ in data if kk == k)) for k, values in groups(data).items()), key=repr
    )


def test_functions_of_whole_keys_get_one_call_at_any_size(spark):
    df = spark.range(100_001).select(F.lit("k").alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([("k", 1)], "k string, y bigint")

    def median(key, pdf, row=None):
        return pd.DataFrame({"k": [key[0]], "n": [len(pdf)], "m": [float(pdf["x"].median())]})

    schema = "k string, n bigint, m double"
    for got in (X.map_by_key(df, ["k"], median, schema), X.map_aligned(df, right, ["k"], median, schema)):
        assert rows(got) == [("k", 100_001, 50_000.0)]


def test_partial_functions_get_slices_at_any_size(spark):
    def size(key, pdf):
        return pd.DataFrame({"k": [key[0]], "n": [len(pdf)]})

    for n in (10, 1000):
        df = spark.range(n).select(F.lit("k").alias("k"), F.col("id").alias("x"))
        merge = {"calls": F.count(F.lit(1)), "n": F.sum("n")}
        (got,) = X.collect_udaf(df, ["k"], size, "k string, n bigint", merge, slices=4).collect()
        assert 1 < got["calls"] <= 4 and got["n"] == n
    with pytest.raises(ValueError):
        X.collect_udaf(df, ["k"], size, "k string, n bigint", {})


def test_map_aligned_missing_right(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x bigint")
    right = spark.createDataFrame([("a", "A"), ("c", "C")], "k string, y string")

    def join(key, rows_, row):
        return pd.DataFrame(
            {"k": [key[0]], "n": [len(rows_)], "y": [row["y"].iloc[0] if len(row) else None]}
        )

    got = X.map_aligned(left, right, ["k"], join, "k string, n bigint, y string")
    assert rows(got, "k", "n", "y") == [("a", 2, "A"), ("b", 1, None)]


@pytest.fixture(scope="module")
def sides(spark):
    """Two sides of several rows a key, with keys larger than a batch, null, not a number and beyond doubles."""
    big = 2**53 + 1
    left = [(1, 1.0, big + i, "x") for i in range(25_000)] + [(2, 2.0, 5, None), (None, float("nan"), 6, "n"), (None, float("nan"), 7, "n")]
    right = [(1, 1.0, "r", i) for i in range(21_000)] + [(None, float("nan"), "s", big), (3, 3.0, "t", 1), (big, 3.0, "u", 1), (big + 1, 3.0, "v", 1)]
    return (
        spark.createDataFrame(left, "a bigint, b double, x bigint, y string").repartition(5),
        spark.createDataFrame(right, "a bigint, b double, y string, z bigint").repartition(3),
    )


def test_aligned_sides_of_any_size_get_one_call(sides):
    left, right = sides

    def sizes(key, ours, other):
        assert list(ours.columns) == ["a", "b", "x", "y"] and list(other.columns) == ["a", "b", "y", "z"]
        return pd.DataFrame({"a": [key[0]], "n": [len(ours)], "m": [len(other)], "x": [ours["x"].sum()], "z": [other["z"].sum()]})

    schema, big = "a bigint, n bigint, m bigint, x string, z bigint", 2**53 + 1
    exact = lambda key, ours, other: sizes(key, ours, other).assign(x=[str(sum(map(int, ours["x"])))])
    want = [
        (None, 2, 1, 13, big),
        (1, 25_000, 21_000, sum(big + i for i in range(25_000)), sum(range(21_000))),
        (2, 1, 0, 5, 0),
    ]
    alone = [(3, 0, 1, 0, 1), (big, 0, 1, 0, 1), (big + 1, 0, 1, 0, 1)]
    got = [(r.a, r.n, r.m, int(r.x), r.z) for r in X.map_aligned(left, right, ["a", "b"], exact, schema).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    got = [(r.a, r.n, r.m, int(r.x), r.z) for r in X.map_aligned(left, right, ["a", "b"], exact, schema, "full").collect()]
    assert sorted(got, key=repr) == sorted(want + alone, key=repr)


def test_aligned_batches_are_bounded(sides):
    left, right = sides

    def sizes(key, batches, other):
        for batch in batches:
            assert len(batch) <= 10_000
            yield pd.DataFrame({"a": [key[0]], "n": [len(batch)], "m": [len(other)]})
            if key[0] is None:
                return  # what is left of a key is passed over

    got = X.map_aligned_batches(left, right, ["a", "b"], sizes, "a bigint, n bigint, m bigint").collect()
    assert sum(r.n for r in got if r.a == 1) == 25_000 and {r.m for r in got if r.a == 1} == {21_000}
    assert sorted((r.a, r.n, r.m) for r in got if r.a not in (1, None)) == [(2, 1, 0)]
    assert len([r for r in got if r.a == 1]) >= 3
    with pytest.raises(ValueError):
        X.map_aligned_batches(left, right, ["a"], sizes, "a bigint", "inner")


def test_chunks_follow_the_order_at_any_size(spark):
    for orders in ([0, 5, 10], [0, 5, 10, 11]):
        df = spark.createDataFrame([("p", o, o) for o in orders], "p string, o bigint, v bigint")
        got = G.collect_list_by(df, "p", "o", "v", chunk_rows=3).collect()
        assert {r["chunk"] for r in got} == {o // 3 for o in orders}


def test_running_fold_does_not_depend_on_blocks(spark):
    rows_ = [("k", i, None if i in (0, 4, 5, 9) else 0.1 * i) for i in range(12)] + [("k", 3, 0.7)]
    df = spark.createDataFrame(rows_, "k string, o bigint, v double")
    got = [
        [None if r[0] is None else round(r[0], 9) for r in W.running_fold(df, ["k"], "o", "v", block_rows=n).orderBy("o", "v").select("running").collect()]
        for n in (1, 2, 100)
    ]
    assert got[0] == got[1] == got[2] and got[0][0] is None


def test_expand_keys_keeps_strings_and_numbers(spark):
    from lakeloom.operators.mapping import expand_keys

    df = spark.createDataFrame([('["a","[x]","{y}",1,true,null,{"z":1},[2],2.5]',)], "j string")
    assert [r["key"] for r in expand_keys(df, "j").collect()] == ["a", "[x]", "{y}", "1", "2.5"]


def test_step_ids_keep_blanks_and_the_last_of_a_name(spark):
    df = spark.createDataFrame([("b[a=1,c=x ]",), ("b[a=1,a=2,c=3]",)], "t string")
    got = [r[0]["keys"] for r in df.select(G.parse_step_id(F.col("t"))).collect()]
    assert got == [{"a": "1", "c": "x "}, {"a": "2", "c": "3"}]


def test_small_keys_get_two_calls_and_large_ones_more(spark, monkeypatch):
    """Keys of 40 rows had up to 40 calls each; a large null key is spread like any other."""
    monkeypatch.setattr(X, "SLICE_ROWS", 1000)
    df = spark.range(400).select(F.col("id").alias("k") % 10, F.col("id").alias("x")).toDF("k", "x")
    df = df.unionByName(spark.range(30_000).select(F.lit(None).cast("bigint").alias("k"), F.col("id").alias("x")))

    def size(key, pdf):
        assert list(pdf.columns) == ["k", "x"]
        return {"k": [key[0]], "n": [len(pdf)], "total": [pdf["x"].sum()]}

    merge = {"calls": F.count(F.lit(1)), "n": F.sum("n"), "total": F.sum("total"), "most": F.max("n")}
    got = {r.k: r for r in X.collect_udaf(df, ["k"], size, "k bigint, n bigint, total bigint", merge).collect()}
    assert len(got) == 11 and all(got[k].n == 40 and 1 < got[k].calls <= 2 for k in range(10))
    assert all(got[k].total == sum(range(k, 400, 10)) for k in range(10))
    null = got[None]
    assert null.n == 30_000 and null.total == sum(range(30_000)) and null.calls == 30 and null.most < 2000


def test_functions_return_frames_or_columns(spark):
    big = 2**53 + 1
    data = [(k, big + i, None if i == 1 else float(i)) for k in "abc" for i in range(3)]
    df = spark.createDataFrame(data, "k string, x bigint, y double")

    def plain(key, pdf, other=None):
        if key[0] == "a":
            return {"y": [], "k": [], "x": []}  # no rows
        if key[0] == "b":
            return pdf[["y", "x", "k"]]
        return {"y": pdf["y"].to_numpy(), "k": ["c", None, "c"], "x": [None, *pdf["x"].iloc[1:]]}

    want = sorted([r for r in data if r[0] == "b"] + [("c", None, 0.0), (None, big + 1, None), ("c", big + 2, 2.0)], key=repr)
    schema = "k string, x bigint, y double"
    assert rows(X.map_by_key(df.repartition(1), ["k"], plain, schema)) == want
    assert rows(X.map_aligned(df, df.select("k"), ["k"], plain, schema)) == want
