"""Graph walks against networks small enough to reason about."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakeloom.operators import lineage as L


def graph(spark, edges):
    return spark.createDataFrame(
        [(u, d, k) for u, d, k in edges], "upstream string, downstream string, kind string"
    )


def names(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node_id string")


CHAIN = [("a", "b", "data"), ("b", "c", "data")]


@pytest.mark.parametrize("changed,stale", [("c", 1), ("b", 2), ("a", 3)])
def test_chain_staleness(spark, changed, stale):
    assert L.stale_propagation(graph(spark, CHAIN), names(spark, changed)).count() == stale


def test_failure_skips_data_edges_only(spark):
    edges = graph(
        spark,
        [("a", "b", "data"), ("a", "o", "ordering"), ("b", "p", "ordering"), ("b", "c", "data"), ("o", "x", "data")],
    )
    nodes = names(spark, *"abcopx")
    got = dict(rows(L.failure_cascade(edges, nodes, names(spark, "a"))))
    assert got == {
        "a": "failed", "b": "skipped", "c": "skipped", "o": "success", "p": "success", "x": "success",
    }


def test_random_dag_against_python(spark):
    rng = random.Random(11)
    edges = {(i, j) for j in range(1, 40) for i in rng.sample(range(j), min(j, rng.randint(0, 3)))}
    df = spark.createDataFrame(sorted(edges), "upstream bigint, downstream bigint")
    nodes = spark.range(40).toDF("node_id")
    level = {}
    for n in range(40):
        level[n] = max((level[u] + 1 for u, d in edges if d == n), default=0)
    assert dict(rows(L.topo_level(df, nodes))) == level
    reach = {5}
    for n in range(40):
        if any(u in reach for u, d in edges if d == n):
            reach.add(n)
    seeds = spark.createDataFrame([(5,)], "node_id bigint")
    assert {r[0] for r in L.downstream_closure(df, seeds).collect()} == reach
    assert rows(L.cycle_nodes(df)) == []


def test_cycles_end_and_are_found(spark):
    edges = graph(
        spark,
        [("s", "a", "data"), ("a", "b", "data"), ("b", "c", "data"), ("c", "a", "data"), ("c", "t", "data")],
    )
    assert {r[0] for r in L.downstream_closure(edges, names(spark, "a")).collect()} == set("abct")
    assert rows(L.cycle_nodes(edges)) == [("a", "c"), ("b", "c"), ("c", "c")]
    with pytest.raises(ValueError):
        L.topo_level(edges, names(spark, *"sabct"))


def test_validate(spark):
    nodes = spark.createDataFrame(
        [("a", "asset"), ("t", "task"), ("s", "sensor"), ("a", "asset"), ("u", "task")],
        "node_id string, kind string",
    )
    edges = spark.createDataFrame(
        [("t", "a"), ("a", "s"), ("ghost", "a"), ("t", "u"), ("a", "lost")], "upstream string, downstream string"
    )
    assert rows(L.validate_edges(nodes, edges)) == sorted(
        [
            ("duplicate_key", "a"),
            ("task_as_input", "t->a"),
            ("sensor_with_inputs", "a->s"),
            ("unresolved_input", "ghost->a"),
            ("unresolved_node", "a->lost"),
        ]
    )


def numbered(spark, edges):
    return spark.createDataFrame(sorted(edges), "upstream bigint, downstream bigint")


def reached(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        node = todo.pop()
        for u, d in edges:
            if u == node and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def jobs_of(spark, run):
    """What ``run`` returns, and the number of jobs that took."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    return out, n


@pytest.mark.parametrize("seed", range(3))
def test_deep_graphs_with_cycles_against_python(spark, seed, monkeypatch):
    # few hops before what is left is condensed, again and again
    monkeypatch.setattr(L, "HOPS", 1)
    monkeypatch.setattr(L, "JOBS", 2)
    rng = random.Random(seed)
    n = 60
    edges = {(i, i + 1) for i in range(n) if rng.random() < 0.93}
    edges |= {(rng.randrange(n), rng.randrange(n)) for _ in range(14)}
    seeds = rng.sample(range(n), 2)
    df, start = numbered(spark, edges), spark.createDataFrame([(s,) for s in seeds], "node_id bigint")
    assert {r[0] for r in L.downstream_closure(df, start).collect()} == reached(edges, seeds)
    assert {r[0] for r in L.upstream_closure(df, start).collect()} == reached({(d, u) for u, d in edges}, seeds)


@pytest.mark.parametrize("seed", range(2))
def test_deep_levels_against_python(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "LAYERS", 2)
    rng = random.Random(seed)
    edges = {(i, i + 1) for i in range(50) if rng.random() < 0.9} | {(a, b) for a, b in (sorted(rng.sample(range(51), 2)) for _ in range(15))}
    level = {}
    for node in range(51):
        level[node] = max((level[u] + 1 for u, d in edges if d == node), default=0)
    got = L.topo_level(numbered(spark, edges), spark.range(51).toDF("node_id"))
    assert dict(rows(got)) == level
    with pytest.raises(ValueError):
        L.topo_level(numbered(spark, edges | {(50, 0), (0, 1), (49, 50)} | {(i, i + 1) for i in range(50)}), spark.range(51).toDF("node_id"))


def test_a_long_chain_takes_few_jobs(spark):
    chain = spark.range(2000).select(F.col("id").alias("upstream"), (F.col("id") + 1).alias("downstream"))
    seed = spark.createDataFrame([(3,)], "node_id bigint")
    got, jobs = jobs_of(spark, lambda: L.downstream_closure(chain, seed).count())
    assert got == 1998 and jobs < 200
    got, jobs = jobs_of(spark, lambda: L.topo_level(chain, seed).agg(F.max("level")).first()[0])
    assert got == 2000 and jobs < 400


@pytest.mark.parametrize("seed", range(2))
def test_exactly_the_nodes_on_cycles(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(52)} | {(100, 101), (101, 100), (101, 102), (102, 103), (103, 104), (104, 103)}
    found = {}
    for node in {x for e in edges for x in e}:
        after = reached(edges, [d for u, d in edges if u == node])
        if node in after:
            same = {m for m in after if node in reached(edges, [m])}
            found[node] = max(same | {node})
    assert 102 not in found
    assert dict(rows(L.cycle_nodes(numbered(spark, edges)))) == found


def test_empty_graph(spark):
    empty = spark.createDataFrame([], "upstream string, downstream string")
    assert L.topo_level(empty, names(spark, "x").where(F.lit(False))).count() == 0
    assert rows(L.topo_level(empty, names(spark, "x"))) == [("x", 0)]
    assert L.validate_edges(spark.createDataFrame([], "node_id string, kind string"), empty).count() == 0


def test_large_walks_and_marks_are_not_broadcast(spark, monkeypatch):
    """Small files of many nodes were broadcast by way of the driver at every hop."""
    from lakeloom.operators import incremental as I
    from lakeloom.session import materialize

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = []
    write = L.write_table
    monkeypatch.setattr(L, "write_table", lambda df, path: plans.append(plan(df)) or write(df, path))
    edges = materialize(spark.range(1, 300).select((F.col("id") - 1).alias("upstream"), F.col("id").alias("downstream")), "edges")
    seeds = spark.createDataFrame([(100,), (250,)], "node_id bigint")
    want = [(i,) for i in range(100, 300)]
    for large in (10**6, -1):
        monkeypatch.setattr(L, "LARGE", large)
        plans.clear()
        assert sorted(tuple(r) for r in L.downstream_closure(edges, seeds).collect()) == want
        # a row a level: the first level is the seeds, the others join
        assert len(plans) > 1 and any("BroadcastHashJoin" in p for p in plans) == (large > 0)
    nodes = materialize(
        spark.range(6).select(F.col("id").alias("node_id"), (F.col("id") > 0).alias("active"), F.lit("always").alias("freshness"), F.lit(True).alias("window_open")),
        "nodes",
    )
    some = lambda *ids: materialize(spark.createDataFrame([(i,) for i in ids], "node_id bigint"), "some")
    got = I.refresh_eligibility(nodes, some(0, 1, 2, 3, 3), some(2, 5), some(3))
    assert "Broadcast" not in plan(got)
    waiting = "stale_waiting_for_upstream"
    assert sorted(tuple(r) for r in got.collect()) == [
        (0, "historical"), (1, "runnable_stale"), (2, waiting), (3, waiting), (4, "fresh"), (5, "fresh")
    ]
