"""Closures and propagation over edge tables.

A walk goes level by level, several hops a job. A graph it has not come through
after some jobs is deep, and what is left of it is condensed: a node that only one
other leads to is reached exactly if that one is, or if it is a seed. The first
node above it that several or none lead to, its head, is found for all nodes at
once by doubling pointers, in a number of jobs that grows with the logarithm of
the depth. The walk goes on over the heads and condenses again if that is still
deep; a chain or a ladder of diamonds is gone after that, however long.

Every step writes its rows to a scratch table, so plans stay small and a lost
executor costs one step. Joins of large graphs are sorted and merged, not broadcast,
so nothing but counts and small sides reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.session import materialize, scratch_path, write_table

#: Hops of a level-wise walk in one job, and jobs before what is left is condensed.
HOPS, JOBS = 5, 5
#: Layers that are peeled before what is left is condensed.
LAYERS = 24
#: Hops of a graph that is not broadcast any more.
LARGE = 200_000


def _side(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How joins take a side that comes from a written ``table``: never broadcast if that is large.

    A file of node numbers is many times smaller than its rows in memory, and the
    optimizer sees the file. Every broadcast passes through the driver.
    """
    large = table.count() > LARGE
    return lambda df: df.hint("merge") if large else df


def _hops(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node_id, next) without repeats and loops of one edge."""
    hops = edges.select(F.col(source).alias("node_id"), F.col(target).alias("next"))
    return hops.where(F.col("node_id") != F.col("next")).distinct()


def _heads(single: DataFrame) -> DataFrame:
    """(node_id, head, hit, steps) from (node_id, up, hit, steps): each node's way up to a head.

    ``up`` is the one node before it. A head has no such row. ``hit`` holds if any
    node of the way, the head excepted, has it; ``steps`` add up along the way.
    Nodes whose way never ends, on or below a cycle, get a head among themselves
    and null ``steps``; their ``hit`` has gone round the cycle.
    """
    ways = materialize(single.withColumn("done", F.lit(False)), "ways")
    most, length, side = ways.count(), 1, _side(ways)

    def doubled(ways: DataFrame) -> DataFrame:
        above = ways.select(
            F.col("node_id").alias("up"), F.col("up").alias("_up"), F.col("hit").alias("_hit"),
            F.col("steps").alias("_steps"), F.col("done").alias("_done"),
        )
        return ways.join(side(above), "up", "left").select(
            "node_id",
            F.coalesce("_up", "up").alias("up"),
            (F.col("hit") | F.coalesce("_hit", F.lit(False))).alias("hit"),
            (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.coalesce("_done", F.lit(True)).alias("done"),
        )

    while length <= most and not ways.where("not done").isEmpty():
        ways = materialize(doubled(doubled(ways)), "ways")
        length *= 4
    return ways.select("node_id", F.col("up").alias("head"), "hit", F.when(F.col("done"), F.col("steps")).alias("steps"))


def _levels(
    hops: DataFrame, seeds: DataFrame, side: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame | None]:
    """Nodes found from ``seeds`` by walking level by level, and those to go on from, or None at the end."""
    spark = hops.sparkSession
    root, paths = scratch_path(spark, "reached"), []
    frontier = seeds
    for _ in range(JOBS):
        paths.append(f"{root}/level_{len(paths)}")
        level = write_table(frontier, paths[-1])
        if level.isEmpty():
            return spark.read.schema(seeds.schema).parquet(*paths), None
        found, every = level, None
        for _ in range(HOPS):
            # each hop is taken once at most, so rows that repeat need no shuffle before the last step
            found = hops.join(side(found), "node_id", "left_semi").select(F.col("next").alias("node_id"))
            every = found if every is None else every.unionByName(found)
        seen = spark.read.schema(seeds.schema).parquet(*paths)
        frontier = every.distinct().join(side(seen), "node_id", "left_anti")
    return seen, materialize(frontier, "frontier")


def _reach(hops: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from ``seeds`` (node_id, distinct) over distinct ``hops``, seeds included."""
    hops = materialize(hops, "hops")
    side = _side(hops)
    seen, frontier = _levels(hops, seeds, side)
    if frontier is None:
        return seen
    beyond = hops.join(side(seen), "node_id", "left_anti").join(
        side(seen.select(F.col("node_id").alias("next"))), "next", "left_anti"
    )
    return materialize(seen.unionByName(_condensed(beyond.select("node_id", "next"), frontier)), "reached")


def _condensed(hops: DataFrame, seeds: DataFrame) -> DataFrame:
    """As :func:`_reach`, by way of the heads of all nodes that one other leads to."""
    hops = materialize(hops, "hops")
    side = _side(hops)
    into = hops.groupBy(F.col("next").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("up"))
    marks = seeds.withColumn("hit", F.lit(True))
    single = into.where("n = 1").join(side(marks), "node_id", "left").select(
        "node_id", "up", F.coalesce("hit", F.lit(False)).alias("hit"), F.lit(1).cast("bigint").alias("steps")
    )
    ways = _heads(single)
    # what leads to a node of several ways starts at a head, or is known to be reached
    joint = hops.join(side(ways.select(F.col("node_id").alias("next"))), "next", "left_anti").join(side(ways), "node_id", "left")
    joint = materialize(joint.select(F.coalesce("head", "node_id").alias("node_id"), "next", "hit").distinct(), "joint")
    sure = seeds.join(side(ways), "node_id", "left_anti").unionByName(joint.where("hit").select(F.col("next").alias("node_id")))
    heads = _reach(joint.select("node_id", "next").where("node_id <> next").distinct(), sure.distinct())
    below = ways.join(side(heads.select(F.col("node_id").alias("head"), F.lit(True).alias("_in"))), "head", "left")
    below = below.where("hit or _in").select("node_id")
    return heads.unionByName(below).unionByName(seeds).distinct()


def _walk(edges: DataFrame, seeds: DataFrame, source: str, target: str) -> DataFrame:
    """Nodes reachable from ``seeds`` (column node_id), seeds included."""
    return _reach(_hops(edges, source, target), seeds.select("node_id").distinct())


def upstream_closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets and all their ancestors: what has to run for the targets."""
    return _walk(edges, targets, "downstream", "upstream")


def downstream_closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources and everything they reach: the impact set."""
    return _walk(edges, sources, "upstream", "downstream")


def stale_propagation(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Stale nodes, marked ``changed`` themselves or ``inherited``."""
    stale = downstream_closure(edges, changed)
    own = changed.select("node_id").distinct().withColumn("_own", F.lit(True))
    return stale.join(own.hint("merge"), "node_id", "left").select(
        "node_id", F.when(F.col("_own"), "changed").otherwise("inherited").alias("cause")
    )


def _peeled(hops: DataFrame, roots: DataFrame) -> tuple[DataFrame, bool]:
    """(node_id, level) of nodes by longest ways over ``hops`` (node_id, next, steps), peeled layer by layer.

    A node's level is known once all hops to it have been taken. Every node and
    every hop is written once. Ends after some layers; whether nothing is left.
    """
    spark = hops.sparkSession
    need = materialize(hops.groupBy("next").agg(F.count(F.lit(1)).alias("need")), "need")
    root, taken, known = scratch_path(spark, "peeled"), [], []
    frontier = roots.withColumn("level", F.lit(0).cast("bigint"))
    while True:
        known.append(f"{root}/known_{len(known)}")
        layer = write_table(frontier, known[-1])
        over = layer.isEmpty()
        if over or len(known) > LAYERS:
            return spark.read.schema(layer.schema).parquet(*known), over
        ways = hops.join(layer, "node_id").select("next", (F.col("level") + F.col("steps")).alias("level"))
        taken.append(f"{root}/taken_{len(taken)}")
        ways = write_table(ways, taken[-1])
        so_far = spark.read.schema(ways.schema).parquet(*taken).join(ways.select("next").distinct(), "next", "left_semi")
        counted = so_far.groupBy("next").agg(F.count(F.lit(1)).alias("n"), F.max("level").alias("level"))
        frontier = counted.join(need, "next").where("n = need").select(F.col("next").alias("node_id"), "level")


def _longest(hops: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, level) of all nodes over ``hops`` (node_id, next, steps) that no cycle lies before."""
    hops = materialize(hops.groupBy("node_id", "next").agg(F.max("steps").alias("steps")), "hops")
    known, over = _peeled(hops, roots)
    if over:
        return known
    # hops from peeled nodes become longer ones from one root; the root's level is 0
    first = roots.agg(F.min("node_id").alias("_root"))
    beyond = hops.join(known.select(F.col("node_id").alias("next")), "next", "left_anti").join(known, "node_id", "left")
    beyond = beyond.crossJoin(F.broadcast(first)).select(
        F.when(F.col("level").isNull(), F.col("node_id")).otherwise(F.col("_root")).alias("node_id"),
        "next",
        (F.col("steps") + F.coalesce("level", F.lit(0))).alias("steps"),
    )
    rest = _condensed_levels(beyond, first.select(F.col("_root").alias("node_id")))
    return materialize(known.unionByName(rest.join(known, "node_id", "left_anti")), "levels")


def _condensed_levels(hops: DataFrame, root: DataFrame) -> DataFrame:
    """As :func:`_longest`, by way of the heads of all nodes that one other leads to."""
    hops = materialize(hops.groupBy("node_id", "next").agg(F.max("steps").alias("steps")), "hops")
    into = hops.groupBy("next").agg(
        F.count(F.lit(1)).alias("n"), F.min("node_id").alias("up"), F.min("steps").alias("steps")
    )
    single = into.where("n = 1").select(F.col("next").alias("node_id"), "up", F.lit(False).alias("hit"), "steps")
    ways = _heads(single).where("steps is not null")
    joint = hops.join(into.where("n > 1").select("next"), "next", "left_semi").join(
        ways.withColumnRenamed("steps", "_more"), "node_id", "left"
    )
    total = (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")
    heads = _longest(joint.select(F.coalesce("head", "node_id").alias("node_id"), "next", total), root)
    level = heads.select(F.col("node_id").alias("head"), F.col("level").alias("_level"))
    below = ways.join(level, "head").select("node_id", (F.col("_level") + F.col("steps")).alias("level"))
    return heads.unionByName(below.join(heads, "node_id", "left_anti"))


def topo_level(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Longest-path level of each node of an acyclic graph; sources are level 0.

    Nodes are those of ``nodes`` and of the edges. They are peeled layer by layer
    with counters; what is left after some layers is condensed to heads, as in the
    walks above, with the number of steps to each head. A graph with a cycle is an error (see
    :func:`validate_edges`).
    """
    ends = edges.select(F.explode(F.array("upstream", "downstream")).alias("node_id"))
    every = materialize(nodes.select("node_id").unionByName(ends).distinct(), "nodes")
    hops = edges.select(
        F.col("upstream").alias("node_id"), F.col("downstream").alias("next"), F.lit(1).cast("bigint").alias("steps")
    )
    fed = edges.select(F.col("downstream").alias("node_id")).distinct()
    levels = materialize(_longest(hops, every.join(fed, "node_id", "left_anti")), "levels")
    if levels.count() != every.count():
        raise ValueError("the edges are cyclic: some nodes have no level")
    return levels


def failure_cascade(edges: DataFrame, nodes: DataFrame, failed: DataFrame) -> DataFrame:
    """Status of every node after ``failed`` failed.

    Failure skips whatever depends on it through data; an ordering edge is
    satisfied by a failure and skips nothing.
    """
    data = edges.where(F.col("kind") != "ordering")
    reached = downstream_closure(data, failed).withColumn("_hit", F.lit(True))
    own = failed.select("node_id").distinct().withColumn("_failed", F.lit(True))
    status = (
        F.when(F.col("_failed"), "failed").when(F.col("_hit"), "skipped").otherwise("success")
    )
    return (
        nodes.select("node_id")
        .join(own.hint("merge"), "node_id", "left")
        .join(reached.hint("merge"), "node_id", "left")
        .select("node_id", status.alias("status"))
    )


def cycle_core(edges: DataFrame) -> DataFrame:
    """Edges (node_id, next) on cycles or on ways between cycles; empty for an acyclic graph.

    Edges are dropped while their start has no incoming or their end no
    outgoing edge. Trimming both ends removes at least half of a tree per round.
    """
    live = materialize(edges, "live")
    n = live.count()
    while n:
        ends = live.select(F.col("next").alias("node_id")).distinct()
        starts = live.select(F.col("node_id").alias("next")).distinct()
        live = materialize(
            live.join(ends, "node_id", "left_semi").join(starts, "next", "left_semi").select("node_id", "next"), "live"
        )
        before, n = n, live.count()
        if n == before:
            break
    return live


def _colours(live: DataFrame) -> DataFrame:
    """(node_id, colour): the greatest node from which each node can be reached.

    A round takes the greatest colour of the nodes before a node, and then the
    colour of its own colour, which shortens long ways.
    """
    every = live.select(F.explode(F.array("node_id", "next")).alias("node_id")).distinct()
    colours = materialize(every.withColumn("colour", F.col("node_id")), "colours")
    while True:
        came = live.join(colours, "node_id").groupBy(F.col("next").alias("node_id")).agg(F.max("colour").alias("_came"))
        first = materialize(
            colours.join(came, "node_id", "left").select(
                "node_id", F.col("colour").alias("_old"), F.greatest("colour", F.coalesce("_came", "colour")).alias("colour")
            ),
            "colours",
        )
        own = first.select(F.col("node_id").alias("colour"), F.col("colour").alias("_next"))
        both = first.join(own, "colour").select("node_id", "_old", F.greatest("colour", "_next").alias("colour"))
        both = materialize(both, "colours")
        colours = both.select("node_id", "colour")
        if both.where("colour <> _old").isEmpty():
            return colours


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node_id, component): exactly the nodes on cycles of (upstream, downstream), with their component.

    Two nodes are in one strongly connected component if each reaches the other;
    it is named by its greatest node. The greatest node that reaches a node is its
    colour. The nodes that reach their colour within their colour, found for all
    colours at once by one backward walk, are components; the rest of the graph is
    trimmed and coloured again. An edge from a node to itself is a cycle.
    """
    spark = edges.sparkSession
    loops = edges.where(F.col("upstream") == F.col("downstream")).select(F.col("upstream").alias("node_id")).distinct()
    hops = _hops(edges, "upstream", "downstream")
    root, found = scratch_path(spark, "cycles"), []
    schema = hops.select("node_id", F.col("node_id").alias("component")).schema
    live = cycle_core(hops)
    while not live.isEmpty():
        colours = _colours(live)
        tint = lambda name, alias: colours.select(F.col("node_id").alias(name), F.col("colour").alias(alias))
        inside = live.join(tint("node_id", "_a"), "node_id").join(tint("next", "_b"), "next").where("_a = _b")
        back = inside.select(F.col("next").alias("node_id"), F.col("node_id").alias("next"))
        members = _reach(back, colours.where("node_id = colour").select("node_id"))
        members = colours.join(members, "node_id", "left_semi")
        found.append(f"{root}/round_{len(found)}")
        members = write_table(members.select("node_id", F.col("colour").alias("component")), found[-1])
        gone = members.select("node_id")
        left = live.join(gone, "node_id", "left_anti").join(gone.select(F.col("node_id").alias("next")), "next", "left_anti")
        live = cycle_core(left.select("node_id", "next"))
    every = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    large = every.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component")
    every = every.join(large, "component", "left_semi").select("node_id", "component")
    alone = loops.join(every.select("node_id"), "node_id", "left_anti")
    return every.unionByName(alone.select("node_id", F.col("node_id").alias("component")))


def validate_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of a graph as rows (issue, subject).

    ``nodes`` is (node_id, kind) and ``edges`` (upstream, downstream); kinds are
    asset, sensor and task. A ``cycle`` row names a node that reaches itself; nodes
    that only lie between cycles are none.
    """
    known = nodes.select("node_id", "kind").distinct()
    duplicate = (
        nodes.groupBy("node_id").count().where("count > 1")
        .select(F.lit("duplicate_key").alias("issue"), F.col("node_id").cast("string").alias("subject"))
    )
    arrow = F.concat(F.col("upstream").cast("string"), F.lit("->"), F.col("downstream").cast("string"))
    up = known.select(F.col("node_id").alias("upstream"), F.col("kind").alias("up_kind"))
    down = known.select(F.col("node_id").alias("downstream"), F.col("kind").alias("down_kind"))
    typed = edges.select("upstream", "downstream").join(down, "downstream", "left").join(
        up, "upstream", "left"
    )
    issue = (
        F.when(F.col("up_kind").isNull(), "unresolved_input")
        .when(F.col("down_kind").isNull(), "unresolved_node")
        .when(F.col("down_kind") == "sensor", "sensor_with_inputs")
        .when((F.col("up_kind") == "task") & (F.col("down_kind") != "task"), "task_as_input")
    )
    faulty = typed.select(issue.alias("issue"), arrow.alias("subject")).where(
        F.col("issue").isNotNull()
    )
    cyclic = cycle_nodes(edges).select(F.lit("cycle").alias("issue"), F.col("node_id").cast("string").alias("subject"))
    return duplicate.unionByName(faulty.distinct()).unionByName(cyclic)


def ordering_edges(edges: DataFrame) -> DataFrame:
    """Edge kind from the parameter name: a leading underscore carries no data."""
    return edges.withColumn(
        "kind", F.when(F.startswith(F.col("param"), F.lit("_")), "ordering").otherwise("data")
    )
