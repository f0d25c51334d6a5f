"""Fingerprints, cache lookup and stale-only recomputation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.functions.scalars import hex_to_int
from lakeloom.operators.joins import semi_join_hits
from lakeloom.operators.ordered import latest_success
from lakeloom.operators.partitions import null_safe_join, restrict
from lakeloom.operators.sets import merge_logs, universe_diff
from lakeloom.session import materialize

# Fixed value: the version that enters every fingerprint.
PROTOCOL_VERSION = "1.0.0"


def definition_fingerprint(source: Column, dependencies: Column, metadata: Column) -> Column:
    head = F.lit(f"definition:{PROTOCOL_VERSION}\n")
    nl = F.lit("\n")
    return F.sha2(F.concat(head, source, nl, dependencies, nl, metadata), 256)


def partition_source_fingerprint(values_json: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"partition_source:{PROTOCOL_VERSION}\n"), values_json), 256)


def run_fingerprint_of(
    definition: Column, partition: Column, upstream: Column, params: Column
) -> Column:
    """Fingerprint of one step whose upstream ids are an array column (any order)."""

    def line(label: str, value: Column) -> Column:
        return F.when(value.isNull(), "").otherwise(F.concat(F.lit(label), value, F.lit("\n")))

    lines = F.transform(
        F.sort_array(upstream), lambda u: F.concat(F.lit("upstream:"), u, F.lit("\n"))
    )
    return F.sha2(
        F.concat(
            F.lit(f"run:{PROTOCOL_VERSION}\n"),
            definition,
            F.lit("\n"),
            line("partition:", partition),
            F.array_join(F.coalesce(lines, F.array().cast("array<string>")), ""),
            line("params:", params),
        ),
        256,
    )


def gather_upstream(pairs: DataFrame, step: str, upstream: str) -> DataFrame:
    """Upstream ids of each step as one token: (step, n_upstream, upstream_ids).

    The token adds up hashes of the ids: it does not depend on their order, any id
    changes it, and partial aggregation builds it for any fan-in without ever
    gathering the ids. ``upstream_ids`` is an array of that one token.
    """
    halves = [hex_to_int(F.substring(F.sha2(F.col(upstream), 256), at, 15)) for at in (1, 16, 31, 46)]
    names = [f"_h{i}" for i in range(len(halves))]
    hashed = pairs.select(step, *[h.alias(n) for h, n in zip(halves, names, strict=True)])
    n = F.count(F.lit(1))
    sums = [_exact_hash_sum(c).cast("string") for c in names]
    token = F.sha2(F.concat_ws("-", n.cast("string"), *sums), 256)
    return hashed.groupBy(step).agg(n.alias("n_upstream"), F.array(token).alias("upstream_ids"))


def run_fingerprint(steps: DataFrame, pairs: DataFrame, step: str, upstream: str) -> DataFrame:
    """Run hash per step.

    ``steps`` has ``step``, ``definition_hash`` and optionally ``partition`` and
    ``params``; ``pairs`` has one row per (step, upstream id).
    """
    ids = gather_upstream(pairs, step, upstream)
    absent = F.lit(None).cast("string")
    return steps.join(ids, step, "left").select(
        step,
        F.coalesce("n_upstream", F.lit(0)).cast("bigint").alias("n_upstream"),
        run_fingerprint_of(
            F.col("definition_hash"),
            F.col("partition") if "partition" in steps.columns else absent,
            F.col("upstream_ids"),
            F.col("params") if "params" in steps.columns else absent,
        ).alias("run_hash"),
    )


def upstream_hashes(
    steps: DataFrame, edges: DataFrame, hashes: DataFrame, fan_in: str = "token"
) -> DataFrame:
    """Upstream run hashes of each step and edge: (step, partition, upstream, match, run_hash).

    For each edge the unpartitioned upstream is used if it exists, else the
    upstream's partition of the same name, else all of its partitions (fan-in).
    With ``fan_in`` rows, a fan-in is one row for each of their hashes. With token,
    it is one row with one token of the set of them all (see :func:`gather_upstream`),
    computed once for each upstream however many steps read it, so there are never
    more rows than edges. ``hashes`` is (base_id, partition, run_hash) with a null
    partition for an unpartitioned node.
    """
    if fan_in not in ("token", "rows"):
        raise ValueError(f"fan_in is token or rows, not {fan_in!r}")
    need = steps.select("step", "partition").join(
        edges.select(F.col("downstream").alias("step"), "upstream"), "step"
    )
    whole = hashes.where(F.col("partition").isNull()).select(
        F.col("base_id").alias("upstream"), "run_hash"
    )
    parts = hashes.where(F.col("partition").isNotNull()).select(
        F.col("base_id").alias("upstream"), "partition", "run_hash"
    )
    out = ["step", "partition", "upstream", "match", "run_hash"]
    exact = need.join(whole, "upstream").withColumn("match", F.lit("exact"))
    rest = need.join(whole, "upstream", "left_anti")
    aligned = rest.join(parts, ["upstream", "partition"]).withColumn("match", F.lit("aligned"))
    if fan_in == "rows":
        sets = parts.select("upstream", "run_hash")
    else:
        sets = gather_upstream(parts, "upstream", "run_hash").select(
            "upstream", F.element_at("upstream_ids", 1).alias("run_hash")
        )
    whole_sets = (
        rest.join(parts, ["upstream", "partition"], "left_anti")
        .join(sets, "upstream")
        .withColumn("match", F.lit("fan_in"))
    )
    return exact.select(out).unionByName(aligned.select(out)).unionByName(whole_sets.select(out))


def cache_lookup(steps: DataFrame, log: DataFrame) -> DataFrame:
    """Steps with the newest success artifact of their run hash, if any.

    Only content decides: failed rows never hit, and a step that returns to an
    earlier definition hits the artifact of that time.
    """
    newest = latest_success(log.select("node_id", "run_hash", "status", "id")).select(
        "node_id", "run_hash", F.col("id").alias("artifact_id")
    )
    return steps.join(newest, ["node_id", "run_hash"], "left").withColumn(
        "hit", F.col("artifact_id").isNotNull()
    )


def partition_digest(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], portable: bool = False
) -> DataFrame:
    """Content token per partition: (keys, row_count, token).

    The token adds up two hashes of every row, so it depends on each row, its
    multiplicity and nothing else, and is built by partial aggregation. Rows are
    hashed with two seeds of xxhash64; ``portable`` tokens use md5 of the row's
    text instead, which other engines can reproduce at several times the cost.
    """
    if portable:
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
        halves = [hex_to_int(F.substring(F.md5(text), at, 15)) for at in (1, 16)]
    else:
        # xxhash64 passes over nulls, so their places are hashed as well
        places = [F.col(c).isNull() for c in columns]
        halves = [F.xxhash64(F.lit(seed), *columns, *places) for seed in (1, 2)]
    hashed = df.select(*keys, halves[0].alias("_a"), halves[1].alias("_b"))
    rows = F.count(F.lit(1))
    sums = [_exact_hash_sum("_a"), _exact_hash_sum("_b")]
    return hashed.groupBy(*keys).agg(
        rows.alias("row_count"),
        F.concat_ws("-", rows.cast("string"), *[s.cast("string") for s in sums]).alias("token"),
    )


def _exact_hash_sum(column: str) -> Column:
    """Exact sum of 64-bit hashes, added up as four 16-bit limbs in plain longs."""
    limbs = [F.sum(F.shiftright(column, s).bitwiseAND(F.lit(0xFFFF))) for s in (0, 16, 32, 48)]
    wide = [limb.cast("decimal(38,0)") for limb in limbs]
    return sum(
        (w * F.lit(2**s) for w, s in zip(wide[1:], (16, 32, 48), strict=True)), wide[0]
    ).cast("decimal(38,0)")


def stale_partitions(
    current: DataFrame, recorded: DataFrame, keys: Sequence[str], fingerprint: str = "token"
) -> DataFrame:
    """Current keys that are new or whose fingerprint is not the recorded one."""
    on = [*keys, fingerprint]
    return null_safe_join(current.select(*on), recorded.select(*on), on, "left_anti")


def incremental_refresh(
    source: DataFrame,
    current: DataFrame,
    recorded: DataFrame,
    previous: DataFrame,
    keys: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
    fingerprint: str = "token",
) -> DataFrame:
    """Result of ``compute(source)`` with only the stale keys recomputed.

    ``current`` and ``recorded`` hold the fingerprint per key now and at the
    time ``previous`` was built. Keys that left the source leave the result.
    The fingerprints, one row per key, are written once and read where needed.
    Keys may be null and are matched by one null-safe join however many are stale;
    few stale keys are also a predicate that the scan of the source can prune by.
    """
    keys = list(keys)
    current = materialize(current.select(*keys, fingerprint), "fingerprints")
    stale = stale_partitions(current, recorded, keys, fingerprint).select(*keys)
    stale = materialize(stale, "stale")
    kept = null_safe_join(current, stale, keys, "left_anti")
    reused = null_safe_join(previous, kept, keys, "left_semi")
    return compute(restrict(source, stale, keys)).unionByName(reused)


def refresh_policy(
    steps: DataFrame, log: DataFrame, mode: str = "cache-aware", selected: Sequence[str] = ()
) -> DataFrame:
    """``must_run`` and its reason for every step (node_id, run_hash, kind, base_id).

    Modes: ``cache-aware`` reuses hits, ``force-all`` reruns everything,
    ``force-selected`` reruns the assets named in ``selected``. Tasks and
    sensors always run.
    """
    if mode not in ("cache-aware", "force-all", "force-selected"):
        raise ValueError(f"unknown refresh mode {mode!r}")
    forced = F.lit(mode == "force-all")
    if mode == "force-selected":
        forced = F.col("base_id").isin(list(selected))
    hits = semi_join_hits(steps.select("node_id", "run_hash").distinct(), log).withColumn(
        "_hit", F.lit(True)
    )
    reason = (
        F.when(F.col("kind").isin("task", "sensor"), "uncached kind")
        .when(forced, "forced")
        .when(F.col("_hit").isNull(), "miss")
        .otherwise("hit")
    )
    return (
        steps.join(hits, ["node_id", "run_hash"], "left")
        .withColumn("reason", reason)
        .withColumn("must_run", F.col("reason") != "hit")
        .drop("_hit")
    )


def new_materializations(log: DataFrame, rows: DataFrame) -> DataFrame:
    """History after a run: executed rows are appended, cached steps add none."""
    executed = rows.where(~F.col("cached")).drop("cached")
    return merge_logs(log, executed)


def append_materializations(path: str, rows: DataFrame, day: str = "created_day") -> None:
    """Append executed rows to the history table; existing files are never touched."""
    rows.where(~F.col("cached")).drop("cached").write.mode("append").partitionBy(day).parquet(path)


def refresh_eligibility(
    nodes: DataFrame, stale: DataFrame, waiting: DataFrame, blocked: DataFrame
) -> DataFrame:
    """State of every node (node_id, active, freshness, window_open).

    ``stale`` holds the stale nodes, ``waiting`` those with a stale direct
    upstream, ``blocked`` those below a stale ``manual`` node. A stale ``manual``
    node waits for an explicit request, which is a window that never opens.
    """

    names = ["_stale", "_waiting", "_blocked"]

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("node_id", *[F.lit(n == name).alias(n) for n in names])

    marks = reduce(DataFrame.unionByName, map(mark, (stale, waiting, blocked), names))
    marks = marks.groupBy("node_id").agg(*[F.max(n).alias(n) for n in names])
    # one join of all marks, merged: they can be as many as the nodes, too many for the driver
    flagged = nodes.join(marks.hint("merge"), "node_id", "left")
    closed = (F.col("freshness") == "manual") | (
        (F.col("freshness") == "schedule") & ~F.col("window_open")
    )
    state = (
        F.when(~F.col("active"), "historical")
        .when(~F.coalesce("_stale", F.lit(False)), "fresh")
        .when(F.col("_waiting") | F.col("_blocked"), "stale_waiting_for_upstream")
        .when(closed, "stale_waiting_for_schedule")
        .otherwise("runnable_stale")
    )
    return flagged.select("node_id", state.alias("state"))


def history_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Definitions ever seen, active when still declared, inactive otherwise."""
    status = F.when(F.col("state") == "removed", "inactive").otherwise("active")
    return universe_diff(old, new, keys).select(*keys, status.alias("status"))


def prune_unreachable(
    log: DataFrame, active: DataFrame, keys: Sequence[str] = ("node_id", "run_hash")
) -> DataFrame:
    """Log rows that active definitions still reach."""
    return log.join(active.select(*keys).distinct(), list(keys), "left_semi")


def continuity_key(name: Column, file: Column, function: Column) -> Column:
    """Identity of a definition: its explicit name, else ``file:function``."""
    return F.coalesce(name, F.concat(file, F.lit(":"), function))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("definitions")).where("definitions > 1")
