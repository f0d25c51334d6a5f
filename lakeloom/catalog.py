"""Declared assets: named functions from DataFrames to DataFrames, kept up to date.

The catalog only decides what has to be computed, from fingerprints; every
computation is an ordinary Spark job on the DataFrames the functions return.
"""

from __future__ import annotations

import inspect
import json
import time
import traceback
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.scalars import safe_name
from lakeloom.operators.incremental import (
    definition_fingerprint,
    incremental_refresh,
    partition_digest,
    run_fingerprint_of,
)
from lakeloom.operators.runlog import node_stats
from lakeloom.session import materialize, shared_folder, write_table
from lakeloom.sources.sinks import Sink, path_exists, path_size, publish_versioned, sink_all

LOG_SCHEMA = (
    "id bigint, run_id string, command string, node_id string, kind string, run_hash string, "
    "definition_hash string, artifact_path string, artifact_format string, artifact_size_bytes bigint, "
    "elapsed_seconds double, status string, error_message string, error_traceback string, "
    "attempts int, cached boolean, sinks_json string"
)


class AssetError(RuntimeError):
    """A node failed, was skipped because an input failed, or is declared wrongly."""


@dataclass(frozen=True)
class Node:
    name: str
    kind: str
    fn: Callable
    inputs: Mapping[str, str]
    keys: tuple[str, ...] = ()
    sinks: tuple[Sink, ...] = ()
    retries: int = 1
    retry_backoff: float = 0.0
    freshness: str = "always"
    version: str = ""
    depends: tuple[Callable, ...] = ()
    tags: tuple[str, ...] = ()
    description: str = ""

    def data_inputs(self) -> dict[str, str]:
        """Inputs that carry data; a parameter starting with ``_`` only orders."""
        return {p: n for p, n in self.inputs.items() if not p.startswith("_")}


@dataclass
class _Run:
    command: str
    forced: set[str] | None  # None: every asset
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    done: dict[str, tuple[DataFrame | None, str]] = field(default_factory=dict)
    rows: list[tuple] = field(default_factory=list)


class AssetCatalog:
    """Assets, sensors and tasks of one store.

    ``root`` is a folder all executors reach; it holds the artifacts, addressed
    by run hash and never changed, and the append-only log.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{shared_folder(spark)}/lakeloom/catalog").rstrip("/")
        self.nodes: dict[str, Node] = {}

    # --- declaration ---------------------------------------------------------

    def asset(self, fn=None, *, name=None, inputs=None, partitions: Sequence[str] = (), **options):
        """A cached node. ``partitions`` names the key columns of its result.

        The function of a partitioned asset has to work key by key: its result
        for a key may depend only on the rows its first input has for that key
        and on its other inputs. It is then called with the stale keys alone.
        """
        return self._declare("asset", fn, name, inputs, keys=tuple(partitions), **options)

    def sensor(self, fn=None, *, name=None, inputs=None, freshness="manual", **options):
        """An uncached observer returning ``(update_detected, DataFrame)``; consumers get the data."""
        return self._declare("sensor", fn, name, inputs, freshness=freshness, **options)

    def task(self, fn=None, *, name=None, inputs=None, **options):
        """An uncached step that acts; it may feed other tasks only."""
        return self._declare("task", fn, name, inputs, **options)

    def _declare(self, kind, fn, name, inputs, **options):
        if fn is None:
            return lambda f: self._declare(kind, f, name, inputs, **options)
        resolved = {}
        for param, upstream in (inputs or {}).items():
            upstream = getattr(upstream, "__name__", upstream)
            if upstream not in self.nodes:
                raise AssetError(f"input {param!r} names no declared node: {upstream!r}")
            if self.nodes[upstream].kind == "task" and kind != "task":
                raise AssetError(f"{kind} {fn.__name__!r} reads {upstream!r}, a task, which only tasks may do")
            resolved[param] = upstream
        if kind == "sensor" and resolved:
            raise AssetError(f"{fn.__name__!r} observes the outside: a sensor takes no inputs")
        for listed in ("sinks", "depends", "tags"):
            options[listed] = tuple(options.get(listed, ()))
        node = Node(name or fn.__name__, kind, fn, resolved, **options)
        if node.name in self.nodes:
            raise AssetError(f"{node.name!r} is declared twice")
        self.nodes[node.name] = node
        return fn

    # --- reading and running -------------------------------------------------

    def get(self, target: str, no_cache: bool = False, params: Mapping | None = None) -> DataFrame:
        """Value of an asset or sensor, computing only what no artifact covers."""
        if self.nodes[target].kind == "task":
            raise AssetError(f"{target!r} is a task; use run")
        return self._execute(_Run("get", None if no_cache else set()), target, params)

    def run(
        self, target: str, burst: Iterable[str] | None = None, params: Mapping | None = None
    ) -> DataFrame | None:
        """Run a task and what it needs.

        All its assets are recomputed, or with ``burst`` only the named ones;
        tasks and sensors always run.
        """
        if self.nodes[target].kind != "task":
            raise AssetError(f"{target!r} is no task; use get")
        return self._execute(_Run("run", None if burst is None else set(burst)), target, params)

    def plan(self, target: str | None = None) -> DataFrame:
        """Declared edges (upstream, downstream, kind), optionally only those a target needs."""
        wanted = set(self.nodes) if target is None else self._needed(target)
        rows = [
            (up, n.name, "ordering" if p.startswith("_") else "data")
            for n in self.nodes.values()
            if n.name in wanted
            for p, up in n.inputs.items()
        ]
        return self.spark.createDataFrame(rows, "upstream string, downstream string, kind string")

    def log(self) -> DataFrame:
        if not path_exists(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        return self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")

    def history(self, limit: int = 10) -> DataFrame:
        """Newest runs with their step counts."""
        failed = F.bool_or(F.col("status") != "success")
        runs = self.log().groupBy("run_id", "command").agg(
            F.min("id").alias("started"),
            F.when(failed, "failed").otherwise("success").alias("status"),
            F.count(F.lit(1)).alias("steps_total"),
            F.count_if(~F.col("cached")).alias("steps_executed"),
            F.count_if(F.col("cached")).alias("steps_cached"),
            F.sum("elapsed_seconds").alias("elapsed_seconds"),
        )
        return runs.orderBy(F.col("started").desc()).limit(limit)

    def stats(self) -> DataFrame:
        """Duration statistics of every node over the steps that ran."""
        return node_stats(self.log().where(~F.col("cached")))

    # --- execution -----------------------------------------------------------

    def _needed(self, target: str) -> set[str]:
        out: set[str] = set()
        stack = [target]
        while stack:
            name = stack.pop()
            if name not in out:
                out.add(name)
                stack.extend(self.nodes[name].inputs.values())
        return out

    def _execute(self, run: _Run, target: str, params: Mapping | None) -> DataFrame | None:
        needed = self._needed(target)
        try:
            # nodes are declared after their inputs, so declaration order is a valid order
            for name, node in self.nodes.items():
                if name in needed:
                    self._step(run, node, params if name == target else None)
        finally:
            self.spark.createDataFrame(run.rows, LOG_SCHEMA).coalesce(1).write.mode(
                "append"
            ).parquet(f"{self.root}/log")
        return run.done[target][0]

    def _hash(self, *columns) -> list[str]:
        # constants over a one-row relation are folded by the optimizer: no job runs
        return list(self.spark.sql("SELECT 1").select(*columns).first())

    def definition_hash(self, node: Node) -> str:
        metadata = json.dumps(
            {
                "kind": node.kind,
                "freshness": node.freshness,
                "inputs": sorted(node.inputs),
                "partitions": node.keys,
                "sinks": [(s.path, s.fmt) for s in node.sinks],
                "version": node.version,
            }
        )
        helpers = "\n".join(inspect.getsource(d) for d in node.depends)
        return self._hash(
            definition_fingerprint(
                F.lit(inspect.getsource(node.fn)), F.lit(helpers), F.lit(metadata)
            )
        )[0]

    def _step(self, run: _Run, node: Node, params: Mapping | None) -> None:
        started = time.time()
        definition = self.definition_hash(node)
        upstream = {n: run.done[n][1] for n in node.data_inputs().values()}
        text = json.dumps(dict(params), sort_keys=True) if params else None
        run_hash = self._run_hash(definition, upstream.values(), text)
        folder = self._hash(safe_name(F.lit(node.name)))[0]

        def record(status, attempts, cached, path=None, final_hash=run_hash, sinks=None, error=None):
            fmt, size = ("parquet", path_size(self.spark, path)) if path else (None, None)
            text = f"{type(error).__name__}: {error}" if error else None
            trace = "".join(traceback.format_exception(error)) if error else None
            run.rows.append(
                (
                    time.time_ns(), run.run_id, run.command, node.name, node.kind, final_hash,
                    definition, path, fmt, size, time.time() - started, status, text, trace,
                    attempts, cached, sinks,
                )
            )

        forced = run.forced is None or node.name in run.forced
        known = None if forced or node.kind != "asset" else self._artifact(node, folder, run_hash)
        if known:
            run.done[node.name] = (self.spark.read.parquet(known), run_hash)
            record("success", 0, True, known)
            return
        attempt, error = 0, None
        while attempt < max(1, node.retries):
            if attempt:
                time.sleep(node.retry_backoff * attempt)
            attempt += 1
            try:
                frame, final, path = self._compute(
                    run, node, definition, run_hash, folder, params, forced
                )
                outcome = None
                if node.sinks and frame is not None:
                    rows = sink_all(frame, node.sinks).collect()  # one row per declared sink
                    outcome = json.dumps([r.asDict() for r in rows])
                run.done[node.name] = (frame, final)
                record("success", attempt, False, path, final, outcome)
                return
            except Exception as exc:
                error = exc
        record("failed", attempt, False, error=error)
        raise AssetError(f"{node.name!r} failed after {attempt} attempts") from error

    def _newest(self, node: Node, condition: Column) -> tuple[str | None, str | None]:
        """(run_hash, artifact_path) of a node's newest success that meets ``condition``."""
        found = (
            self.log()
            .where((F.col("node_id") == node.name) & (F.col("status") == "success") & condition)
            .agg(F.max_by(F.struct("run_hash", "artifact_path"), "id").alias("newest"))
            .first()["newest"]
        )
        return tuple(found) if found else (None, None)

    def _artifact(self, node: Node, folder: str, run_hash: str) -> str | None:
        """Where the newest success of this run hash lies, forced ones included."""
        logged = self._newest(node, F.col("run_hash") == run_hash)[1]
        # a run that ended before its log was written has left a whole artifact here
        paths = [logged, f"{self.root}/artifacts/{folder}/{run_hash}"]
        return next((p for p in paths if p and path_exists(self.spark, f"{p}/_SUCCESS")), None)

    def _run_hash(self, definition: str, upstream: Iterable[str], params: str | None) -> str:
        ids = F.array(*[F.lit(u) for u in upstream]).cast("array<string>")
        none = F.lit(None).cast("string")
        return self._hash(run_fingerprint_of(F.lit(definition), none, ids, F.lit(params)))[0]

    def _call(self, run: _Run, node: Node, params: Mapping | None, **replaced):
        arguments = {p: None for p in node.inputs}
        arguments |= {p: run.done[n][0] for p, n in node.data_inputs().items()}
        arguments |= replaced
        accepted = inspect.signature(node.fn).parameters
        if "spark" in accepted:
            arguments["spark"] = self.spark
        return node.fn(**arguments, **(params or {}))

    def _compute(self, run, node, definition, run_hash, folder, params, forced):
        root = f"{self.root}/artifacts"
        if node.kind == "sensor":
            return self._observe(run, node, folder, params)
        if node.kind == "task":
            out = self._call(run, node, params)
            return (materialize(out, folder) if isinstance(out, DataFrame) else None), run_hash, None
        if node.keys and node.data_inputs():
            out = self._refresh(run, node, definition, run_hash, folder, params, forced)
        else:
            out = self._call(run, node, params)
        if forced:
            # a forced result gets an address of its own: artifacts are never overwritten
            folder = f"{folder}/forced-{run.run_id}"
        return publish_versioned(out, root, folder, run_hash)[0], run_hash, f"{root}/{folder}/{run_hash}"

    def _observe(self, run: _Run, node: Node, folder: str, params) -> tuple[DataFrame, str, str]:
        """The snapshot, its token and where it lies; without an update those of the last observation."""
        updated, data = self._call(run, node, params)
        if not updated:
            token, path = self._newest(node, F.col("artifact_path").isNotNull())
            if path and path_exists(self.spark, f"{path}/_SUCCESS"):
                return self.spark.read.parquet(path), token, path
        path = f"{self.root}/snapshots/{folder}/{uuid.uuid4().hex}"
        data = write_table(data, path)
        digest = partition_digest(data.withColumn("_all", F.lit(0)), ["_all"], data.columns)
        found = digest.first()
        return data, found["token"] if found else "empty", path

    def _refresh(self, run, node, definition, run_hash, folder, params, forced) -> DataFrame:
        """Recompute the keys whose rows in the first input changed; reuse the others."""
        (first, source_name), *others = node.data_inputs().items()
        source = run.done[source_name][0]
        keys = list(node.keys)
        # whatever else enters the result makes every key stale when it changes
        basis = self._run_hash(
            definition, [run.done[n][1] for _, n in others], json.dumps(params or {}, sort_keys=True)
        )
        tokens = partition_digest(source, keys, source.columns).withColumn(
            "token", F.concat_ws(":", "token", F.lit(basis))
        )
        tokens = publish_versioned(tokens, f"{self.root}/tokens", folder, run_hash)[0]

        def compute(rows: DataFrame) -> DataFrame:
            return self._call(run, node, params, **{first: rows})

        previous = None if forced else self._previous(node, folder, run_hash)
        if previous is None:
            return compute(source)
        recorded, artifact = previous
        return incremental_refresh(source, tokens, recorded, artifact, keys, compute)

    def _previous(self, node: Node, folder: str, run_hash: str):
        """Tokens and artifact of the newest other version of this asset."""
        last, artifact = self._newest(node, ~F.col("cached") & (F.col("run_hash") != run_hash))
        paths = [f"{self.root}/tokens/{folder}/{last}", artifact]
        if not artifact or not all(path_exists(self.spark, f"{p}/_SUCCESS") for p in paths):
            return None
        return tuple(self.spark.read.parquet(p) for p in paths)
