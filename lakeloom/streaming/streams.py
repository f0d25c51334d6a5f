"""Sensors, running aggregates and refreshes on Structured Streaming.

Every batch is identified by its id, and every write made for a batch goes to a
place named after that id and overwrites it. A batch that is replayed after a
failure therefore leaves the same files.

Functions with a ``root`` keep checkpoint and results there: called again with
the same root they take up what arrived in between.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lakeloom.operators.incremental import partition_digest
from lakeloom.operators.ordered import ALPHA_FALL, ALPHA_RISE, FLOOR_FACTOR
from lakeloom.operators.partitions import restrict
from lakeloom.session import scratch_path
from lakeloom.sources.sinks import sink_partitioned

#: State in RocksDB; a batch writes what it changed, not all of it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A timeout by the clock would otherwise ask for one empty batch after the other.
NO_EMPTY_BATCHES = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def sensor_file_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """New files below ``folder``, each entering exactly once, with their name."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    return reader.load(folder).withColumn("file_name", F.col("_metadata.file_name"))


def run_available(
    stream: DataFrame,
    checkpoint: str,
    *,
    path: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
    fmt: str = "parquet",
) -> None:
    """Process everything available now, into a table (``fmt`` noop: only into state) or batch by batch."""
    writer = (
        stream.writeStream.outputMode(mode)
        .trigger(availableNow=True)
        .option("checkpointLocation", checkpoint)
    )
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = (writer.option("path", path) if path else writer).format(fmt).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def latest_batch(spark: SparkSession, folder: str) -> str:
    """The folder of the newest batch below ``folder``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    ids = [int(e.getPath().getName().rsplit("_", 1)[1]) for e in entries]
    return f"{folder}/batch_{max(ids)}"


def ingest_files(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    max_files: int | None = None,
    root: str | None = None,
) -> DataFrame:
    """Table of all rows a file sensor has let in so far."""
    root = root or scratch_path(spark, "ingest")
    stream = sensor_file_stream(spark, folder, schema, max_files=max_files)
    run_available(stream, f"{root}/checkpoint", path=f"{root}/table")
    return spark.read.parquet(f"{root}/table")


def observe_change(
    snapshot: DataFrame, log: DataFrame | None, sensor: str, columns: Sequence[str]
) -> DataFrame:
    """One observation: (sensor, update_detected, digest, row_count).

    An update is detected when the snapshot's digest is not that of the newest
    observation in ``log``; a first observation always is one. An empty snapshot
    is an observation of no rows.
    """
    now = (
        partition_digest(snapshot, [], columns)
        .withColumnRenamed("token", "digest")
        .withColumn("sensor", F.lit(sensor))
    )
    if log is None:
        last = F.lit(None).cast("string")
    else:
        newest = log.where(F.col("sensor") == sensor).agg(F.max_by("digest", "poll"))
        last = newest.scalar()
    return now.select(
        "sensor", (~F.col("digest").eqNullSafe(last)).alias("update_detected"), "digest", "row_count"
    )


def observation_log(
    spark: SparkSession,
    stream: DataFrame,
    sensor: str,
    columns: Sequence[str],
    root: str | None = None,
) -> DataFrame:
    """Poll once per batch: each batch is a snapshot compared with the poll before."""
    root = root or scratch_path(spark, "observations")
    schema = "sensor string, update_detected boolean, digest string, row_count bigint, poll bigint"

    def poll(batch: DataFrame, batch_id: int) -> None:
        before = None
        if batch_id > 0:
            before = batch.sparkSession.read.schema(schema).parquet(
                f"{root}/log/poll_{batch_id - 1}"
            )
        row = observe_change(batch, before, sensor, columns)
        row.withColumn("poll", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{root}/log/poll_{batch_id}"
        )

    run_available(stream, f"{root}/checkpoint", each=poll)
    return spark.read.schema(schema).parquet(f"{root}/log/*")


def updated_sources(observations: DataFrame) -> DataFrame:
    """Sensors whose newest poll saw an update; only these make descendants stale."""
    return (
        observations.groupBy("sensor")
        .agg(F.max_by("update_detected", "poll").alias("updated"))
        .where("updated")
        .select("sensor")
    )


def stream_type_counts(
    spark: SparkSession, events: DataFrame, column: str, root: str | None = None
) -> DataFrame:
    """Running count per type; the table always holds the newest complete result."""
    root = root or scratch_path(spark, "type-counts")
    counts = events.groupBy(column).agg(F.count(F.lit(1)).alias("count"))

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/result/batch_{batch_id}")

    run_available(counts, f"{root}/checkpoint", each=keep, mode="complete")
    return spark.read.schema(counts.schema).parquet(latest_batch(spark, f"{root}/result"))


def stream_daily_counts(
    spark: SparkSession,
    events: DataFrame,
    ts: str,
    keys: Sequence[str],
    delay: str = "1 day",
    root: str | None = None,
) -> DataFrame:
    """Final counts per UTC day and key. A day is written once the watermark passes it.

    The watermark is what bounds the state: days older than ``delay`` behind the
    newest event are closed and their late rows dropped.
    """
    root = root or scratch_path(spark, "daily-counts")
    start = F.floor(F.unix_seconds("w.start") / 86_400).cast("int")
    daily = (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.date_from_unix_date(start).cast("string").alias("day"), *keys, "count")
    )
    run_available(daily, f"{root}/checkpoint", path=f"{root}/table")
    return spark.read.schema(daily.schema).parquet(f"{root}/table")


def stream_partition_refresh(
    spark: SparkSession,
    stream: DataFrame,
    keys: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
    root: str | None = None,
) -> DataFrame:
    """Keep ``compute`` of all rows so far, recomputing only the keys a batch touches.

    Batches are stored by key; a touched key is recomputed from its stored rows
    and its result directory is replaced, others are left alone.
    """
    root = root or scratch_path(spark, "partition-refresh")
    keys = list(keys)
    def refresh(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        sink_partitioned(batch, f"{root}/rows/batch={batch_id}", keys)
        touched = batch.select(*keys).distinct()
        stored = session.read.schema(batch.schema).option("basePath", f"{root}/rows").parquet(
            *[f"{root}/rows/batch={i}" for i in range(batch_id + 1)]
        )
        sink_partitioned(compute(restrict(stored, touched, keys)), f"{root}/result", keys)

    run_available(stream, f"{root}/checkpoint", each=refresh)
    shape = compute(spark.createDataFrame([], stream.schema)).schema
    return spark.read.schema(shape).parquet(f"{root}/result")


def stream_dedupe(
    spark: SparkSession,
    stream: DataFrame,
    key: Sequence[str],
    ts: str,
    delay: str | None = None,
    root: str | None = None,
) -> DataFrame:
    """Each key once, however often it is replayed.

    With ``delay`` a key is remembered until the watermark, the newest ``ts``
    less ``delay``, has passed it, and rows older than the watermark are dropped:
    the state holds the keys of the last ``delay`` only, on RocksDB. Without
    ``delay`` every key is remembered for ever.
    """
    root = root or scratch_path(spark, "dedupe")
    unique = (
        stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))
        if delay
        else stream.dropDuplicates(list(key))
    )
    with configured(spark, STATE_STORE):
        run_available(unique, f"{root}/checkpoint", path=f"{root}/table")
    return spark.read.schema(unique.schema).parquet(f"{root}/table")


def ewma_fold(
    key_name: str, key_type: str, idle_ms: int | None
) -> tuple[Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]], str, str]:
    """The stateful function of :func:`stream_ewma`, its output and its state."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(f["_o"].to_numpy(), f["_x"].to_numpy()) for f in frames]
        at, seen = (np.concatenate(x) for x in zip(*parts, strict=True))
        seen = seen[np.lexsort((seen, at))]
        estimate, samples = state.get if state.exists else (float(seen[0]), 0)
        for x in (seen if samples else seen[1:]).tolist():
            if x > estimate:
                estimate = ALPHA_RISE * x + (1 - ALPHA_RISE) * estimate
            else:
                estimate = max(ALPHA_FALL * x + (1 - ALPHA_FALL) * estimate, estimate * FLOOR_FACTOR)
        samples += len(seen)
        state.update((estimate, samples))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key_name: [key[0]], "estimate": [estimate], "samples": [samples]})

    return fold, f"`{key_name}` {key_type}, estimate double, samples bigint", "estimate double, samples bigint"


def stream_ewma(
    spark: SparkSession,
    stream: DataFrame,
    key: str,
    order: str,
    value: str,
    root: str | None = None,
    idle_ms: int | None = None,
) -> DataFrame:
    """Live estimate per key: (key, estimate, samples), read from the state store.

    The estimates are the state of a stateful operator on RocksDB: a batch reads
    and writes the keys that it has rows of and no others, and a run called again
    with the same ``root`` goes on from the checkpoint. Rows are ordered within a
    batch; batches are taken to arrive in order. Null values are passed over, a
    null key is a key. A key that had no rows for ``idle_ms`` of processing time
    is forgotten with the next batch and starts anew if it comes back; without
    ``idle_ms`` all keys are kept.

    The rows of one key in one batch meet in one task, with 16 bytes each; a
    source's ``maxFilesPerTrigger`` bounds a batch.
    """
    root = root or scratch_path(spark, "ewma")
    fold, schema, state = ewma_fold(key, dict(stream.dtypes)[key], idle_ms)
    seen = stream.select(
        key,
        F.col(order).cast("bigint").alias("_o"),
        F.greatest(F.col(value).cast("double"), F.lit(0.0)).alias("_x"),
    ).where(F.col("_x").isNotNull())
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    live = seen.groupBy(key).applyInPandasWithState(fold, schema, state, "update", timeout)
    with configured(spark, STATE_STORE | NO_EMPTY_BATCHES):
        run_available(live, f"{root}/checkpoint", fmt="noop", mode="update")
    held = spark.read.format("statestore").load(f"{root}/checkpoint")
    return held.select(F.col(f"key.`{key}`"), "value.groupState.estimate", "value.groupState.samples")


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Queries started inside have ``settings``; those of the session come back afterwards."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def scheduled_refresh(
    spark: SparkSession,
    stream_of: Callable[[], DataFrame],
    refresh: Callable[[DataFrame, int], None],
    checkpoint: str,
    every: str | None = None,
):
    """Refresh on a cadence, never overlapping.

    Without ``every`` this runs once over what is new since the checkpoint,
    which is also the single catch-up after downtime. With it, the running
    query is returned for the caller to stop.
    """
    if every is None:
        run_available(stream_of(), checkpoint, each=refresh)
        return None
    return (
        stream_of()
        .writeStream.trigger(processingTime=every)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(refresh)
        .start()
    )


