"""Sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.session import materialize
from lakeloom.sources.commits import move_new, remove_path

# Formats by path extension, and formats that can be written.
EXTENSION_FORMATS = {".parquet": "parquet", ".json": "json", ".txt": "text", ".pkl": "pickle"}
SUPPORTED_FORMATS = ("parquet", "json", "text")


def sink_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def sink_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def sink_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One string column, one line per row."""
    df.write.mode(mode).text(path)


def sink_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """One directory per key; rewrites only the keys present in ``df``.

    The rebalance hint lets AQE split a key that holds most of the rows over
    many writers and merge the small ones.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


@dataclass(frozen=True)
class Sink:
    path: str
    fmt: str | None = None

    def resolve(self, primary: str) -> str:
        tail = self.path.rstrip("/").rsplit("/", 1)[-1]
        ext = "." + tail.rsplit(".", 1)[-1] if "." in tail else ""
        return self.fmt or EXTENSION_FORMATS.get(ext) or primary


def path_size(spark: SparkSession, path: str) -> int:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(hadoop).getLength())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop))


def sink_all(df: DataFrame, sinks: Iterable[Sink], primary: str = "parquet") -> DataFrame:
    """Write ``df`` to every sink; a sink that fails is reported, never raised.

    The input is computed once, into a scratch table that all sinks read.
    """
    spark = df.sparkSession
    source = materialize(df, "sink-input")
    outcomes = []
    for sink in sinks:
        fmt = sink.resolve(primary)
        try:
            if fmt not in SUPPORTED_FORMATS:
                raise ValueError(f"no writer for {fmt!r}")
            body = source
            if fmt == "text" and source.dtypes != [(source.columns[0], "string")]:
                body = source.select(F.to_json(F.struct("*")).alias("value"))
            body.write.mode("overwrite").format(fmt).save(sink.path)
            outcomes.append((sink.path, fmt, "ok", path_size(spark, sink.path), None))
        except Exception as exc:  # isolation is the contract of this operator
            message = f"{type(exc).__name__}: {exc}"
            outcomes.append((sink.path, fmt, "error", None, message))
    return spark.createDataFrame(
        outcomes, "path string, format string, status string, size_bytes bigint, error string"
    )


def publish_versioned(df: DataFrame, root: str, node: str, run_hash: str) -> tuple[DataFrame, bool]:
    """Dataset at ``root/node/run_hash``; an address already complete is reused.

    Returns the dataset and whether another call's was used. A dataset is written
    aside and renamed to its address when it is whole: of several writers at once
    the first one's stays, the others drop theirs and return it, and a reader
    never sees half of one. A folder left there without its success marker, as an
    interrupted writer of another kind may leave it, is an error.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{node}/{run_hash}"
    reused = path_exists(spark, f"{path}/_SUCCESS")
    if not reused:
        attempt = f"{root.rstrip('/')}/_attempts/{uuid.uuid4().hex}"
        df.write.parquet(attempt)
        reused = not move_new(spark, attempt, path)
        if reused:
            remove_path(spark, attempt)
            if not path_exists(spark, f"{path}/_SUCCESS"):
                raise ValueError(f"an incomplete dataset is in the way: {path}")
    return spark.read.schema(df.schema).parquet(path), reused


def task_action(df: DataFrame, act: Callable[[pd.DataFrame], None], label: str) -> DataFrame:
    """Run a side effect over every batch of ``df`` once and return its audit rows.

    The audit is written by the very job that acts, so reading it acts no
    second time. Spark may retry a task: ``act`` has to be idempotent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf) == 0:
                continue
            try:
                act(pdf)
                status, error = "ok", None
            except Exception as exc:
                status, error = "error", f"{type(exc).__name__}: {exc}"
            yield pd.DataFrame(
                {"row_count": [len(pdf)], "status": [status], "error": [error]}
            )

    audit = df.mapInPandas(run, "row_count bigint, status string, error string")
    return materialize(audit, f"audit-{label}")
