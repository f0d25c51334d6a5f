"""Incremental refresh by a manifest of files.

The manifest keeps, for every file of the source and every partition key in it,
the number of rows and sums of row hashes. These add up: a partition's token is
the sum over its files. A refresh lists the files, which reads no data, reads
those that are new or have another size or time than before, and knows from the
manifest which files hold rows of the partitions that became stale. Nothing else
of the source is read.

A store below one folder holds the state: ``files/<attempt>`` (manifest),
``built/<attempt>`` (token, row count and attempt of each key's result) and
``rows/_attempt=<attempt>`` (results computed in that attempt). Results of keys
that stay are not written again; ``built`` names the attempt that holds them.
``commits/<n>`` names the attempt that became state ``n``; the first writer of a
number wins, so two refreshes at once leave one state and no reader sees half of
one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.operators.partitions import null_safe_join
from lakeloom.session import materialize, write_table
from lakeloom.sources.commits import claim, claims, read_claim

#: Attempts that results may be spread over before all of them are written together.
MOST_ATTEMPTS = 32
#: A file is the same as long as these are.
IDENTITY = {"file": "file_path", "size": "file_size", "modified": "file_modification_time"}
_LIMBS = [f"_s{k}" for k in range(8)]


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, file, size, modified) of all files below ``folder``; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(folder).select("path", *[F.col(f"_metadata.{m}").alias(n) for n, m in IDENTITY.items()])


def _literal(path: str) -> str:
    """``path`` as a pattern that fits it alone."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _limbs(columns: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row in 16-bit parts, whose sums stay within 64 bits."""
    # xxhash64 passes over nulls, so their places are hashed as well
    places = [F.col(c).isNull() for c in columns]
    halves = [F.xxhash64(F.lit(seed), *columns, *places) for seed in (1, 2)]
    return [F.shiftright(h, s).bitwiseAND(F.lit(0xFFFF)) for h in halves for s in (0, 16, 32, 48)]


def file_tokens(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(file, size, modified, keys, row_count, sums) of the files that ``rows`` comes from.

    ``rows`` has ``_file``, the source's file metadata.
    """
    hashed = rows.select(
        *[F.col(f"_file.{m}").alias(n) for n, m in IDENTITY.items()],
        *keys,
        *[c.alias(n) for c, n in zip(_limbs(columns), _LIMBS, strict=True)],
    )
    return hashed.groupBy(*IDENTITY, *keys).agg(
        F.count(F.lit(1)).alias("row_count"), *[F.sum(n).alias(n) for n in _LIMBS]
    )


def partition_tokens(tokens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, row_count, token): tokens of files rolled up to partitions."""
    added = tokens.groupBy(*keys).agg(
        F.sum("row_count").alias("row_count"), *[F.sum(F.col(n).cast("decimal(38,0)")).alias(n) for n in _LIMBS]
    )
    token = F.sha2(F.concat_ws("-", *[F.col(c).cast("string") for c in ("row_count", *_LIMBS)]), 256)
    return added.select(*keys, "row_count", token.alias("token"))


class FileStore:
    """State of refreshes below ``root``; see the module's text for its layout."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> tuple[int, str | None]:
        """Number of the newest state, -1 before any, and the attempt it names."""
        done = claims(self.spark, f"{self.root}/commits")
        if not done:
            return -1, None
        return int(done[-1]), read_claim(self.spark, f"{self.root}/commits/{done[-1]}")

    def commit(self, number: int, attempt: str) -> None:
        if not claim(self.spark, f"{self.root}/commits/{number:012d}", attempt):
            raise RuntimeError(f"another refresh has made state {number}; run again from there")

    def read(self, kind: str, attempt: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}/{attempt}")

    def rows_path(self, attempt: str) -> str:
        return f"{self.root}/rows/_attempt={attempt}"

    def result(self, attempt: str, keys: Sequence[str]) -> DataFrame:
        """All rows of a committed state."""
        built = self.read("built", attempt)
        return self.spark.read.parquet(self.rows_path(attempt)) if built.isEmpty() else self.rows_of(built, keys)

    def rows_of(self, built: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Results of the keys of ``built``, each from the attempt that computed them."""
        attempts = [r[0] for r in built.select("attempt").distinct().collect()]
        found = self.spark.read.option("basePath", f"{self.root}/rows").parquet(
            *[self.rows_path(a) for a in attempts]
        )
        live = built.select(*keys, F.col("attempt").alias("_attempt"))
        return null_safe_join(found, live, [*keys, "_attempt"], "left_semi").drop("_attempt")


def refresh_files(
    spark: SparkSession,
    folder: str,
    store: str,
    keys: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    schema: StructType | None = None,
    definition: str = "",
) -> DataFrame:
    """``compute`` over all files below ``folder``, of which only what changed is read.

    ``prepare`` turns rows of the files into rows with the ``keys`` (by default
    they are columns of the files) and keeps their column ``_file``; ``compute``
    gives rows that have the keys, those of one key from rows of that key alone.
    The result is that of ``compute(prepare(all files))``. A key is computed anew
    if it is new, if its rows are others than when its result was built (their
    order and their split into files do not matter), or if ``definition``, the
    name of the computation, is another. Keys without rows leave the result. Keys
    may be null. A folder without files needs a ``schema`` and has an empty result.

    Files are told apart by path, size and modification time. A file that is
    replaced while it is read is recorded as the reader saw it, and is read again
    next time. Only paths of changed files and of those with stale keys reach the
    driver, which plans scans by them.
    """
    keys = list(keys)
    schema = schema or spark.read.parquet(folder).schema
    state = FileStore(spark, store)
    number, before = state.state()
    # a leading letter: the attempt is a directory name that must not look like a number
    attempt = f"a{uuid.uuid4().hex}"
    listed = materialize(list_files(spark, folder), "listed")

    def read(files: DataFrame) -> DataFrame:
        paths = [_literal(r[0]) for r in files.join(listed, "file").select("path").distinct().collect()]
        if paths:
            rows = spark.read.schema(schema).option("basePath", folder).parquet(*paths)
            rows = rows.withColumn("_file", F.struct(*[f"_metadata.{m}" for m in IDENTITY.values()]))
        else:
            none = F.lit(None).cast("struct<file_path: string, file_size: bigint, file_modification_time: timestamp>")
            rows = spark.createDataFrame([], schema).withColumn("_file", none)
        return prepare(rows) if prepare else rows

    def tokens_of(files: DataFrame) -> DataFrame:
        rows = read(files)
        return file_tokens(rows, keys, [c for c in rows.columns if c != "_file"])

    if before is None:
        tokens = tokens_of(listed.select("file"))
    else:
        recorded = state.read("files", before)
        tokens = tokens_of(listed.join(recorded, list(IDENTITY), "left_anti").select("file")).unionByName(
            recorded.join(listed.select(*IDENTITY), list(IDENTITY), "left_semi")
        )
    files = write_table(tokens, f"{state.root}/files/{attempt}")

    now = partition_tokens(files, keys).withColumn("definition", F.lit(definition))
    match = [*keys, "token", "definition"]
    old = state.read("built", before) if before else now.limit(0).withColumn("attempt", F.lit(""))
    stale = materialize(null_safe_join(now, old, match, "left_anti"), "stale")
    kept = null_safe_join(old, now, match, "left_semi")
    moved = kept.select("attempt").distinct().count() >= MOST_ATTEMPTS
    if moved:  # results lie in many places: they are written together, not computed again
        state.rows_of(kept, keys).write.parquet(state.rows_path(attempt))
        kept = kept.withColumn("attempt", F.lit(attempt))
    holding = null_safe_join(files, stale, keys, "left_semi").select("file").distinct()
    rows = null_safe_join(read(holding).drop("_file"), stale, keys, "left_semi")
    compute(rows).write.mode("append").parquet(state.rows_path(attempt))
    write_table(kept.unionByName(stale.withColumn("attempt", F.lit(attempt))), f"{state.root}/built/{attempt}")
    state.commit(number + 1, attempt)
    return state.result(attempt, keys)
