"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by their length and first bytes, groups of more than one
document by the bytes that follow, and so on until a group is a single document
or its texts have ended. Digits widen from level to level, so that a text of any
length takes few levels; no digest takes part in the comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.tables import small
from lakeloom.llm.text import chunks, rows_of
from lakeloom.session import materialize

#: Digit widths by level; the last one repeats.
WIDTHS = (64, 512, 4096, 32_768, 262_144, 1_048_576)


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(1)):
            low = chunk.lowered()
            raw = low.data[: low.size].tobytes()
            at = low.offsets
            shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            body = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(low), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)]
            ).cast(pa.binary())
            ids = rows_of(batch, chunk, [batch.schema.names[0]])
            yield pa.RecordBatch.from_arrays([*ids, pa.array(shas), body], ["doc_id", "sha", "body"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a null text is empty.
    Of equal texts the largest id stays. A null id never wins over another;
    where all ids of a group are null, ``keep_id`` is null and every row is
    kept. Rows that repeat an id and a text are one document and marked alike.
    An empty table gives an empty result. Other columns are not read.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    bodies = source.mapInArrow(_normalise, f"doc_id {id_type}, sha string, body binary").select(
        "doc_id",
        "sha",
        F.lit(0).cast("bigint").alias("gid"),
        F.octet_length("body").cast("bigint").alias("left"),
        F.col("body").alias("rest"),
    )
    done: list[DataFrame] = []
    level = 0
    rows = bodies
    while True:
        width = WIDTHS[min(level, len(WIDTHS) - 1)]
        rows = rows.withColumn("digit", F.expr(f"substring(rest, 1, {width})"))
        key = ["gid", "left", "digit"]
        if level == 0:
            # the widest pass leaves only what later steps need
            heads = materialize(rows.drop("rest"), "heads")
        else:
            heads = rows
        groups = materialize(
            heads.groupBy(*key)
            .agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            f"groups{level}",
        )
        groups = small(groups, 64 + width)
        if level == 0:
            done.append(
                heads.join(groups, key, "left_anti").select(
                    "doc_id", "sha", F.col("doc_id").alias("keep"), F.lit(1).cast("bigint").alias("n")
                )
            )
        step = rows.join(groups, key, "inner" if level == 0 else "left").select(
            "doc_id",
            "sha",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep"),
            F.coalesce("n", F.lit(1)).cast("bigint").alias("n"),
            F.col("next").alias("gid"),
            F.greatest(F.col("left") - width, F.lit(0)).cast("bigint").alias("left"),
            F.when(
                F.col("n").isNotNull() & (F.col("left") > width), F.expr(f"substring(rest, {width + 1})")
            ).alias("rest"),
        )
        step = materialize(step, f"level{level}")
        done.append(step.where("rest is null").select("doc_id", "sha", "keep", "n"))
        rows = step.where("rest is not null").select("doc_id", "sha", "gid", "left", "rest")
        level += 1
        if rows.isEmpty():
            break
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return every.select(
        "doc_id",
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep"), F.col("keep").isNull()).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
