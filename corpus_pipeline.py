"""Documents to training tokens: toxicity, exact and near duplicates, contamination, BPE."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from lakeloom.llm.tables import small
from lakeloom.session import materialize, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Bound of an Arrow batch of texts.
BATCH_BYTES = "2m"
#: Names a row in all stages; ids may repeat or be null.
KEY = "_row_key_"


def _bounded(spark: SparkSession) -> None:
    """From here on the session's Arrow batches hold ``BATCH_BYTES`` at most, or one row.

    Texts of a batch are held by the executor and by its Python workers at once.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row that is written with it; a stage's output has one already."""
    _bounded(docs.sparkSession)
    if KEY in docs.columns:
        return docs.select(KEY, *COLUMNS)
    return materialize(docs.select(F.monotonically_increasing_id().alias(KEY), *COLUMNS), "keyed")


def _without(docs: DataFrame, rejected: DataFrame, label: str) -> DataFrame:
    """``docs`` without exactly the rows whose key is among the ``doc_id`` of ``rejected``."""
    gone = materialize(rejected.select(F.col("doc_id").alias(KEY)), label)
    return docs.join(small(gone, 8), KEY, "left_anti").select(KEY, *COLUMNS)


def _all_but_one(docs: DataFrame, pairs: DataFrame, largest: bool, label: str) -> DataFrame:
    """The rows (``doc_id``: keys) to drop from groups, so that the one of smallest or largest id stays.

    ``pairs`` (doc_id, first) has the key of each row but one of a group, and the
    key of that one. Null ids are kept only without others; of equal ids the
    smallest key stays.
    """
    pairs = materialize(pairs, f"{label}_groups")
    rows = pairs.unionByName(pairs.select(F.col("first").alias("doc_id"), "first").distinct())
    ids = docs.select(F.col(KEY).alias("doc_id"), F.col("doc_id").alias("id"))
    if largest:
        best = F.max_by("doc_id", F.struct(F.col("id").isNotNull(), F.col("id"), -F.col("doc_id")))
    else:
        best = F.min_by("doc_id", F.struct(F.col("id").isNull(), F.col("id"), F.col("doc_id")))
    kept = rows.join(ids, "doc_id").groupBy("first").agg(best.alias("doc_id"))
    return rows.join(small(materialize(kept.select("doc_id"), f"{label}_kept"), 8), "doc_id", "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    docs = _keyed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    pa.default_memory_pool().release_unused()  # the sample's texts, which the driver needs no more
    found = toxicity.score(docs, model, id_col=KEY).where("predicted = 1")
    return _without(docs, found.withColumnRenamed(KEY, "doc_id"), "toxic")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    docs = _keyed(docs)
    found = exact_dedup.exact_duplicates(docs, id_col=KEY).where("not kept")
    found = found.select("doc_id", F.col("keep_id").alias("first"))
    return _without(docs, _all_but_one(docs, found, True, "copies"), "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates (five words, 0.8)."""
    docs = _keyed(docs)
    found = ngram_join.near_duplicates(docs, id_col=KEY, words=5, similarity=(80, 100))
    found = found.where("doc_id <> component_id").select("doc_id", F.col("component_id").alias("first"))
    return _without(docs, _all_but_one(docs, found, False, "near"), "near")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item, its words in place or nearly so."""
    docs = _keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contamination(docs, items, id_col=KEY, slop=decontaminate.SLOP)
    return _without(docs, found.where("size(near_spans) > 0"), "leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, with digests of them and of the text they decode to."""
    _bounded(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, ranks, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode),
]

#: None: fitted scores and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, "stage" + "".join(c if c.isalnum() else "_" for c in name))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
