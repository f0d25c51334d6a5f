"""Quality by an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

A text is its UTF-8 bytes with ``ORDER - 1`` start marks in front. Every task
counts the n-grams of its trusted texts; the counts meet in joins sharded by
n-gram and language. The n-grams of all documents, each once per task, ask for
their probability, which is put together order by order by joins with the
counts. The answers come back in shards of bounded size, one pass over the
documents for each, and add up to each document's perplexity. A document is kept
up to a quantile of its language's trusted texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.tables import HashTable, small, with_row_key
from lakeloom.llm.text import Texts, chunks, mix, rows_of
from lakeloom.session import materialize

U8 = np.uint64
#: Bytes of the longest n-gram; an n-gram of up to seven bytes is one 64-bit number.
ORDER = 5
#: Answers broadcast at a time, 24 bytes each in the workers' tables.
SHARD_ROWS = 4_000_000
#: Quantile of the trusted texts' perplexity up to which a language's documents are kept.
QUANTILE = 0.99
#: Steps of log2 perplexity in the histograms that quantiles are read from.
STEP = 0.001
#: The mark in front of a text; no UTF-8 text has this byte.
START = 0xFF


def grams(chunk: Texts, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as one number: the last byte is its lowest."""
    data = chunk.data[: chunk.size].astype(U8)
    place = np.arange(chunk.size) - np.repeat(chunk.offsets[:-1], np.diff(chunk.offsets))
    out = data.copy()
    for k in range(1, order):
        before = np.full(chunk.size, START, U8)
        before[k:] = data[:-k] if k < chunk.size else data[:0]
        before[place < k] = START
        out |= before << U8(8 * k)
    return out


def _tasks_counts(order: int):
    """(lang, gram, count) of a task's texts; a task holds a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str | None) -> pa.RecordBatch:
            key, count = held.pop(lang)
            names = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(key), np.int32)))
            return pa.RecordBatch.from_arrays([names, pa.array(key.view(np.int64)), pa.array(count)], ["lang", "gram", "count"])

        for batch in batches:
            for chunk in chunks(batch.column(1)):
                langs = rows_of(batch, chunk, ["lang"])[0].to_pylist()
                gram = grams(chunk, order)
                size = np.diff(chunk.offsets)
                for lang in dict.fromkeys(langs):
                    mine = np.array([x == lang for x in langs], bool)
                    key, count = np.unique(gram[np.repeat(mine, size)], return_counts=True)
                    if lang in held:
                        old, number = held[lang]
                        both, at = np.unique(np.concatenate([old, key]), return_inverse=True)
                        count = np.bincount(at, np.concatenate([number, count]), len(both)).astype(np.int64)
                        key = both
                    held[lang] = key, count
                    if len(key) > 2_000_000:
                        yield out(lang)
        for lang in list(held):
            yield out(lang)

    return run


def task_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, count), summed within tasks, of (lang, text)."""
    return docs.select("lang", "text").mapInArrow(_tasks_counts(order), "lang string, gram bigint, count bigint")


def _low(gram: str, size: int) -> Column:
    """The last ``size`` bytes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * size) - 1))


class KneserNey:
    """Counts of each order, and what its contexts leave to the order below.

    ``levels[k]``: (lang, gram, adjusted) with the share of an n-gram of k + 1
    bytes after its discount; ``rests[k]``: (lang, context, rest).
    """

    def __init__(self, counts: DataFrame, order: int = ORDER):
        self.order = order
        self.levels: list[DataFrame] = []
        self.rests: list[DataFrame] = []
        table = counts
        for size in range(order, 0, -1):
            adjusted, rest = self._discounted(table, size)
            self.levels.insert(0, adjusted)
            self.rests.insert(0, rest)
            # below the top, an n-gram counts once for each byte seen in front of it
            table = materialize(
                table.groupBy("lang", _low("gram", size - 1).alias("gram")).agg(F.count(F.lit(1)).alias("count")),
                f"continued{size - 1}",
            )

    @staticmethod
    def _discounted(table: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        """Modified discounts of one order, by language: for counts of one, two, and three or more."""
        seen = [F.sum(F.when(F.col("count") == n, 1).otherwise(0)).alias(f"n{n}") for n in (1, 2, 3, 4)]
        found = table.groupBy("lang").agg(*seen)
        y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.0))
        discount = lambda n: F.when(F.col(f"n{n}") == 0, 0.5).otherwise(
            F.least(
                F.lit(n - 0.05),
                F.greatest(F.lit(0.05), n - (n + 1) * y * F.try_divide(F.col(f"n{n + 1}"), F.col(f"n{n}"))),
            )
        )
        discounts = small(
            materialize(found.select("lang", *(discount(n).alias(f"d{n}") for n in (1, 2, 3))), f"discounts{size}"), 64
        )
        marked = table.join(discounts, table["lang"].eqNullSafe(discounts["lang"]), "inner").select(
            table["lang"],
            "gram",
            "count",
            F.shiftright("gram", 8).alias("context"),
            F.when(F.col("count") == 1, F.col("d1")).when(F.col("count") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"),
        )
        marked = materialize(marked, f"marked{size}")
        contexts = materialize(
            marked.groupBy("lang", "context").agg(F.sum("count").alias("total"), F.sum("d").alias("left")),
            f"contexts{size}",
        )
        c = contexts.withColumnsRenamed({"lang": "l", "context": "c"})
        adjusted = marked.join(c, marked["lang"].eqNullSafe(c["l"]) & (F.col("context") == F.col("c"))).select(
            "lang", "gram", ((F.col("count") - F.col("d")) / F.col("total")).alias("share")
        )
        rest = contexts.select("lang", "context", (F.col("left") / F.col("total")).alias("rest"))
        return materialize(adjusted, f"shares{size}"), rest

    def log2_probabilities(self, asked: DataFrame) -> DataFrame:
        """(lang, gram, logp) of distinct (lang, gram) of the highest order."""
        wanted = {self.order: asked}
        for size in range(self.order - 1, 0, -1):
            wanted[size] = materialize(
                wanted[size + 1].select("lang", _low("gram", size).alias("gram")).distinct(), f"asked{size}"
            )
        below = None
        for size in range(1, self.order + 1):
            rows = wanted[size].select(
                "lang", "gram", F.shiftright("gram", 8).alias("context"), _low("gram", size - 1).alias("suffix")
            )
            share = self.levels[size - 1].withColumnsRenamed({"lang": "l", "gram": "g"})
            rest = self.rests[size - 1].withColumnsRenamed({"lang": "l2", "context": "c"})
            rows = rows.join(share, F.col("lang").eqNullSafe(F.col("l")) & (F.col("gram") == F.col("g")), "left").join(
                rest, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("context") == F.col("c")), "left"
            )
            if below is None:  # every byte value has the same chance at the bottom
                rows = rows.withColumn("p0", F.lit(1 / 256))
            else:
                lower = below.withColumnsRenamed({"lang": "l3", "gram": "g3", "p": "p0"})
                rows = rows.join(lower, F.col("lang").eqNullSafe(F.col("l3")) & (F.col("suffix") == F.col("g3")))
            p = F.coalesce("share", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("p0")
            below = materialize(rows.select("lang", "gram", p.alias("p")), f"chance{size}")
        return below.select("lang", "gram", F.log2("p").alias("logp"))


def _sums(shard, order: int):
    """Sums of a shard's answers over each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = {}
        for lang, (key, value) in shard.value.items():
            answers[lang] = HashTable(mix(key + U8(1)), np.arange(1, len(key) + 1)), np.append(np.float32(0), value)
        for batch in batches:
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                langs = rows_of(batch, chunk, ["lang"])[0].to_pylist()
                gram = grams(chunk, order)
                size = np.diff(chunk.offsets)
                logp = np.zeros(len(gram), np.float64)
                for lang in dict.fromkeys(langs):
                    if lang in answers:
                        table, value = answers[lang]
                        mine = np.flatnonzero(np.repeat(np.array([x == lang for x in langs], bool), size))
                        logp[mine] = value[table.get(mix(gram[mine] + U8(1)))]
                total = np.concatenate([[0.0], np.cumsum(logp)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows_of(batch, chunk, ["doc_id", "lang", "_row_"]),
                        pa.array(size.astype(np.int64)),
                        pa.array(total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]),
                    ],
                    ["doc_id", "lang", "_row_", "n_bytes", "logp"],
                )

    return run


def _shards(answers: DataFrame) -> Iterator[dict]:
    """Answers by language, in shards of a bounded number of rows."""
    total = answers.count()
    shards = max(1, -(-total // SHARD_ROWS))
    for shard in range(shards):
        part = answers.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == shard) if shards > 1 else answers
        table = part.select("lang", "gram", F.col("logp").cast("float").alias("logp")).toArrow()
        langs = pc.fill_null(table.column("lang"), _NO_LANGUAGE)
        key, value = table.column("gram").to_numpy().view(U8), table.column("logp").to_numpy()
        out = {}
        for lang in pc.unique(langs).to_pylist():
            mine = pc.equal(langs, lang).to_numpy()
            out[None if lang == _NO_LANGUAGE else lang] = key[mine], value[mine]
        yield out


#: Stands for a null language; no character.
_NO_LANGUAGE = "\uffff"


def perplexities(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    quantile: float = QUANTILE,
) -> DataFrame:
    """(doc_id, lang, n_bytes, trusted, bits, perplexity, threshold, kept), one row per row of ``docs``.

    ``trusted`` holds ids (column ``id_col``) of trusted documents. ``bits`` is
    minus the mean log2 probability of a text's bytes and ``perplexity`` two to
    the power of it. ``threshold`` is the ``quantile`` of the perplexities of
    the language's trusted documents, rounded up to a thousandth of a bit;
    documents up to it are kept.

    A null or empty text has no perplexity and is not kept. A language without
    trusted text, null among them, has no model: its documents have the
    uniform 256 as perplexity, no threshold, and are kept. Null ids are never
    trusted; repeated ids are rows like others. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    columns = [F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")]
    source = with_row_key(docs, columns, "keyed").select("doc_id", "lang", "_row_", "text")
    kind = source.schema[0].dataType.simpleString()
    ids = materialize(trusted.select(F.col(id_col).alias("doc_id")).where("doc_id is not null").distinct(), "trusted")
    ids = small(ids, 16)
    counts = materialize(
        task_counts(source.join(ids, "doc_id", "left_semi"), order)
        .groupBy("lang", "gram")
        .agg(F.sum("count").alias("count")),
        "counts",
    )
    model = KneserNey(counts, order)
    modelled = counts.select("lang").distinct().withColumnRenamed("lang", "l")
    asked = task_counts(source, order).select("lang", "gram").distinct()
    asked = asked.join(small(materialize(modelled, "modelled"), 16), F.col("lang").eqNullSafe(F.col("l")), "left_semi")
    answers = model.log2_probabilities(materialize(asked, f"asked{order}"))
    parts = None
    number = 0
    for shard in _shards(answers):
        sent = spark.sparkContext.broadcast(shard)
        part = source.select("doc_id", "lang", "_row_", "text").mapInArrow(
            _sums(sent, order), f"doc_id {kind}, lang string, _row_ binary, n_bytes bigint, logp double"
        )
        part = materialize(part, f"sums{number}")
        parts = part if parts is None else parts.unionByName(part)
        number += 1
    if number > 1:
        parts = parts.groupBy("_row_").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("lang").alias("lang"),
            F.first("n_bytes").alias("n_bytes"),
            F.sum("logp").alias("logp"),
        )
    known = small(materialize(modelled, "known"), 16).withColumn("has_model", F.lit(True))
    scored = (
        parts.join(known, F.col("lang").eqNullSafe(F.col("l")), "left")
        .join(ids.withColumn("trusted", F.lit(True)), "doc_id", "left")
        .select(
            "doc_id",
            "lang",
            "n_bytes",
            F.coalesce("trusted", F.lit(False)).alias("trusted"),
            F.coalesce("has_model", F.lit(False)).alias("has_model"),
            F.when(F.col("n_bytes") > 0, F.when(F.col("has_model"), -F.col("logp") / F.col("n_bytes")).otherwise(8.0)).alias(
                "bits"
            ),
        )
    )
    scored = materialize(scored, "scored")
    limits = small(materialize(_thresholds(scored, quantile), "limits"), 64)
    return scored.join(limits, F.col("lang").eqNullSafe(F.col("l")), "left").select(
        "doc_id",
        "lang",
        "n_bytes",
        "trusted",
        "bits",
        F.pow(F.lit(2.0), F.col("bits")).alias("perplexity"),
        F.pow(F.lit(2.0), F.col("limit")).alias("threshold"),
        F.coalesce((F.col("bits") <= F.col("limit")) | (~F.col("has_model") & F.col("bits").isNotNull()), F.lit(False)).alias(
            "kept"
        ),
    )


def _thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(l, limit) in bits, from histograms of all trusted documents: a few thousand steps a language."""
    steps = (
        scored.where("trusted and has_model and bits is not null")
        .groupBy("lang", F.ceil(F.col("bits") / STEP).alias("step"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = Window.partitionBy("lang").orderBy("step")
    whole = Window.partitionBy("lang")
    reached = steps.withColumn("below", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(whole))
    return (
        reached.where(F.col("below") >= quantile * F.col("total"))
        .groupBy(F.col("lang").alias("l"))
        .agg((F.min("step") * STEP).alias("limit"))
    )
