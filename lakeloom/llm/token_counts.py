"""Token counts by a map-side two-tier lookup; no pre-token is shuffled.

Every task summarises its frequent pre-tokens and the summaries are merged up a
tree; the most frequent of all become a compact hash table from pre-token to its number of tokens, which is
broadcast. A second pass adds up the lengths per document. What the table
lacks is encoded by the tokenizer's own library once per worker and kept in a
cache of the same shape.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.pretokens import spans
from lakeloom.llm.tables import HashTable
from lakeloom.llm.text import Texts, chunks, per_text, rows_of

#: Pre-tokens in the broadcast table: at most this many, 12 bytes each at half load.
TABLE_SIZE = 65_536
#: Pre-tokens each task reports for it.
SUMMARY_SIZE = 16_384
#: Pre-tokens a worker caches before it starts over.
CACHE_SIZE = 500_000


def _tokenizer(model: bytes):
    # one thread: Spark has dealt out the cores, and each more thread keeps memory of its own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(model.decode("utf-8"))


def _special(model: bytes) -> regex.Pattern | None:
    """Special strings that the library cuts out of texts before it looks for pre-tokens."""
    names = sorted((t["content"] for t in json.loads(model)["added_tokens"]), key=len, reverse=True)
    return regex.compile(b"|".join(regex.escape(n.encode()) for n in names)) if names else None


def is_byte_level(model: bytes) -> bool:
    """Whether counts follow from pre-tokens alone; if not, whole texts go to the library."""
    if model[:1] != b"{":
        return False
    made = json.loads(model)
    pre = made.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    flags = ("lstrip", "rstrip", "single_word", "normalized")
    return bool(plain and not made.get("normalizer") and not any(t[f] for t in made["added_tokens"] for f in flags))


def _pieces(chunk: Texts, special: regex.Pattern | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Offsets of the texts cut at special strings, and which pieces are such strings."""
    if special is None:
        return chunk.offsets, None
    raw = chunk.data[: chunk.size].tobytes()
    found = []
    for m in special.finditer(raw):
        row = np.searchsorted(chunk.offsets, m.start(), side="right") - 1
        if m.end() <= chunk.offsets[row + 1]:
            found.append(m.span())
        else:  # it runs across two texts: look again inside the later ones
            found += _inside(raw, chunk.offsets, row, special, m)
    if not found:
        return chunk.offsets, None
    where = sorted(set(found))
    # a piece of no bytes may repeat an offset; it has no pre-tokens
    cuts = np.sort(np.concatenate([chunk.offsets, np.array(where, np.int64).ravel()]))
    marked = np.zeros(len(cuts) - 1, bool)
    for a, _ in where:
        marked[np.searchsorted(cuts, a, side="right") - 1] = True
    return cuts, marked


def _inside(raw: bytes, offsets: np.ndarray, row: int, special: regex.Pattern, m) -> list[tuple[int, int]]:
    out = []
    while row + 1 < len(offsets) and offsets[row] < m.end():
        out += [x.span() for x in special.finditer(raw, int(offsets[row]), int(offsets[row + 1]))]
        row += 1
    return out


def _summaries(model: bytes):
    special = _special(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, names = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)

        def shrink(limit: int) -> None:
            nonlocal keys, counts, names
            top = np.lexsort((keys, -counts))[:limit]
            keys, counts, names = keys[top], counts[top], names[top]

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                offsets, marked = _pieces(chunk, special)
                starts, _ = spans(chunk.data, offsets)
                ends = np.append(starts, chunk.size)[1:]
                hashes = chunk.span_hashes(starts, ends)
                key, first, count = np.unique(hashes, return_index=True, return_counts=True)
                top = np.argsort(-count, kind="stable")[:SUMMARY_SIZE]
                name = np.array(
                    [chunk.data[a:b].tobytes() for a, b in zip(starts[first[top]], ends[first[top]], strict=True)] + [b""],
                    object,
                )[:-1]
                keys, where = np.unique(np.concatenate([keys, key[top]]), return_inverse=True)
                merged, label = np.zeros(len(keys), np.int64), np.empty(len(keys), object)
                np.add.at(merged, where, np.concatenate([counts, count[top]]))
                label[where] = np.concatenate([names, name])
                counts, names = merged, label
                if len(keys) > 4 * SUMMARY_SIZE:
                    shrink(2 * SUMMARY_SIZE)
        shrink(SUMMARY_SIZE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names.tolist()], pa.list_(pa.binary())), pa.array([counts])], ["pieces", "counts"]
        )

    return run


def _merged(a: dict[bytes, int], b: dict[bytes, int]) -> dict[bytes, int]:
    """Two summaries as one of the ``TABLE_SIZE`` most frequent; of equal counts the smaller pre-tokens."""
    both = dict(a)
    for piece, count in b.items():
        both[piece] = both.get(piece, 0) + count
    if len(both) <= TABLE_SIZE:
        return both
    return dict(sorted(both.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE])


def frequent_lengths(docs: DataFrame, model: bytes, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of frequent pre-tokens of all texts: at most ``TABLE_SIZE``.

    Which ones are in the table decides the speed only. They come from bounded
    summaries, one a task, which are merged two by two up a tree: pre-tokens are
    not shuffled by key, and the driver gets the last few summaries.
    """
    summaries = docs.select(text_col).mapInArrow(_summaries(model), "pieces array<binary>, counts array<bigint>").rdd
    depth = max(2, math.ceil(math.log(max(2, summaries.getNumPartitions()), 8)))
    top = summaries.map(lambda r: dict(zip(map(bytes, r[0]), r[1], strict=True))).treeAggregate(
        {}, _merged, _merged, depth
    )
    pieces = sorted(top, key=lambda x: (-top[x], x))
    if not pieces:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    return _hash(pieces), _lengths(_tokenizer(model), pieces)


def _hash(pieces: list[bytes]) -> np.ndarray:
    offsets = np.cumsum([0, *map(len, pieces)])
    joined = Texts(np.frombuffer(b"".join(pieces), np.uint8), offsets)
    return joined.span_hashes(offsets[:-1], offsets[1:])


def _lengths(tokenizer, pieces: list[bytes]) -> np.ndarray:
    """Token counts of pre-tokens; the library's results are large, so a thousand at a time."""
    out: list[int] = []
    for at in range(0, len(pieces), 1024):
        texts = [p.decode() for p in pieces[at : at + 1024]]
        out += [len(m.ids) for m in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return np.array(out, np.int32)


class Counter:
    """Token counts of texts: the broadcast table first, then this worker's cache, then the library."""

    def __init__(self, model: bytes, keys: np.ndarray, values: np.ndarray):
        self.model, self.special = model, _special(model)
        self.table, self.tokenizer = HashTable(keys, values), None
        self.forget()

    def forget(self) -> None:
        self.cache = HashTable(np.empty(0, np.uint64), np.empty(0, np.int32), 16)

    def counts(self, chunk: Texts) -> np.ndarray:
        offsets, marked = _pieces(chunk, self.special)
        starts, found = spans(chunk.data, offsets)
        ends = np.append(starts, chunk.size)[1:]
        hashes = chunk.span_hashes(starts, ends)
        size = self.table.get(hashes)
        miss = np.flatnonzero(size == 0)
        if len(miss):
            size[miss] = got = self.cache.get(hashes[miss])
            new = miss[got == 0]
            if len(new):
                key, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
                pieces = [chunk.data[a:b].tobytes() for a, b in zip(starts[new[first]], ends[new[first]], strict=True)]
                if self.tokenizer is None:
                    self.tokenizer = _tokenizer(self.model)
                value = _lengths(self.tokenizer, pieces)
                size[new] = value[back]
                if self.cache.used + len(key) > CACHE_SIZE:
                    self.forget()
                self.cache.add(key, value)
        total = per_text(size, found)
        if marked is None:
            return total
        total[marked] = 1
        return np.add.reduceat(np.append(total, 0), np.searchsorted(offsets, chunk.offsets[:-1])) * (
            np.diff(chunk.offsets) > 0
        )


_COUNTERS: dict[bytes, Counter] = {}


def _counting(table, names: list[str], model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, keys, values = table.value
        if tag not in _COUNTERS:  # kept by the worker from task to task
            _COUNTERS.clear()
            _COUNTERS[tag] = Counter(model_of.value, keys, values)
        counter = _COUNTERS[tag]
        for batch in batches:
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                n = counter.counts(chunk)
                yield pa.RecordBatch.from_arrays(
                    [*rows_of(batch, chunk, names), pa.array(np.diff(chunk.offsets)), pa.array(n.astype(np.int64))],
                    [*names, "n_bytes", "n_tokens"],
                )

    return run


def _whole(model_of, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        if model[:1] == b"{":
            tokenizer = _tokenizer(model)

            def count(texts: list[str]) -> list[int]:
                return [len(m.ids) for m in tokenizer.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_proto=model)

            def count(texts: list[str]) -> list[int]:
                return [len(ids) for ids in processor.encode(texts, num_threads=1)]

        for batch in batches:
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                texts = [chunk.bytes_of(i).decode() for i in range(len(chunk))]
                counted = [n for at in range(0, len(texts), 256) for n in count(texts[at : at + 256])]
                yield pa.RecordBatch.from_arrays(
                    [*rows_of(batch, chunk, names), pa.array(np.diff(chunk.offsets)), pa.array(counted, pa.int64())],
                    [*names, "n_bytes", "n_tokens"],
                )

    return run


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens), one row per row of ``docs``, as the tokenizer's library counts them.

    ``tokenizer_path`` is a .json of ``tokenizers`` or a .model of
    ``sentencepiece``, read by the driver. Special strings inside texts count as
    the library's default has it; nothing is added, cut or padded. A null text
    is empty and has 0 tokens; null and repeated ids are rows like others; an
    empty table gives no rows. Other columns are not read.
    """
    with open(tokenizer_path, "rb") as file:
        model = file.read()
    spark = docs.sparkSession
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text_"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"
    sent = spark.sparkContext.broadcast(model)
    if not is_byte_level(model):
        return source.mapInArrow(_whole(sent, [id_col]), schema)
    keys, values = frequent_lengths(source, model, "_text_")
    tag = _hash([model, keys.tobytes()]).tobytes()
    return source.mapInArrow(_counting(spark.sparkContext.broadcast((tag, keys, values)), [id_col], sent), schema)
