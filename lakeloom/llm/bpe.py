"""Byte-level BPE by ranks, encoding and decoding.

Two tiers find a pre-token's ids. A minimal perfect hash over the vocabulary
resolves pre-tokens that are entries as a whole, many at a time. The others are
merged with a heap over linked bytes, once per worker; their ids are cached.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.pretokens import spans
from lakeloom.llm.tables import HashTable
from lakeloom.llm.text import Texts, chunks, mix, rows_of, span_hashes

U8 = np.uint64
#: Ids a worker caches for pre-tokens that are no entries before it starts over.
CACHE_IDS = 4_000_000


def read_ranks(content: bytes) -> list[bytes]:
    """Entries by rank from lines of base64 and rank; ranks run from 0 without gaps."""
    pairs = [line.split() for line in content.splitlines() if line]
    entries: list[bytes | None] = [None] * len(pairs)
    for text, rank in pairs:
        entries[int(rank)] = base64.b64decode(text)
    if any(e is None for e in entries):
        raise ValueError("ranks must run from 0 without gaps")
    return entries


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: every key has a slot of its own among ``len(keys)``.

    Keys are dealt to buckets. Large buckets come first; each gets the first
    displacement that sends all its keys to free slots. A bucket of one key
    names a free slot outright, as a negative displacement.
    """

    def __init__(self, keys: np.ndarray):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        if len(np.unique(keys)) != n:
            raise ValueError("keys must be distinct")
        bucket = self.bucket(keys)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.cumsum(size) - size
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        for k in range(int(size.max(initial=0)), 1, -1):
            left = np.flatnonzero(size == k)
            d = 1
            while len(left):
                # all buckets of this size try the same displacement; of two that collide the first one wins
                own = keys[order[first[left][:, None] + np.arange(k)]]
                slots = self.displaced(own, np.int64(d))
                fits = ~taken[slots].any(axis=1)
                row = np.sort(slots, axis=1)
                fits &= (row[:, 1:] != row[:, :-1]).all(axis=1)
                fit = np.flatnonzero(fits)
                _, at = np.unique(slots[fit].ravel(), return_index=True)
                won = fit[np.bincount(at // k, minlength=len(fit)) == k]
                taken[slots[won].ravel()] = True
                self.shift[left[won]] = d
                left = np.delete(left, won)
                d += 1
        single = np.flatnonzero(size == 1)
        self.shift[single] = -1 - np.flatnonzero(~taken)[: len(single)]

    def bucket(self, keys: np.ndarray) -> np.ndarray:
        return (keys % U8(self.buckets)).astype(np.int64)

    def displaced(self, keys: np.ndarray, d) -> np.ndarray:
        return (mix(keys ^ mix(np.atleast_1d(np.asarray(d)).astype(U8))) % U8(self.n)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        d = self.shift[self.bucket(keys)]
        out = -1 - d
        far = np.flatnonzero(d >= 0)
        out[far] = self.displaced(keys[far], d[far])
        return out


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.offsets = np.cumsum([0, *map(len, entries)])
        self.data = np.zeros(int(self.offsets[-1]) + 8, np.uint8)
        self.data[:-8] = np.frombuffer(b"".join(entries), np.uint8)
        hashes = span_hashes(self.data, self.offsets[:-1], self.offsets[1:])
        self.perfect = PerfectHash(hashes)
        self.id_at = np.zeros(len(entries), np.int64)
        self.id_at[self.perfect.slots(hashes)] = np.arange(len(entries))
        self.entries = entries
        self.forget()

    @functools.cached_property
    def merges(self) -> tuple[list[int], dict[int, int]]:
        """Ids of single bytes, and of pairs (left id, right id); not needed to decode."""
        rank = {e: i for i, e in enumerate(self.entries)}
        pairs = {
            rank[e[:k]] << 32 | rank[e[k:]]: i
            for i, e in enumerate(self.entries)
            for k in range(1, len(e))
            if e[:k] in rank and e[k:] in rank
        }
        return [rank[bytes([b])] for b in range(256)], pairs

    def forget(self) -> None:
        self.cache = HashTable(np.empty(0, U8), np.empty(0, np.int32), 16)
        self.starts, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def whole(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Ids of the spans that are entries as a whole, else -1; compares all bytes."""
        ids = self.id_at[self.perfect.slots(hashes)]
        size = ends - starts
        same = np.flatnonzero(size == self.offsets[ids + 1] - self.offsets[ids])
        a = np.ndarray((len(texts.data) - 7,), "<u8", texts.data, strides=(1,))
        b = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        out = np.full(len(ids), -1, np.int64)
        step = 0
        while len(same):
            left = size[same] - step
            mask = ~U8(0) >> (U8(8) * (U8(8) - np.clip(left, 1, 8).astype(U8)))
            same = same[((a[starts[same] + step] ^ b[self.offsets[ids[same]] + step]) & mask) == 0]
            step += 8
            ended = size[same] <= step
            out[same[ended]] = ids[same[ended]]
            same = same[~ended]
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        byte_ids, pairs = self.merges
        ids = [byte_ids[b] for b in piece]
        n = len(ids)
        get = pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            i, r = x & 0xFFFFFFFFFF, x >> 40
            j = after[i]
            if ids[i] < 0 or j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                s = get(r << 32 | ids[j])
                if s is not None:
                    push(heap, s << 40 | i)
            k = before[i]
            if k >= 0:
                s = get(ids[k] << 32 | r)
                if s is not None:
                    push(heap, s << 40 | k)
        return [i for i in ids if i >= 0]

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, end to end, and their count per text."""
        starts, counts = spans(texts.data, texts.offsets)
        ends = np.append(starts, texts.size)[1:]
        hashes = texts.span_hashes(starts, ends)
        ids = self.whole(texts, starts, ends, hashes)
        miss = np.flatnonzero(ids < 0)
        size = np.ones(len(ids), np.int64)
        if len(miss):
            place = self.cache.get(hashes[miss])
            new = miss[place == 0]
            if len(new):
                if len(self.ids) > CACHE_IDS:
                    self.forget()
                    return self.encode(texts)
                key, first = np.unique(hashes[new], return_index=True)
                flat, sizes = array("I"), np.empty(len(key), np.int64)
                for i, (a, b) in enumerate(zip(starts[new[first]].tolist(), ends[new[first]].tolist(), strict=True)):
                    found = self.merge(texts.data[a:b].tobytes())
                    sizes[i] = len(found)
                    flat.extend(found)
                self.cache.add(key, np.arange(len(key)) + len(self.starts))
                self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(sizes))
                self.ids = np.append(self.ids, np.frombuffer(flat, np.uint32))
                place = self.cache.get(hashes[miss])
            size[miss] = self.starts[place] - self.starts[place - 1]
        out = np.empty(int(size.sum()), np.uint32)
        at = np.cumsum(size) - size
        direct = np.flatnonzero(ids >= 0)
        out[at[direct]] = ids[direct]
        if len(miss):
            n = size[miss]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(at[miss], n) + inner] = self.ids[np.repeat(self.starts[place - 1], n) + inner]
        per = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(counts)
        return out, per[last] - per[last - counts]

    def decode(self, ids: np.ndarray) -> bytes:
        first = self.offsets[ids]
        size = self.offsets[ids.astype(np.int64) + 1] - first
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return self.data[np.repeat(first, size) + inner].tobytes()


_MADE: dict[bytes, Bpe] = {}


def _load(content: bytes) -> Bpe:
    """Kept by the worker from task to task, with its cache."""
    tag = hashlib.sha256(content).digest()
    if tag not in _MADE:
        _MADE.clear()
        _MADE[tag] = Bpe(read_ranks(content))
    return _MADE[tag]


def _content(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _ids(bpe: Bpe, batch: pa.RecordBatch, id_col: str) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batch.column(1)):
        ids, counts = bpe.encode(chunk)
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.view(np.int32))
        )
        yield pa.RecordBatch.from_arrays([*rows_of(batch, chunk, [id_col]), lists], [id_col, "ids"])


def _decoded(bpe: Bpe, batch: pa.RecordBatch, id_col: str) -> pa.RecordBatch:
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = [bpe.decode(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [id_col, "ids", "decoded"])


def _digested(batch: pa.RecordBatch, id_col: str, with_ids: bool) -> pa.RecordBatch:
    lists = batch.column(1)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    texts = [hashlib.sha256(t or b"").hexdigest() for t in batch.column(2).to_pylist()]
    columns = [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(ids, pa.string()), pa.array(texts, pa.string())]
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    if with_ids:
        columns.append(lists)
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def _digest_schema(id_col: str, kind: str, with_ids: bool) -> str:
    return f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the ids of every whole text, one row per row of ``docs``.

    ``ranks_path`` holds lines of base64 and rank and is read by the driver.
    Each match of the byte-level pattern is encoded by itself; there are no
    special tokens. Null and empty texts have no ids; null and repeated document
    ids are rows like others; an empty table gives no rows. Other columns are
    not read.
    """
    content = _content(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(content.value)
        for batch in batches:
            yield from _ids(bpe, batch, id_col)

    source = docs.select(F.col(id_col), F.col(text_col).alias("_text_"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary) from what ``encode`` returns; null ids decode to nothing."""
    content = _content(tokens, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(content.value)
        for batch in batches:
            yield _decoded(bpe, batch, id_col)

    source = tokens.select(id_col, "ids")
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def with_digests(decoded: DataFrame, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of what ``decode`` returns; the ids too if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digested(batch, id_col, with_ids)

    source = decoded.select(id_col, "ids", "decoded")
    return source.mapInArrow(run, _digest_schema(id_col, source.schema[0].dataType.simpleString(), with_ids))


def round_trip(
    docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``with_digests`` of the ids that ``encode`` gives and of the bytes that ``decode`` makes of them.

    One worker of a task does all three, so that the tables of the vocabulary are
    held once and ids are decoded where they were made.
    """
    content = _content(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _load(content.value)
        for batch in batches:
            for ids in _ids(bpe, batch, id_col):
                yield _digested(_decoded(bpe, ids, id_col), id_col, with_ids)

    source = docs.select(F.col(id_col), F.col(text_col).alias("_text_"))
    return source.mapInArrow(run, _digest_schema(id_col, source.schema[0].dataType.simpleString(), with_ids))
