"""Whole Arrow batches of text as byte arrays: words, word hashes and shingles without a Python loop per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U8 = np.uint64
_A, _B, _C = U8(0x9E3779B97F4A7C15), U8(0xBF58476D1CE4E5B9), U8(0x94D049BB133111EB)
#: Bytes of text handled at a time; arrays take some thirty times as much. A longer text is handled alone.
CHUNK_BYTES = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters and digits: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words between white space: [^\x20\x09-\x0D]+.
BLANK_SPLIT = np.ones(256, dtype=bool)
BLANK_SPLIT[[32, 9, 10, 11, 12, 13]] = False


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed; null is empty."""
    return LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U8(30))) * _B
    x = (x ^ (x >> U8(27))) * _C
    return x ^ (x >> U8(31))


class Texts:
    """Texts of a chunk of rows, end to end: ``data`` (with eight spare zero bytes) and ``offsets``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first_row: int = 0):
        self.size = len(data)
        self.data = np.zeros(self.size + 8, np.uint8)
        self.data[: self.size] = data
        self.offsets = offsets
        self.first_row = first_row

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        return Texts(LOWER[self.data[: self.size]], self.offsets, self.first_row)

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def words(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, count per text) of the runs of bytes that the table ``of`` allows."""
        inside = of[self.data[: self.size]]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        cuts = self.offsets[:-1]
        before[cuts[cuts < self.size]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        lasts = self.offsets[1:] - 1
        after[lasts[lasts >= 0]] = False
        ends = np.flatnonzero(inside & ~after) + 1
        counts = np.diff(np.searchsorted(starts, self.offsets))
        return starts, ends, counts

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span."""
        return span_hashes(self.data, starts, ends)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U8)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes spans of ``data``, eight bytes a step; ``data`` has eight spare bytes behind the last span."""
    if not len(starts):
        return np.empty(0, U8)
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    h = mix((size.astype(U8) + U8(1)) * _A ^ (eights[starts] & _MASKS[np.minimum(size, 8)]))
    rest = np.flatnonzero(size > 8)
    step = 8
    while len(rest) and step < 256:
        at, left = starts[rest] + step, size[rest] - step
        h[rest] = mix(h[rest] * _A ^ (eights[at] & _MASKS[np.minimum(left, 8)]))
        step += 8
        rest = rest[left > 8]
    for i in rest:  # very long words, one by one
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        h[i] = np.frombuffer(digest, "<u8")[0]
    return h


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``k`` consecutive words of each text, and their count per text.

    A text of fewer words, but not none, has its whole sequence as one.
    """
    n = len(words)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    h = np.full(n, U8(k))
    for j in range(k):
        step = np.zeros(n, U8)
        step[: max(0, n - j)] = words[j:]
        h = mix(h * _A + step)
    left = np.repeat(firsts[1:], counts) - np.arange(n)
    keep = left >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short:
        a, b = firsts[i], firsts[i + 1]
        v = U8(k)
        with np.errstate(over="ignore"):
            v = np.full(1, U8(b - a) * _C)
            for w in words[a:b]:
                v = mix(v * _A + w)
        h[a], keep[a] = v[0], True
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return h[keep], made


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cuts a string column into chunks of at most ``limit`` bytes (one row at least); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield Texts(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], row)
        row = end


def rows_of(batch: pa.RecordBatch, chunk: Texts, names: list[str]) -> list[pa.Array]:
    """The other columns of a chunk's rows."""
    return [batch.column(batch.schema.get_field_index(n)).slice(chunk.first_row, len(chunk)) for n in names]


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each text's share of them."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
