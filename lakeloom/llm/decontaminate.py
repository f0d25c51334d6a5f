"""Benchmark decontamination by a distributed positional inverted index.

The training texts are cut into segments of a few megabytes. A segment's
postings (term, positions) of the terms that test items use are stored as one
row, so the index is partitioned by document and grows with the texts. A search
takes each window of a test item, starts from the postings of its rarest term in
the segment, shifts them by the term's offset and intersects them with the
postings of the next rarer term, and so on. Positions are left where the whole
phrase stands or where every term stands within ``slop`` words of its place,
counted from one of them (proximity).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.text import ALNUM, chunks, rows_of
from lakeloom.llm.tables import with_row_key
from lakeloom.session import materialize

WINDOW = 10
#: Words that terms of a proximity match may be off their place, in registered queries.
SLOP = 2
#: Largest slop a search may ask for; texts of a segment lie further apart than this.
MAX_SLOP = 16
#: Words of test items searched for at a time; more items take more passes over the texts.
BLOCK_WORDS = 2_000_000

_INDEX = "n_words binary, terms binary, counts binary, positions binary, ids array<{id}>, rows array<binary>"
_HITS = (
    "row binary, doc_id {id}, n_words bigint, spans array<struct<first:bigint,last:bigint>>, "
    "near_spans array<struct<first:bigint,last:bigint>>, items array<{item}>, near_items array<{item}>"
)


class Windows:
    """Windows of a block of test items, as term numbers by offset (-1 behind a short item's end)."""

    def __init__(self, items: list[tuple], window: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        rows, owner, word_hash = [], [], []
        base = 0
        for chunk in chunks(texts):
            low = chunk.lowered()
            starts, ends, counts = low.words(ALNUM)
            word_hash.append(low.span_hashes(starts, ends))
            at = 0
            for i, n in enumerate(counts.tolist()):
                for k in range(max(0, n - window + 1)) if n >= window else range(min(1, n)):
                    size = min(n, window)
                    rows.append(np.pad(np.arange(base + at + k, base + at + k + size), (0, window - size), constant_values=-1))
                    owner.append(chunk.first_row + i)
                at += n
            base += at
        hashes = np.concatenate([*word_hash, np.empty(0, np.uint64)])
        self.terms, number = np.unique(hashes, return_inverse=True)
        at = np.array(rows, np.int64).reshape(-1, window)
        self.at = np.where(at < 0, -1, number[at] if len(number) else -1)
        self.length = (self.at >= 0).sum(axis=1)
        self.item = np.array(owner, np.int64)
        # equal windows are searched for once
        self.at, same = np.unique(self.at, axis=0, return_inverse=True) if len(self.at) else (self.at, np.empty(0, int))
        same = same.ravel()
        order = np.argsort(same, kind="stable")
        self.items_of = np.split(self.item[order], np.flatnonzero(np.diff(same[order])) + 1) if len(order) else []
        self.length = (self.at >= 0).sum(axis=1)
        bits = 1 << 20
        self.sieve = np.zeros(bits, bool)
        self.sieve[(self.terms & np.uint64(bits - 1)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words that no test item uses."""
        out = np.full(len(hashes), -1, np.int64)
        near = np.flatnonzero(self.sieve[(hashes & np.uint64(len(self.sieve) - 1)).astype(np.int64)])
        if len(self.terms) and len(near):
            at = np.minimum(np.searchsorted(self.terms, hashes[near]), len(self.terms) - 1)
            hit = self.terms[at] == hashes[near]
            out[near[hit]] = at[hit]
        return out


def _bases(n_words: np.ndarray) -> np.ndarray:
    """First position of each text in its segment; no window reaches from one into the next."""
    step = n_words + WINDOW_GAP
    return np.cumsum(step) - step


WINDOW_GAP = 2 * MAX_SLOP + 1


def _index(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = windows.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                low = chunk.lowered()
                starts, ends, counts = low.words(ALNUM)
                term = find.number(low.span_hashes(starts, ends))
                inner = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
                position = np.repeat(_bases(counts), counts) + inner
                keep = np.flatnonzero(term >= 0)
                order = keep[np.argsort(term[keep], kind="stable")]
                terms, size = np.unique(term[order], return_counts=True)
                ids, rows = rows_of(batch, chunk, ["doc_id", "_row_"])
                ends = pa.array([0, len(chunk)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                        pa.array([terms.astype("<u4").tobytes()], pa.binary()),
                        pa.array([size.astype("<u4").tobytes()], pa.binary()),
                        pa.array([position[order].astype("<u4").tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(ends, ids),
                        pa.ListArray.from_arrays(ends, rows),
                    ],
                    ["n_words", "terms", "counts", "positions", "ids", "rows"],
                )

    return run


def intersect(
    find: Windows, counts: np.ndarray, keys: np.ndarray, slop: int = 0, shift: int = 0
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first, last) of all matches in a segment: the positions of their outermost words.

    ``counts``: postings by term number; ``keys``: sorted (term << 32 | position).
    With ``slop``, the matches whose rarest term stands ``shift`` words behind its place.
    """
    nothing = (np.empty(0, np.int64),) * 3
    if not len(find.at) or not len(keys):
        return nothing
    size = np.where(find.at < 0, np.iinfo(np.int64).max, counts[find.at])
    live = np.flatnonzero(size.min(axis=1) > 0)
    if not len(live):
        return nothing
    order = np.argsort(size[live], axis=1, kind="stable")  # offsets from the rarest term on
    first_posting = np.concatenate([[0], np.cumsum(counts)])
    offset = order[:, 0]
    term = find.at[live, offset]
    n = counts[term]
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(live)), n)
    start = (keys[np.repeat(first_posting[term], n) + inner] & 0xFFFFFFFF) - offset[row] - shift
    first, last = np.full(len(row), 1 << 32), np.full(len(row), -1)
    in_place = np.zeros(len(row), bool)  # whether a term stands in its place
    length = find.length[live]
    for k in range(find.at.shape[1]):
        more = length[row] > k
        off = order[row, k]
        term = find.at[live[row], np.where(more, off, 0)]
        wanted = (term << 32) + start + off
        place = np.searchsorted(keys, wanted)
        found = keys[np.minimum(place, len(keys) - 1)]
        if slop:
            # the nearer one of the postings on both sides
            before = keys[np.maximum(place - 1, 0)]
            far = np.iinfo(np.int64).max
            ahead = np.where(found >> 32 == term, np.abs(found - wanted), far)
            behind = np.where(before >> 32 == term, np.abs(wanted - before), far)
            found = np.where(behind < ahead, before, found)
            hit = np.minimum(ahead, behind) <= slop
        else:
            hit = found == wanted
        keep = hit | ~more
        at = np.where(more, found & 0xFFFFFFFF, first)
        in_place = (in_place | (more & (found == wanted)))[keep]
        first, last = np.minimum(first, at)[keep], np.maximum(last, at)[keep]
        row, start = row[keep], start[keep]
        if not len(row):
            break
    return live[row[in_place]], first[in_place], last[in_place]


def near_matches(find: Windows, counts: np.ndarray, keys: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """(window, first, last) of all proximity matches, whichever of their terms stands in its place."""
    parts = [intersect(find, counts, keys, slop, shift) for shift in range(-slop, slop + 1)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _spans(base: np.ndarray, n_words: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.ListArray:
    """Runs of covered words of each text of a segment."""
    edge = np.zeros(int(base[-1] + n_words[-1]) + WINDOW_GAP + 1 if len(base) else 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    hit = np.concatenate([[False], np.cumsum(edge) > 0, [False]])
    turn = np.flatnonzero(hit[1:] != hit[:-1])
    first, last = turn[::2], turn[1::2] - 1
    doc = np.searchsorted(base, first, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(first - base[doc]), pa.array(last - base[doc])], ["first", "last"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(base) + 1)).astype(np.int32)), spans)


def _search(windows, slop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find: Windows = windows.value
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: np.frombuffer(batch.column(name)[row].as_py(), "<u4").astype(np.int64)  # noqa: B023, E731
                n_words, terms, size, position = map(get, ("n_words", "terms", "counts", "positions"))
                counts = np.zeros(len(find.terms) + 1, np.int64)
                counts[terms] = size
                keys = np.repeat(terms, size) << 32 | position
                base = _bases(n_words)
                window, first, last = intersect(find, counts, keys)
                spans, found = _spans(base, n_words, first, last), _items(find, window, first, base)
                nothing = np.empty(0, np.int64)
                window, first, last = near_matches(find, counts, keys, slop) if slop else (nothing,) * 3
                near_spans, near = _spans(base, n_words, first, last), _items(find, window, first, base)
                doc = range(len(base))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rows")[row].values,
                        batch.column("ids")[row].values,
                        pa.array(n_words),
                        spans,
                        near_spans,
                        pa.array([found.get(d, []) for d in doc], pa.list_(pa.int64())),
                        pa.array([near.get(d, []) for d in doc], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n_words", "spans", "near_spans", "items", "near_items"],
                )

    return run


def _items(find: Windows, window: np.ndarray, first: np.ndarray, base: np.ndarray) -> dict[int, list[int]]:
    """Item numbers found in each text of a segment, by the first word of each match."""
    doc = np.searchsorted(base, first, side="right") - 1
    pairs = np.unique(np.stack([doc, window], axis=1), axis=0) if len(doc) else np.empty((0, 2), int)
    out: dict[int, set[int]] = {}
    for d, w in pairs.tolist():
        out.setdefault(d, set()).update(find.items_of[w].tolist())
    return {d: sorted(i) for d, i in out.items()}


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Test items in blocks of bounded size, one at a time."""
    block, size, some = [], 0, False
    for row in items.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slop: int = 0,
) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, near_spans, items, near_items), one row per row of ``docs``.

    Words are runs of letters and digits after lower-casing A-Z. A window is
    ``window`` consecutive words of an item; an item of fewer, but not none, is
    one window. ``spans`` are the runs of document words inside occurrences of
    windows (first and last word, from 0), ``n_hit`` is their size, ``items``
    lists the ids of items with occurrences, as sorted strings. If ``slop`` > 0,
    ``near_spans`` and ``near_items`` are the same for proximity matches: one
    word of the window stands in the text and every other one within ``slop``
    words of its place counted from there; a span runs from the first to the
    last of these words. Occurrences are among them.

    Null and empty texts have no words; a null item matches nothing; an item
    whose id is null counts in ``n_hit`` and is listed nowhere; repeated rows of
    either table are rows like others. With no items every document is clean,
    with no documents there are no rows. Other columns are not read. Words are
    compared by 64-bit hashes. Items are searched for in blocks of bounded
    size; each block is broadcast and searched for in all documents.
    """
    if not 0 <= slop <= MAX_SLOP:
        raise ValueError(f"slop must be from 0 to {MAX_SLOP}")
    spark = docs.sparkSession
    source = with_row_key(docs, [F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text_")], "keyed")
    source = source.select("doc_id", "_row_", "_text_")
    kind = source.schema[0].dataType.simpleString()
    parts = []
    for number, block in enumerate(_blocks(items, item_id, item_text)):
        windows = spark.sparkContext.broadcast(Windows(block, window))
        index = materialize(source.mapInArrow(_index(windows), _INDEX.format(id=kind)), f"postings{number}")
        hits = index.mapInArrow(_search(windows, slop), _HITS.format(id=kind, item="bigint"))
        names = spark.sparkContext.broadcast([None if i is None else str(i) for i, _ in block])
        parts.append(hits.mapInArrow(_named(names), _HITS.format(id=kind, item="string")))
    hits = parts[0] if len(parts) == 1 else _merged(parts)
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end")),
        lambda a, x: F.struct(
            (a.n + F.greatest(F.lit(0), x.last - F.greatest(x.first, a.end + 1) + 1)).alias("n"),
            F.greatest(a.end, x.last).alias("end"),
        ),
        lambda a: a.n,
    )
    return hits.select("doc_id", "n_words", covered.alias("n_hit"), "spans", "near_spans", "items", "near_items")


def _named(names):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = names.value
        for batch in batches:
            lists = [
                pa.array([sorted({label[i] for i in x} - {None}) for x in batch.column(k).to_pylist()], pa.list_(pa.string()))
                for k in (5, 6)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *lists], batch.schema.names)

    return run


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Results of several blocks of items: a group has one row per block."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    grown = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        joined("spans").alias("spans"),
        joined("near_spans").alias("near_spans"),
        joined("items").alias("items"),
        joined("near_items").alias("near_items"),
    )

    def extend(runs: Column, x: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return F.when(
            (F.size(runs) > 0) & (x["first"] <= last["last"] + 1),
            F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer)),
        ).otherwise(F.concat(runs, F.array(x)))

    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return grown.withColumns({c: F.aggregate(c, none, extend) for c in ("spans", "near_spans")})


def items_digest(items: str = "items") -> Column:
    return F.sha2(F.array_join(items, ","), 256)
