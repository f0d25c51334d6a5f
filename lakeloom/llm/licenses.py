"""Licence notices: exact phrases, and short notices with a bounded number of edits.

A notice that occurs with at most k edits has, cut into k + 1 pieces, one piece
that occurs as it is (pigeonhole). Occurrences of pieces mark the only places
where a notice can stand; there the regex library's bounded-error matching
decides and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.text import ALNUM, Texts, chunks, rows_of

#: Exact phrases and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Short notices (words between blanks) and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution 4 0 international license", "cc-by"),
    ("all rights reserved", "proprietary"),
)


def edits_for(notice: str) -> int:
    """Edits allowed in a notice: one for each fifteen characters beyond ten, three at most."""
    return min(3, max(0, (len(notice) - 10) // 15))


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int
    pieces: tuple[tuple[int, bytes], ...]  # offset and content
    pattern: regex.Pattern


def compile_notices(notices: Sequence[tuple[str, str]]) -> list[Notice]:
    out = []
    for text, label in notices:
        k = edits_for(text)
        cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
        pieces = tuple((a, text[a:b].encode()) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        # BESTMATCH, so that of overlapping readings the one with fewest edits counts
        pattern = regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(text)}){{e<={k}}}(?!\S)")
        out.append(Notice(text, label, k, pieces, pattern))
    return out


def _find_all(text: bytes, piece: bytes) -> Iterator[int]:
    at = text.find(piece)
    while at >= 0:
        yield at
        at = text.find(piece, at + 1)


def _plain(chunk: Texts) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The chunk's words, one blank between; word starts therein; word count per text.

    Texts are kept apart by a line feed, which no notice contains.
    """
    low = chunk.lowered()
    starts, ends, counts = low.words(ALNUM)
    size = ends - starts
    place = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()) + 1, 32, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place, size) + inner + 1] = low.data[np.repeat(starts, size) + inner]
    firsts = (np.cumsum(counts) - counts)[counts > 0]
    out[place[firsts]] = 10
    if len(out):
        out[-1] = 10
    return out.tobytes(), place + 1, counts


def base_places(plain: bytes, phrases: Mapping[str, str]) -> list[tuple[int, str]]:
    """(position, label) of every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases.items():
        wanted = phrase.encode()
        for at in _find_all(plain, wanted):
            if plain[at - 1] in b" \n" and plain[at + len(wanted)] in b" \n":
                found.append((at, label))
    return found


def fuzzy_spans(plain: bytes, notices: Sequence[Notice]) -> list[tuple[int, int, str, float]]:
    """(start, end, label, score) of notices in a chunk of plain words; score is the share of characters kept.

    Of overlapping readings of a notice the one with fewest edits counts; no
    place outside the readings that count holds another.
    """
    found = []
    for notice in notices:
        windows = set()
        # an edit may be a character of four bytes
        reach = 4 * notice.edits
        for offset, piece in notice.pieces:
            for at in _find_all(plain, piece):
                a, b = max(0, at - offset - reach), min(len(plain), at - offset + len(notice.text) + reach)
                windows.add(_whole_words(plain, a, b, at, at + len(piece)))
        found += _verified(plain, windows, notice)
    return found


def _whole_words(plain: bytes, a: int, b: int, start: int, end: int) -> tuple[int, int]:
    """The words of the text around ``start`` to ``end`` that lie or begin between ``a`` and ``b``."""
    # a line feed ends the text on either side; blanks end words
    a = max(plain.rfind(b"\n", a, start) + 1, a)
    b = cut if (cut := plain.find(b"\n", end, b)) >= 0 else b
    a = max(plain.rfind(b" ", 0, a), plain.rfind(b"\n", 0, a)) + 1
    stops = [i for i in (plain.find(b" ", b), plain.find(b"\n", b)) if i >= 0]
    return a, min(stops, default=len(plain))


def _verified(plain: bytes, windows: set[tuple[int, int]], notice: Notice) -> list[tuple[int, int, str, float]]:
    """Readings of a notice in windows of whole words, best first; what each leaves of a window is searched again."""
    readings: list[tuple[int, int, int, int, int]] = []

    def search(a: int, b: int) -> None:
        if b - a < len(notice.text) - notice.edits:
            return
        part = plain[a:b].decode("utf-8", "replace")
        if m := notice.pattern.search(part):
            start = a + len(part[: m.start()].encode())
            heappush(readings, (sum(m.fuzzy_counts), start, start + len(m.group().encode()), a, b))

    for a, b in windows:
        search(a, b)
    taken: list[tuple[int, int]] = []  # in order, apart from each other
    out = []
    while readings:
        edits, start, stop, a, b = heappop(readings)
        at = bisect_left(taken, (start, stop))
        meets = [x for x in taken[max(0, at - 1) : at + 1] if x[0] < stop and start < x[1]]
        if not meets:
            taken.insert(at, (start, stop))
            out.append((start, stop, notice.label, 1 - edits / len(notice.text)))
            meets = [(start, stop)]
        # the parts of the window beside one that counts
        x, y = meets[0]
        search(a, x)
        search(y, b)
    return out


def _scan(names: list[str], phrases: Mapping[str, str], notices: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_notices(notices)
        for batch in batches:
            for chunk in chunks(batch.column(batch.num_columns - 1)):
                plain, place, counts = _plain(chunk)
                first = np.cumsum(counts) - counts
                base: dict[int, list] = {}
                spans: dict[int, list] = {}
                for at, label in base_places(plain, phrases):
                    word = int(np.searchsorted(place, at))
                    doc = int(np.searchsorted(first + counts, word, side="right"))
                    base.setdefault(doc, []).append((word - int(first[doc]), label))
                for a, b, label, score in fuzzy_spans(plain, compiled):
                    word = int(np.searchsorted(place, a, side="right")) - 1
                    last = int(np.searchsorted(place, b, side="left")) - 1
                    doc = int(np.searchsorted(first + counts, word, side="right"))
                    own = int(first[doc])
                    spans.setdefault(doc, []).append(
                        {"first_word": word - own, "last_word": last - own, "label": label, "score": score}
                    )
                rows = range(len(chunk))
                starts = [sorted(w for w, _ in base.get(d, [])) for d in rows]
                labels = [sorted({x for _, x in base.get(d, [])}) for d in rows]
                every = [sorted({*labels[d], *(s["label"] for s in spans.get(d, []))}) for d in rows]
                best = [
                    max([1.0] * bool(labels[d]) + [s["score"] for s in spans.get(d, [])], default=0.0) for d in rows
                ]
                ordered = [
                    sorted(spans.get(d, []), key=lambda s: (s["first_word"], s["last_word"], s["label"])) for d in rows
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows_of(batch, chunk, names),
                        pa.array(counts.astype(np.int64)),
                        pa.array(list(map(len, starts)), pa.int64()),
                        pa.array([s[0] if s else None for s in starts], pa.int64()),
                        pa.array([s[-1] if s else None for s in starts], pa.int64()),
                        pa.array(labels, pa.list_(pa.string())),
                        pa.array(every, pa.list_(pa.string())),
                        pa.array(best, pa.float64()),
                        pa.array(ordered, pa.list_(_SPAN)),
                    ],
                    [*names, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return run


_SPAN = pa.struct(
    [("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("score", pa.float64())]
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Mapping[str, str] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """Licence phrases and notices of every whole text, one row per row of ``docs``.

    Columns: the id; ``n_words``; ``n_base``, ``first_word`` and ``last_word``
    of the exact phrases (places, smallest and largest start, words from 0);
    ``base_labels`` and ``labels`` (with those of the notices), sorted arrays;
    ``score``, the best share of a notice's characters that a match keeps, 1 for
    an exact phrase, 0 without any; ``spans`` (first_word, last_word, label,
    score) of the notices found.

    Words are runs of letters and digits after lower-casing A-Z; what stands
    between words does not count, neither in phrases nor in notices. A notice
    found twice in one place counts once per label. Null and empty texts have no
    words and score 0; null and repeated ids are rows like others; an empty
    table gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text_"))
    kind = source.schema[0].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
        "base_labels array<string>, labels array<string>, score double, "
        "spans array<struct<first_word:bigint,last_word:bigint,label:string,score:double>>"
    )
    return source.mapInArrow(_scan([id_col], dict(phrases), list(notices)), schema)
