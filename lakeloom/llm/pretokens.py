"""Pre-tokens of the byte-level tokenizers, found for whole batches by array operations.

The pattern is the public one of those tokenizers:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import functools

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Code points with the White_Space property.
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for base in range(0, 0x110000, 0x8000):
        points = [p for p in range(base, base + 0x8000) if not 0xD800 <= p < 0xE000]
        block = "".join(map(chr, points))
        for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
            for m in regex.finditer(name, block):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
    table[WHITE] = SPACE
    return table


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of all pre-tokens of the texts, and their count per text.

    ``data`` holds the texts' UTF-8 end to end; every byte belongs to one
    pre-token, so a pre-token ends where the next one or the text starts.
    """
    size = int(offsets[-1])
    if not size:
        return np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    data = data[:size]
    if data.max() < 128:
        points, at = data, None
    else:
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)  # where a text starts
    cuts = offsets if at is None else np.searchsorted(at, offsets)
    first[cuts] = True
    # runs of one class within one text
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    is_space = kind == SPACE
    starts = run[:n].copy()
    # the last white space before a run: a blank joins it, anything else stands alone
    head = np.flatnonzero(run[1:n] & is_space[:-1] & ~first[1:n]) + 1
    starts[head - 1] = True
    blank = points[head - 1] == 32
    starts[head[blank]] = False
    # contractions: an apostrophe alone, not joined to a blank, before certain letters
    quote = np.flatnonzero((points[: n - 1] == 39) & starts[: n - 1] & run[1:n] & ~first[1:n])
    if len(quote):
        one = points[quote + 1]
        two = points[np.minimum(quote + 2, n - 1)]
        inside = (quote + 2 < n) & ~first[np.minimum(quote + 2, n)]
        length = np.zeros(len(quote), np.int64)
        length[np.isin(one, [ord(c) for c in "stmd"])] = 2
        for a, b in ("re", "ve", "ll"):
            length[inside & (one == ord(a)) & (two == ord(b))] = 3
        quote, length = quote[length > 0], length[length > 0]
        starts[quote + 1] = False
        end = quote + length
        end = end[end < n]
        # what is left of the letters, or the next run, starts behind; a blank that starts there does so already
        starts[end[~is_space[end]]] = True
    found = np.flatnonzero(starts)
    counts = np.diff(np.searchsorted(found, cuts))
    return (found if at is None else at[found]), counts
