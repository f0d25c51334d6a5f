import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import pretokens, text

PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
TEXTS = st.lists(
    st.text(alphabet=" \n\t'stmdrevl'a1é漢!? 　x", max_size=30) | st.text(max_size=20), max_size=6
)


def pieces(texts):
    chunk = next(text.chunks(pa.array(texts, pa.string()), 1 << 20), None)
    if chunk is None:
        return []
    starts, counts = pretokens.spans(chunk.data, chunk.offsets)
    ends = np.append(starts, chunk.size)[1:]
    found = [chunk.data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    out, k = [], 0
    for c in counts:
        out.append(found[k : k + c])
        k += c
    return out


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pretokens_are_the_matches_of_the_pattern(texts):
    texts = [t.translate({c: None for c in (28, 29, 30, 31)}) for t in texts]
    assert pieces(texts) == [PATTERN.findall(t) for t in texts]


def test_contractions():
    texts = ["it's 'stuff' 're'll\n'll don't ''s 's's I'd'x \"'s", "'", "'s", "a'", "' s", "'re", "'r", "x'v"]
    assert pieces(texts) == [PATTERN.findall(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n-x9", max_size=40), max_size=6))
def test_words(texts):
    rule = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = []
    for chunk in text.chunks(pa.array(texts, pa.string()), 8):
        low = chunk.lowered()
        starts, ends, counts = low.words(text.ALNUM)
        found = [low.data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        k = 0
        for c in counts:
            got.append(found[k : k + c])
            k += c
    assert got == [rule.findall(text.lower_ascii(t)) for t in texts]


def test_hashes_depend_on_content_only():
    words = ["a", "b", "ab", "a" * 8, "a" * 9, "a" * 300, "a" * 301, "", "a"]
    whole = pa.array([" ".join(words), "x " + " ".join(words)])
    chunk = next(text.chunks(whole))
    starts, ends, counts = chunk.words(text.BLANK_SPLIT)
    h = chunk.span_hashes(starts, ends)
    n = counts[0]
    assert list(h[:n]) == list(h[n + 1 :])
    assert len(set(h[:n].tolist())) == n - 1


def test_shingles():
    chunk = next(text.chunks(pa.array(["a b c d", "a b", "", "b c d", "b c"])))
    starts, ends, counts = chunk.words(text.BLANK_SPLIT)
    h, made = text.shingle_hashes(chunk.span_hashes(starts, ends), counts, 3)
    assert made.tolist() == [2, 1, 0, 1, 1]
    assert h[1] == h[3] and len(set(h.tolist())) == 4
