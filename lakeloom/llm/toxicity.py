"""Toxicity: Levenshtein automata of a lexicon, and what surrounds a match.

The lexicon is learned from labelled texts. Its trie and the Levenshtein
automata of its terms are intersected into one deterministic automaton, which
all words of a batch pass at the same time. Each match counts by how far it is
from the term, how telling the term is, and whether its surroundings quote it.
A logistic model over these counts gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.tables import HashTable
from lakeloom.llm.text import ALNUM, Texts, chunks, mix, rows_of

#: Labelled texts of each class that terms and weights are learned from, at most: those of smallest hash.
TRAIN_ROWS = 4_000
#: Terms in the lexicon, at most: the most telling ones.
MAX_TERMS = 2_000
#: Terms from this many bytes on are also found with one edit.
FUZZY_BYTES = 5
#: Words on either side that make up a match's surroundings.
CONTEXT = 8
#: Words that announce a quotation.
CUES = ("said", "says", "wrote", "writes", "quote", "quoted", "called", "word", "term", "sagte", "dijo", "dit")

FEATURES = ("exact", "exact_quoted", "near", "near_quoted", "density", "any")
#: Weights the fit starts from and is drawn to: a quoted match counts for a third.
PRIOR = np.array([1.5, 0.5, 0.75, 0.25, 0.5, 1.0])


class Automaton:
    """The words within one edit of a term (terms shorter than ``FUZZY_BYTES``: only the terms).

    States are sets of (trie node, edits so far); byte classes are the bytes of
    the lexicon and all others together. ``found`` names, for each state, the
    best term that ends there, ``edits`` its edits, -1 where none does.
    """

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        longest = [0]  # longest term below each node, for which edits may still be spent
        for number, term in enumerate(terms):
            node = 0
            longest[0] = max(longest[0], len(term))
            for b in term:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    longest.append(0)
                node = children[node][b]
                longest[node] = max(longest[node], len(term))
            ends[node] = number
        letters = sorted({b for c in children for b in c})
        self.classes = np.zeros(256, np.int64)
        self.classes[letters] = np.arange(1, len(letters) + 1)

        def close(states: dict[int, int]) -> frozenset:
            # a letter of the term that the word leaves out
            for node, e in list(states.items()):
                if e == 0 and longest[node] >= FUZZY_BYTES:
                    for child in children[node].values():
                        states.setdefault(child, 1)
            return frozenset(states.items())

        def step(state: frozenset, b: int | None) -> frozenset:
            out: dict[int, int] = {}
            for node, e in state:
                child = children[node].get(b)
                if child is not None:
                    out[child] = min(out.get(child, 9), e)
                if e == 0 and longest[node] >= FUZZY_BYTES:
                    out.setdefault(node, 1)  # a letter too many
                    for other in children[node].values():
                        out.setdefault(other, 1)  # a letter instead of another
            return close(out)

        start = close({0: 0})
        number_of = {frozenset(): 0, start: 1}
        todo, rows = [frozenset(), start], []
        for state in todo:
            row = np.zeros(len(letters) + 1, np.int32)
            if state:
                likely = {b for node, _ in state for b in children[node]}
                other = step(state, None)
                for k, b in [(0, None), *((i + 1, b) for i, b in enumerate(letters))]:
                    made = step(state, b) if b in likely else other
                    if made not in number_of:
                        number_of[made] = len(number_of)
                        todo.append(made)
                    row[k] = number_of[made]
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.found = np.full(len(todo), -1, np.int32)
        self.edits = np.full(len(todo), -1, np.int8)
        for i, state in enumerate(todo):
            hits = [
                (e, ends[node])
                for node, e in state
                if node in ends and (e == 0 or len(terms[ends[node]]) >= FUZZY_BYTES)
            ]
            if hits:
                self.edits[i], self.found[i] = min(hits)

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term number, edits) of each word, -1 without a match."""
        state = np.ones(len(starts), np.int32)
        live = np.arange(len(starts))
        at = 0
        while len(live):
            live = live[starts[live] + at < ends[live]]
            now = self.table[state[live], self.classes[data[starts[live] + at]]]
            state[live] = now
            live = live[now != 0]
            at += 1
        return self.found[state], self.edits[state]


@dataclass
class Model:
    terms: list[bytes]
    weights: np.ndarray  # of terms: how telling each is, 0 to 1
    coefficients: np.ndarray
    intercept: float


_QUOTES = ('"', "“", "”", "„", "«", "»", "‹", "›")


def _quote_marks(low: Texts) -> np.ndarray:
    """Places of quotation marks."""
    raw = low.data[: low.size].tobytes()
    found = []
    for mark in _QUOTES:
        m = mark.encode()
        at = raw.find(m)
        while at >= 0:
            found.append(at)
            at = raw.find(m, at + 1)
    return np.array(sorted(found), np.int64)


def matches(low: Texts, words, automaton: Automaton, cues: HashTable) -> tuple[np.ndarray, ...]:
    """(word number, term, edits, quoted) of all matches in a chunk."""
    starts, ends, counts = words
    term, edits = automaton.run(low.data, starts, ends)
    at = np.flatnonzero(term >= 0)
    if not len(at):
        return at, term[at], edits[at], np.zeros(0, bool)
    doc_first = np.repeat(np.cumsum(counts) - counts, counts)[at]
    doc_last = np.repeat(np.cumsum(counts), counts)[at] - 1
    left, right = np.maximum(at - CONTEXT, doc_first), np.minimum(at + CONTEXT, doc_last)
    # a mark opened shortly before and closed shortly after
    marks = _quote_marks(low)
    before = np.searchsorted(marks, starts[at]) - np.searchsorted(marks, starts[left])
    edge = np.where(left == doc_first, low.offsets[np.searchsorted(low.offsets, starts[at], side="right") - 1], starts[left])
    before = np.searchsorted(marks, starts[at]) - np.searchsorted(marks, edge)
    edge = np.where(right == doc_last, low.offsets[np.searchsorted(low.offsets, starts[at], side="right")], ends[right])
    after = np.searchsorted(marks, edge) - np.searchsorted(marks, ends[at])
    quoted = (before > 0) & (after > 0)
    # or a word that announces a quotation shortly before
    from_, n = left, at - left
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    near = np.repeat(from_, n) + inner
    cue = cues.get(low.span_hashes(starts[near], ends[near])) > 0
    total = np.concatenate([[0], np.cumsum(cue)])
    quoted |= (total[np.cumsum(n)] - total[np.cumsum(n) - n]) > 0
    return at, term[at], edits[at], quoted


def _cues() -> HashTable:
    raw = [c.encode() for c in CUES]
    offsets = np.cumsum([0, *map(len, raw)])
    hashes = Texts(np.frombuffer(b"".join(raw), np.uint8), offsets).span_hashes(offsets[:-1], offsets[1:])
    return HashTable(hashes, np.ones(len(raw), np.int32))


def doc_features(low: Texts, counts: np.ndarray, found: tuple[np.ndarray, ...], weights: np.ndarray) -> np.ndarray:
    """Features of each text from its word count and what ``matches`` found."""
    at, term, edits, quoted = found
    out = np.zeros((len(low), len(FEATURES)))
    doc = np.searchsorted(np.cumsum(counts), at, side="right")
    weight = weights[term]
    for k, pick in enumerate(((edits == 0) & ~quoted, (edits == 0) & quoted, (edits > 0) & ~quoted, (edits > 0) & quoted)):
        out[:, k] = np.log1p(np.bincount(doc[pick], weight[pick], len(low)))
    plain = np.bincount(doc[~quoted], weight[~quoted], len(low))
    out[:, 4] = np.minimum(1, 20 * plain / np.maximum(counts, 1))
    out[:, 5] = np.bincount(doc, minlength=len(low)) > 0
    return out


def learn_terms(texts: list[str], labels: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Terms that stand in toxic texts and hardly in others, and how telling each is.

    A term is in at least a hundredth of the toxic texts, and in three (of few
    texts, two), and at least 20 times as frequent there as elsewhere. Equal
    texts count once.
    """
    first = dict.fromkeys(zip(texts, labels.tolist(), strict=True))
    texts, labels = [t for t, _ in first], np.array([y for _, y in first], np.int64)
    sizes = np.bincount(labels, minlength=2)
    seen: dict[int, bytes] = {}
    tallies = []
    row = 0
    for chunk in chunks(pa.array(texts, pa.large_string())):
        low = chunk.lowered()
        starts, ends, counts = low.words(ALNUM)
        hashes = low.span_hashes(starts, ends)
        doc = np.repeat(np.arange(row, row + len(low)), counts)
        _, once = np.unique(mix(hashes + mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True)
        label = labels[doc[once]]
        tallies.append((hashes[once], label))
        for i in once[label == 1].tolist():
            seen.setdefault(int(hashes[i]), low.data[starts[i] : ends[i]].tobytes())
        row += len(low)
    if not tallies or not sizes[1]:
        return [], np.empty(0)
    hashes, label = (np.concatenate(x) for x in zip(*tallies, strict=True))
    keys, number = np.unique(hashes, return_inverse=True)
    bad = np.bincount(number, label == 1, len(keys))
    good = np.bincount(number, label == 0, len(keys))
    least = max(3 if sizes[1] >= 30 else 2, sizes[1] / 100)
    ratio = ((bad + 0.5) / (sizes[1] + 1)) / ((good + 0.5) / (sizes[0] + 1))
    pick = np.flatnonzero((bad >= least) & (ratio >= 20))
    pick = pick[np.lexsort((keys[pick], -ratio[pick]))][:MAX_TERMS]
    terms = [seen[int(k)] for k in keys[pick]]
    return terms, np.minimum(1, np.log(ratio[pick]) / np.log(200))


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Newton's method on the penalised likelihood; both classes weigh the same."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    weight = np.where(y == 1, len(y) / 2 / max(n1, 1), len(y) / 2 / max(n0, 1))
    z = np.column_stack([x, np.ones(len(x))])
    center = np.append(prior, -2.0)
    penalty = np.append(np.full(len(prior), ridge), 0.1)
    beta = center.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - penalty * (beta - center)
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta[:-1], float(beta[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Learns lexicon and weights from a bounded sample of labelled texts, ``train_rows`` of each class at most.

    ``labels`` with a null id or label are left out. Texts are the whole ones of the
    rows of ``docs`` with a labelled id, null as empty; of several the first in order,
    and of several labels 1. The sample's texts are learned from on the driver.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where("_id is not null and _label in (0, 1)").distinct()
    sample = None
    for value in (0, 1):
        part = known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(train_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # an id that documents repeat may not swell the sample: its first text in order stands for it
    rows = (
        texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.max("_label").alias("_label"))
    ).toArrow()
    rows = rows.sort_by([("_id", "ascending")])
    y = rows.column("_label").to_numpy().astype(np.int64)
    found = rows.column("text").to_pylist()
    if len(set(y.tolist())) < 2:
        return Model([], np.empty(0), PRIOR, -3.0)
    # terms from one half, weights from the other, so that chance terms weigh little
    half = np.zeros(len(y), bool)
    for value in (0, 1):
        half[np.flatnonzero(y == value)[::2]] = True
    terms, weights = learn_terms([t for t, h in zip(found, half, strict=True) if h], y[half])
    automaton, cues = Automaton(terms), _cues()
    other = [t for t, h in zip(found, half, strict=True) if not h]
    x = []
    for chunk in chunks(pa.array(other, pa.large_string())):
        low = chunk.lowered()
        words = low.words(ALNUM)
        x.append(doc_features(low, words[2], matches(low, words, automaton, cues), weights))
    coefficients, intercept = fit_logistic(np.concatenate(x), y[~half], PRIOR)
    every, telling = learn_terms(found, y)
    return Model(every, telling, coefficients, intercept)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, n_exact, n_near, n_quoted, terms), one row per row of ``docs``.

    Words are runs of letters and digits after lower-casing A-Z; an edit is a
    byte more, less or other. Null and empty texts have the score of a text
    without matches. Null and repeated ids are rows like others; an empty table
    gives no rows. Other columns are not read.
    """
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text_"))
    kind = source.schema[0].dataType.simpleString()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model, Automaton(model.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, automaton = sent.value
        cues = _cues()
        names = np.array([t.decode("utf-8", "replace") for t in model.terms] or [""], object)
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                low = chunk.lowered()
                words = low.words(ALNUM)
                at, term, edits, quoted = found = matches(low, words, automaton, cues)
                x = doc_features(low, words[2], found, model.weights)
                p = 1 / (1 + np.exp(-np.clip(x @ model.coefficients + model.intercept, -30, 30)))
                doc = np.searchsorted(np.cumsum(words[2]), at, side="right")
                named: dict[int, set] = {}
                for d, t in zip(doc.tolist(), names[term].tolist(), strict=True):
                    named.setdefault(d, set()).add(t)
                total = lambda pick: pa.array(np.bincount(doc[pick], minlength=len(low)).astype(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows_of(batch, chunk, [id_col]),
                        pa.array(p),
                        pa.array((p >= 0.5).astype(np.int32)),
                        total(edits == 0),
                        total(edits > 0),
                        total(quoted),
                        pa.array([sorted(named.get(d, ())) for d in range(len(low))], pa.list_(pa.string())),
                    ],
                    [id_col, "score", "predicted", "n_exact", "n_near", "n_quoted", "terms"],
                )

    return source.mapInArrow(
        run,
        f"`{id_col}` {kind}, score double, predicted int, n_exact bigint, n_near bigint, n_quoted bigint, terms array<string>",
    )


def held_out(id_col: str = "doc_id") -> Column:
    """Ids that no label is learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))

