"""How far the sources of each language diverge in their words.

Identical texts of a language are collapsed into one row with its number of
copies by source. Each is tokenized once; its terms enter with the copies as
weights, added up in bounded tables inside the tasks before they are shuffled.
Pairs of sources are evaluated sparsely: a task takes a bounded part of the kept
terms and visits only counts above 0; all the terms that neither source of a
pair has differ by one amount, which is multiplied by their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.tables import HashTable
from lakeloom.llm.text import Texts, chunks
from lakeloom.session import materialize

#: Documents of a language that a kept term has at least, and terms listed by group.
MIN_DOCS, TOP = 10, 10
#: Sums by source and term that a task holds before it hands them on.
TABLE_CELLS = 1_000_000
#: Counts above 0 in a part of the pair evaluation.
PART_ROWS = 100_000
SCALE = 1_000_000_000

#: Terms of letters: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after lower-casing A-Z.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[97:123] = LETTERS[128:] = True
_CELLS = "lang string, term string, cells array<struct<source: string, docs: bigint, uses: bigint>>"


def collapsed(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, text, copies), one row per different text of a language; ``copies`` has (source, n) each.

    Texts are grouped by two 64-bit hashes, so that only one copy a task is
    shuffled, once; the copies are counted without their texts.
    """
    read = {"lang": lang_col, "source": source_col, "text": text_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in read.items()])
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    key = ["lang", "h1", "h2"]
    counted = rows.select("lang", *hashes, "source").groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n"))
    copies = counted.groupBy(*key).agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = rows.select("lang", *hashes, "text").groupBy(*key).agg(F.any_value("text").alias("text"))
    return texts.join(copies, key).select("lang", "text", "copies")


class WeightedTerms:
    """Sums of documents and occurrences by group and term, in arrays of a bounded size."""

    def __init__(self, limit: int):
        self.limit = limit
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: list[bytes] = []
        self.known = HashTable(np.empty(0, np.uint64), np.empty(0, np.int32))
        self.parts, self.size = [], 0

    def group(self, lang: str, source: str) -> int:
        return self.groups.setdefault((lang, source), len(self.groups))

    def _numbers(self, chunk: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of terms, from 1; new ones are added with their bytes."""
        hashes = chunk.span_hashes(starts, ends)
        new, first = np.unique(hashes[self.known.get(hashes) == 0], return_index=True)
        at = np.flatnonzero(self.known.get(hashes) == 0)[first]
        self.known.add(new, np.arange(len(self.terms) + 1, len(self.terms) + 1 + len(new)))
        self.terms += [chunk.data[starts[k] : ends[k]].tobytes() for k in at]
        return self.known.get(hashes).astype(np.int64)

    def add(self, chunk: Texts, at: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
        """The terms of each text, for its copies: rows ``at[text]`` to ``at[text + 1]`` of ``group`` and ``n``."""
        starts, ends, counts = chunk.words(LETTERS)
        term = self._numbers(chunk, starts, ends)
        width = len(self.terms) + 1
        cell, uses = np.unique(np.repeat(np.arange(len(chunk)), counts) * width + term, return_counts=True)
        row, term = np.divmod(cell, width)
        times = np.diff(at)[row]
        copy = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(at[:-1][row], times)
        key = group[copy] << 32 | np.repeat(term, times)
        self.parts.append((key, n[copy], n[copy] * np.repeat(uses, times)))
        self.size += len(key)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds up what has the same key; keys ascend."""
        key, docs, uses = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        add = lambda x: np.add.reduceat(x[order], first) if len(first) else x
        self.parts = [(key[first], add(docs), add(uses))]
        self.size = len(first)
        return self.parts[0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All sums by language and term, and a clean table."""
        if self.parts:
            key, docs, uses = self.sums()
            langs = list(dict.fromkeys(lang for lang, _ in self.groups))
            lang_of = np.array([langs.index(lang) for lang, _ in self.groups], np.int64)
            group, term = key >> 32, (key & 0xFFFFFFFF) - 1
            order = np.lexsort((term, lang_of[group]))
            group, term, docs, uses = group[order], term[order], docs[order], uses[order]
            lang = lang_of[group]
            first = np.flatnonzero(np.concatenate([[True], (lang[1:] != lang[:-1]) | (term[1:] != term[:-1])])[: len(term)])
            sources = pa.array([source for _, source in self.groups], pa.string())
            cells = pa.StructArray.from_arrays(
                [sources.take(pa.array(group)), pa.array(docs), pa.array(uses)], ["source", "docs", "uses"]
            )
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array(langs, pa.string()).take(pa.array(lang[first])),
                    pa.array(self.terms, pa.binary()).cast(pa.string()).take(pa.array(term[first])),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), cells),
                ],
                ["lang", "term", "cells"],
            )
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)
        self.clear()


def _weighted(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, term, cells): sums of a task, handed on whenever more than ``limit`` are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WeightedTerms(limit)
        for batch in batches:
            langs, copies = batch.column(0).to_pylist(), batch.column(2)
            at = copies.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            source, n = copies.flatten().flatten()
            lang = np.repeat(np.arange(len(langs)), np.diff(at)).tolist()
            group = [table.group(langs[row], name) for row, name in zip(lang, source.to_pylist(), strict=True)]
            group, n = np.array(group, np.int64), n.to_numpy()
            for chunk in chunks(batch.column(1)):
                own = at[chunk.first_row : chunk.first_row + len(chunk) + 1]
                table.add(chunk.lowered(), own, group, n)
                if table.size > limit:
                    table.sums()
                if table.size > limit // 2:
                    yield from table.rows()
        yield from table.rows()

    return run


def kept_terms(texts: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, lang_uses, cells) of the terms of at least ``min_docs`` documents; ``cells`` has (source, uses) each."""
    found = texts.mapInArrow(_weighted(TABLE_CELLS), _CELLS)
    # one shuffle by language and term serves both sums
    cells = found.repartition("lang", "term").select("lang", "term", F.inline("cells"))
    cells = cells.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))
    terms = cells.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("uses").alias("lang_uses"), F.collect_list(F.struct("source", "uses")).alias("cells")
    )
    return terms.where(F.col("docs") >= min_docs).drop("docs")


def share(count: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)) without rounding; 1 where no term is kept."""
    above, below = f"cast({count} + 2 AS decimal(20, 0))", f"cast({total} + 2 * {kept} AS decimal(20, 0))"
    return F.expr(f"if({kept} = 0, 1L, 1 + {above} * {SCALE} div {below})")


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


def _pair_sums(key: tuple, counts: pa.Table, sources: pa.Table) -> pa.Table:
    """This part's share of the distance of each pair of sources (a before b) of a language.

    ``counts`` (source, term, p) has the counts above 0 of the part's terms,
    ``sources`` (source, p0, kept) every source with its share of an absent term.
    """
    sources = sources.sort_by("source")
    names, p0 = sources["source"].combine_chunks(), sources["p0"].to_numpy()
    size = len(names)
    row_source = pc.index_in(counts["source"].combine_chunks(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = counts["term"].combine_chunks().dictionary_encode()
    order = np.argsort(row_source, kind="stable")
    row_source, p = row_source[order], counts["p"].to_numpy()[order]
    term = terms.indices.to_numpy(zero_copy_only=False)[order]
    first = np.searchsorted(row_source, np.arange(size + 1))
    # terms absent from both sources of a pair, counted once for all parts
    kept = int(sources["kept"][0].as_py()) if key[1].as_py() == 0 else 0
    here = np.zeros(len(terms.dictionary), np.int64)
    found = []
    for a in range(size - 1):
        own, later = slice(first[a], first[a + 1]), slice(first[a + 1], len(p))
        here[term[own]] = p[own]
        p_a = here[term[later]]
        both, of = p_a > 0, row_source[later]
        gain = distance(np.where(both, p_a, p0[a]), p[later]) - np.where(both, distance(p_a, p0[of]), 0)
        ends = first[a + 1 :] - first[a + 1]
        add = lambda x, ends=ends: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
        values, times = np.unique(p[own], return_counts=True)
        q = p0[a + 1 :]
        alone = np.zeros(size - a - 1, np.int64)
        for value, n in zip(values, times, strict=True):
            alone += n * distance(value, q)
        seen = len(p[own]) + np.diff(ends) - add(both.astype(np.int64))
        found.append(add(gain) + alone + (kept - seen) * distance(p0[a], q))
        here[term[own]] = 0
    a, b = np.triu_indices(size, 1)
    value = np.concatenate(found) if found else np.empty(0, np.int64)
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.table([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], names=["lang", "a", "b", "value"])


def _ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from the others.

    Terms are runs of letters and of all characters beyond ASCII, A-Z
    lower-cased. A language keeps the terms of at least ``min_docs`` of its
    rows. A share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), with N the sum
    of the counts of the V kept terms in a group or in the whole language; the
    distance of two shares is floor((p - q)^2 / (p + q)). Part ``pair`` has for
    each source every other one of its language and the sum of the distances
    over all kept terms; part ``term`` the ``top`` kept terms that a source has
    and uses more than its language does. Ranks go by falling value, then by
    item in the order of UTF-8, and are 1 for the first.

    Null texts, languages and sources are empty ones; groups without terms take
    part. A language of one source has no pairs, one without kept terms pairs of
    value 0. Rows that repeat a text count each. An empty table gives an empty
    result. Other columns are not read. All arithmetic is on integers.
    """
    kept = materialize(kept_terms(collapsed(docs, text_col, lang_col, source_col), min_docs), "kept_terms")
    uses = kept.select("lang", "term", "lang_uses", F.inline("cells"))
    # a language or group has one row from here on
    langs = kept.groupBy("lang").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("lang_uses").alias("lang_total"), F.sum(F.size("cells")).alias("cells")
    )
    groups = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]
    ).distinct()
    groups = groups.join(uses.groupBy("lang", "source").agg(F.sum("uses").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total", "cells"])
    parts = F.ceil(F.greatest(F.col("cells"), F.lit(1)) / PART_ROWS).cast("bigint")
    groups = materialize(groups.withColumn("parts", parts).drop("cells"), "groups")

    shares = uses.join(groups, ["lang", "source"])
    shares = shares.withColumn("p", share("uses", "total", "kept")).withColumn("q", share("lang_uses", "lang_total", "kept"))
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value")
    )

    part = F.expr("pmod(xxhash64(term), parts)").alias("part")
    everyone = groups.select("lang", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "source", share("0", "total", "kept").alias("p0"), "kept")
    sums = (
        shares.select("lang", part, "source", "term", "p")
        .groupBy("lang", "part")
        .cogroup(everyone.groupBy("lang", "part"))
        .applyInArrow(
            lambda key, left, right: _pair_sums(key, left, right), "lang string, a string, b string, value bigint"
        )
    )
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    way = lambda source, item: F.struct(F.col(source).alias("source"), F.col(item).alias("item"))
    pairs = sums.withColumn("way", F.explode(F.array(way("a", "b"), way("b", "a")))).select(
        "lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"
    )
    return _ranked(pairs).unionByName(_ranked(terms).where(F.col("rank") <= top))
