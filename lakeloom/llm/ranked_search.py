"""Exact ranked search of all documents for every item, by a dual tree.

A first pass writes each document's occurrences of item terms, with the counts
that the weights need. A second pass lets every task build a tree over its
documents and one over the items. A node holds the coordinate maxima of what is
below it: of impacts by term for documents, of weights by term for items. Their
product bounds every score of the two nodes; if it lies below the weakest kth
score that the items of the node have so far, all of these documents and items
are skipped at once. What is left is scored exactly, in 64-bit integers. Tasks
hand on the best of each item, which are ranked at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.tables import HashTable
from lakeloom.llm.text import ALNUM, chunks, rows_of
from lakeloom.session import materialize

TOP = 20
#: Item words searched for at a time; more items are more blocks.
BLOCK_WORDS = 1_000_000
#: Children of a node of either tree.
FANOUT = 8
#: Documents, and occurrences of item terms in them, that a task makes one tree of.
TREE_DOCS, TREE_CELLS = 4096, 1_000_000


# --- terms --------------------------------------------------------------------


def _term_rows(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(*names, terms): the words of each text as 64-bit hashes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(len(names))):
                low = chunk.lowered()
                starts, ends, counts = low.words(ALNUM)
                hashes = low.span_hashes(starts, ends).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))
                yield pa.RecordBatch.from_arrays([*rows_of(batch, chunk, names), lists], [*names, "terms"])

    return run


def _vectors(vocabulary: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, n, terms, uses): number of words, and the item terms among them with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = vocabulary.value
        known = HashTable(hashes.view(np.uint64), np.arange(1, len(hashes) + 1))
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                low = chunk.lowered()
                starts, ends, counts = low.words(ALNUM)
                term = known.get(low.span_hashes(starts, ends)).astype(np.int64) - 1
                row = np.repeat(np.arange(len(low)), counts)[term >= 0]
                cell, uses = np.unique(row * (len(hashes) + 1) + term[term >= 0], return_counts=True)
                row, term = np.divmod(cell, len(hashes) + 1)
                offsets = pa.array(np.searchsorted(row, np.arange(len(low) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, uses)]
                ids = rows_of(batch, chunk, ["doc_id"])
                yield pa.RecordBatch.from_arrays([*ids, pa.array(counts.astype(np.int64)), *lists], ["doc_id", "n", "terms", "uses"])

    return run


# --- trees --------------------------------------------------------------------


class Sparse:
    """Rows of (column, value) cells, sorted by column within a row."""

    def __init__(self, at: np.ndarray, column: np.ndarray, value: np.ndarray):
        self.at, self.column, self.value = at, column, value

    def __len__(self) -> int:
        return len(self.at) - 1

    @staticmethod
    def of(row: np.ndarray, column: np.ndarray, value: np.ndarray, rows: int, columns: int) -> Sparse:
        """Of cells in any order, the largest value where several meet."""
        order = np.lexsort((-value, column, row))
        row, column, value = row[order], column[order], value[order]
        key = row * columns + column
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        return Sparse(np.searchsorted(row[first], np.arange(rows + 1)), column[first], value[first])

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.at))

    def maxima(self, columns: int, fanout: int) -> Sparse:
        """One row for each ``fanout`` rows, with their coordinate maxima."""
        return Sparse.of(self.rows() // fanout, self.column, self.value, -(-len(self) // fanout), columns)

    def by_column(self, columns: int) -> Sparse:
        """The same cells by column: rows of (row, value)."""
        return Sparse.of(self.column, self.rows(), self.value, columns, max(1, len(self)))

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``rows``, index of the cell) of all cells in ``rows``."""
        sizes = self.at[rows + 1] - self.at[rows]
        which = np.repeat(np.arange(len(rows)), sizes)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.at[rows], sizes)


class ItemTree:
    """Items by term, and above them nodes of coordinate maxima; ``levels[0]`` are the items themselves."""

    def __init__(self, items: Sparse, columns: int, fanout: int = FANOUT):
        self.fanout, self.levels, self.sizes = fanout, [items.by_column(columns)], [len(items)]
        while self.sizes[-1] > fanout:
            items = items.maxima(columns, fanout)
            self.levels.append(items.by_column(columns))
            self.sizes.append(len(items))

    def weakest(self, least: np.ndarray) -> list[np.ndarray]:
        """The least of ``least`` (by item) below each node, level by level."""
        out = [least]
        for size in self.sizes[1:]:
            padded = np.full(size * self.fanout, np.iinfo(np.int64).max)
            padded[: len(out[-1])] = out[-1]
            out.append(padded.reshape(size, self.fanout).min(axis=1))
        return out

    def products(self, docs: Sparse, rows: np.ndarray, level: int) -> np.ndarray:
        """Products of each of ``rows`` of ``docs`` with each node of a level."""
        which, cell = docs.cells(rows)
        postings = self.levels[level]
        of, at = postings.cells(docs.column[cell])
        out = np.zeros((len(rows), self.sizes[level]), np.int64)
        np.add.at(out, (which[of], postings.column[at]), docs.value[cell][of] * postings.value[at])
        return out

    def bounds(self, docs: Sparse, rows: np.ndarray, least: np.ndarray) -> np.ndarray | None:
        """Bounds of the scores of each row's documents and each item; 0 where a node above ruled the item out.

        The items' tree is walked from above; None if no node of some level is left.
        """
        weakest = self.weakest(least)
        still = np.ones((len(rows), self.sizes[-1]), bool)
        for level in range(len(self.levels) - 1, -1, -1):
            bound = self.products(docs, rows, level)
            still &= bound >= weakest[level]
            if not still.any():
                return None
            if level:
                still = np.repeat(still, self.fanout, axis=1)[:, : self.sizes[level - 1]]
        return np.where(still, bound, 0)


class Best:
    """The best documents of each item so far: score down, then id up, documents without an id last."""

    def __init__(self, items: int, top: int):
        self.top = top
        #: item, score, whether the id is missing, id
        self.rows = [np.empty(0, np.int64) for _ in range(4)]
        #: The weakest score that still enters an item's list.
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, no_id: np.ndarray, doc: np.ndarray) -> None:
        mine = np.isin(self.rows[0], item)
        item, score, no_id, doc = (
            np.concatenate([old[mine], new]) for old, new in zip(self.rows, (item, score, no_id, doc), strict=True)
        )
        order = np.lexsort((doc, no_id, -score, item))
        item, score = item[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full, keep = place == self.top - 1, place < self.top
        self.least[item[full]] = score[full]
        kept = (item[keep], score[keep], no_id[order][keep], doc[order][keep])
        self.rows = [np.concatenate([old[~mine], new]) for old, new in zip(self.rows, kept, strict=True)]


def by_strongest(rows: Sparse, columns: int) -> np.ndarray:
    """An order of rows by the column of their largest value, rows without any last: siblings are alike."""
    row = rows.rows()
    order = np.lexsort((rows.column, -rows.value, row))
    filled = np.diff(rows.at) > 0
    strongest = np.full(len(rows), columns)
    strongest[filled] = rows.column[order][rows.at[:-1][filled]]
    return np.argsort(strongest, kind="stable")


def search_tree(tree: ItemTree, docs: Sparse, no_id: np.ndarray, ids: np.ndarray, best: Best, columns: int) -> int:
    """Brings all of ``docs`` into ``best``; returns the number of pairs with an item that no bound ruled out.

    Of the children of a node those that promise most go first, so that the
    weakest scores rise early.
    """
    by = by_strongest(docs, columns)
    _, cell = docs.cells(by)
    docs = Sparse(np.concatenate([[0], np.cumsum(np.diff(docs.at)[by])]), docs.column[cell], docs.value[cell])
    no_id, ids = no_id[by], ids[by]
    levels = [docs]
    fanout, scored = tree.fanout, 0
    while len(levels[-1]) > fanout:
        levels.append(levels[-1].maxima(columns, fanout))

    def visit(depth: int, rows: np.ndarray, still: np.ndarray) -> None:
        nonlocal scored
        if depth == 0:
            scored += len(rows) * int(still.sum())
            score = tree.products(docs, rows, 0)
            at, item = np.nonzero((score >= best.least) & still)
            if len(item):
                best.add(item, score[at, item], no_id[rows[at]], ids[rows[at]])
            return
        bound = tree.bounds(levels[depth], rows, best.least)
        if bound is None:
            return
        for k in np.argsort(-bound.max(axis=1), kind="stable"):
            open_items = still & (bound[k] >= best.least)
            if open_items.any():
                first = int(rows[k]) * fanout
                visit(depth - 1, np.arange(first, min(first + fanout, len(levels[depth - 1]))), open_items)

    visit(len(levels) - 1, np.arange(len(levels[-1])), np.ones(len(best.least), bool))
    return scored


# --- search -------------------------------------------------------------------


def impacts(uses: np.ndarray, words: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m), with m the length of the document against the mean, in percent."""
    m = 100 - 25 + 25 * words * n_docs // n_words
    return 1_000_000_000 * uses // (1000 * uses + 12 * m)


def _search(
    block: Broadcast, top: int, fanout: int, most_docs: int, most_cells: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, doc_id, score): the best documents of each item in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, items, columns, n_docs, n_words = block.value
        tree, best = ItemTree(items, columns, fanout), Best(len(items), top)
        for batch in batches:
            ids, words = batch.column(0).cast(pa.int64()), batch.column(1).to_numpy()
            no_id, ids = np.array(ids.is_null()).astype(np.int64), ids.fill_null(0).to_numpy()
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            term, uses = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
            at = at - at[0]
            value = impacts(uses, np.repeat(words, np.diff(at)), n_docs, n_words) if len(uses) else uses
            row = 0
            while row < len(ids):
                end = int(np.searchsorted(at, at[row] + most_cells, side="right")) - 1
                end = min(len(ids), max(row + 1, min(end, row + most_docs)))
                cells = slice(at[row], at[end])
                docs = Sparse(at[row : end + 1] - at[row], term[cells].astype(np.int64), value[cells])
                search_tree(tree, docs, no_id[row:end], ids[row:end], best, columns)
                row = end
        item, score, none, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[item]), pa.array(doc, mask=none.astype(bool)), pa.array(score)], ["item", "doc_id", "score"]
        )

    return run


def _block(rows: pa.Table, known: np.ndarray, found: pa.Table, n_docs: int, n_words: int) -> tuple:
    """What every task gets: keys of the items, their weights by term in the order of their tree, and the totals."""
    lists = rows["terms"].combine_chunks()
    hashes, at = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    docs_with = np.zeros(len(known), np.int64)
    docs_with[found["term"].to_numpy()] = found["df"].to_numpy()
    weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * docs_with + 1))).astype(np.int64)
    cell, times = np.unique(
        np.repeat(np.arange(len(lists)), np.diff(at)) * (len(known) + 1) + np.searchsorted(known, hashes), return_counts=True
    )
    row, term = np.divmod(cell, len(known) + 1)
    items = Sparse.of(row, term, weight[term] * times, len(lists), len(known))
    by = by_strongest(items, len(known))
    _, cell = items.cells(by)
    items = Sparse(np.concatenate([[0], np.cumsum(np.diff(items.at)[by])]), items.column[cell], items.value[cell])
    return rows["item"].to_numpy()[by], items, len(known), n_docs, n_words


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    top: int = TOP,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of every item, all with a score above 0 if fewer.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z
    lower-cased. N is the number of documents with a term, L their terms, n one
    document's terms, df the documents with a term, tf its occurrences in one.
    A term weighs w = floor(1000 ln((2N + 2) / (2df + 1))) in doubles, all else
    is 64-bit integer: m = 75 + 25nN div L, and a score is the sum of
    w ((10^9 tf) div (1000 tf + 12m)) over the item's terms, repeats included.
    Equal scores rank by ascending id; a null id ranks behind others.

    Null and empty texts have no terms and rank nowhere; an item without terms
    has no rows. Rows of ``docs`` that repeat an id are documents like others;
    rows of ``items`` that repeat an id have a list each. Ids of documents are
    64-bit integers. Empty tables give an empty result. Other columns are not
    read. Words are compared by 64-bit hashes.

    All documents are searched for every item. Items come in blocks of about
    ``BLOCK_WORDS`` words, dealt by the hash of their row; a block is broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text_"))
    asked = items.select(
        F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("_text_")
    )
    kind = asked.schema["item_id"].dataType.simpleString()
    # written once: the number of an item's row stays what it is
    asked = materialize(
        asked.mapInArrow(_term_rows(["item", "item_id"]), f"item bigint, item_id {kind}, terms array<bigint>"), "items"
    )
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_WORDS))
    parts = []
    for number in range(blocks):
        rows = asked.where(F.expr(f"pmod(xxhash64(item), {blocks}) = {number}")).select("item", "terms").toArrow()
        known = np.unique(rows["terms"].combine_chunks().flatten().to_numpy()) if len(rows) else np.empty(0, np.int64)
        schema = "doc_id bigint, n bigint, terms array<int>, uses array<int>"
        vectors = materialize(texts.mapInArrow(_vectors(spark.sparkContext.broadcast(known)), schema), f"vectors{number}")
        n_docs, n_words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        found = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
        block = spark.sparkContext.broadcast(_block(rows, known, found, n_docs, n_words))
        search = _search(block, top, FANOUT, TREE_DOCS, TREE_CELLS)
        parts.append(vectors.where(F.size("terms") > 0).mapInArrow(search, "item bigint, doc_id bigint, score bigint"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
