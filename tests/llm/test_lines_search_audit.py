"""Line dedup, ranked search and the audit of sources against brute force, on small and on awkward inputs."""

import random

import numpy as np
import pytest
from brute import divergence, line_dedup, ranking
from pyspark.sql import functions as F
from test_operators import AWKWARD, empty, frame, made

from lakeloom.llm import line_dedup as lines
from lakeloom.llm import ranked_search, source_audit

# --- line dedup ---------------------------------------------------------------

LINES = ["Read more", " read MORE\t", "ÉCOLE", "école", "", "  ", "x", "\x0bx\r", "a b", "\u00a0x", "Über uns", "no\x85nel"]


def lined(seed, n):
    rng = random.Random(seed)
    return ["\n".join(rng.choice([*LINES, f"own {rng.random()}"]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


@pytest.mark.parametrize(("threshold", "min_chars"), [(10, 1), (2, 1), (3, 4), (1, 1), (4, 0)])
def test_lines_are_those_of_brute_force(spark, threshold, min_chars):
    texts = lined(threshold, 60) + [None, "", "\n", "x\n" * 40, "x\n" * 40, "a\nb\n"] + [t for _, t in AWKWARD]
    rows = [(None if i % 9 == 0 else i % 7, t) for i, t in enumerate(texts)]
    got = lines.drop_common_lines(frame(spark, rows), threshold=threshold, min_chars=min_chars).collect()
    wanted = line_dedup(texts, threshold, min_chars)
    said = lambda rows: sorted(rows, key=repr)
    assert said((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got) == said(
        (rows[i][0], *wanted[i]) for i in range(len(texts))
    )


def test_a_line_counts_once_a_document(spark):
    texts = ["again\n" * 50 + "end"] + [f"again\nend {k}" for k in range(8)]
    got = lines.drop_common_lines(frame(spark, list(enumerate(texts)))).collect()
    assert {r.n_dropped for r in got} == {0}
    got = lines.drop_common_lines(frame(spark, list(enumerate([*texts, "AGAIN "])))).collect()
    assert sorted(r.n_dropped for r in got) == [1] * 9 + [50]


def test_copies_of_a_long_text_of_many_lines(spark):
    long = "\n".join(f"line {k % 5000}" for k in range(40_000))
    rows = [(k, long) for k in range(12)] + [(12, "line 7\nline 5001")]
    got = {r.doc_id: r for r in lines.drop_common_lines(frame(spark, rows)).collect()}
    assert all(got[k].n_dropped == 40_000 and got[k].kept == "" for k in range(12))
    assert (got[12].n_dropped, got[12].kept) == (1, "line 5001")


def test_lines_stay_in_the_engine(spark):
    plan = lines.drop_common_lines(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_parallelism_does_not_matter_to_lines(spark):
    rows = [(k, t) for k, t in enumerate(lined(5, 80))]
    whole = sorted(lines.drop_common_lines(frame(spark, rows)).collect())
    assert sorted(lines.drop_common_lines(frame(spark, rows[::-1]).repartition(13)).collect()) == whole


# --- ranked search ------------------------------------------------------------


@pytest.mark.parametrize("top", [1, 3, 20])
def test_ranks_are_those_of_brute_force(spark, top):
    texts = made(7, 120) + made(7, 20) + [None, "", "go " * 500, "zzz"] + [t for _, t in AWKWARD]
    docs = [(None if i % 50 == 3 else (i * 37) % 90, t) for i, t in enumerate(texts)]
    items = [(k, t) for k, t in enumerate(made(8, 30, 12))] + [(40, None), (41, ""), (42, "nowhere"), (43, "go go go MIT"), (None, "漢字 ß")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("item", F.lit(2))
    got = ranked_search.rank_documents(frame(spark, docs), bench, top=top).collect()
    said = lambda rows: sorted(map(tuple, rows), key=repr)
    assert said(got) == said(ranking(docs, items, top))


def test_small_trees_and_blocks_give_the_same(spark, monkeypatch):
    docs = frame(spark, [(k, t) for k, t in enumerate(made(9, 300))])
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(made(10, 40, 12))], "item_id bigint, text string")
    whole = sorted(ranked_search.rank_documents(docs, bench).collect())
    for name, value in (("TREE_DOCS", 50), ("TREE_CELLS", 90), ("FANOUT", 2), ("BLOCK_WORDS", 60)):
        monkeypatch.setattr(ranked_search, name, value)
        assert sorted(ranked_search.rank_documents(docs, bench).collect()) == whole


def test_repeated_items_have_a_list_each(spark):
    docs = frame(spark, [(1, "alpha beta"), (2, "alpha"), (3, "gamma")])
    bench = spark.createDataFrame([(5, "alpha"), (5, "gamma gamma")], "item_id bigint, text string")
    got = ranked_search.rank_documents(docs, bench).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in got) == [(5, 1, 2), (5, 1, 3), (5, 2, 1)]


def test_whole_batches_are_pruned():
    rng = np.random.default_rng(1)
    docs, items, columns = 4000, 64, 800
    # documents of many themes: an item is about one of them
    theme = rng.integers(0, 80, docs)
    row = np.repeat(np.arange(docs), 6)
    column = theme[row] * 10 + rng.integers(0, 10, len(row))
    made = ranked_search.Sparse.of(row, column, rng.integers(1, 1000, len(row)), docs, columns)
    row = np.repeat(np.arange(items), 4)
    column = (row % 80) * 10 + rng.integers(0, 10, len(row))
    wanted = ranked_search.Sparse.of(row, column, rng.integers(1, 1000, len(row)), items, columns)
    tree, best = ranked_search.ItemTree(wanted, columns), ranked_search.Best(items, 5)
    scored = ranked_search.search_tree(tree, made, np.zeros(docs, np.int64), np.arange(docs), best, columns)
    assert scored < docs * items / 10
    every = tree.products(made, np.arange(docs), 0)
    for k in range(items):
        first = sorted((-int(s), d) for d, s in enumerate(every[:, k]) if s > 0)[:5]
        mine = best.rows[0] == k
        assert sorted(zip(-best.rows[1][mine], best.rows[3][mine], strict=True)) == first


# --- audit of sources ---------------------------------------------------------


def audited(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    for c in ("doc_id", "term", "uses", "part", "p", "n", "kept"):
        df = df.withColumn(c, F.lit("x"))
    return df


def sourced(seed, n):
    rng = random.Random(seed)
    said = made(seed, n, 15)
    # some words belong to some sources more than to others; many texts are copies
    sources = [f"s{rng.randint(0, 6)}" for _ in range(n)]
    rows = [(f"{t} {'only ' * (s == 's2')}{s[1:]}", rng.choice(["en", "de", None]), s) for t, s in zip(said, sources, strict=True)]
    return rows + [rng.choice(rows)[:2] + (f"s{rng.randint(0, 7)}",) for _ in range(n)]


@pytest.mark.parametrize("min_docs", [1, 10])
def test_divergence_is_that_of_brute_force(spark, min_docs):
    rows = sourced(3, 150) + [(t, "fr", "s1") for _, t in AWKWARD] + [
        (None, "en", "quiet"), ("", "en", None), ("one two", "it", "alone"), ("12 34", "es", "a"), (None, "es", "b"), ("!", "es", "é"),
    ]
    got = source_audit.source_divergence(audited(spark, rows), min_docs=min_docs).collect()
    assert {tuple(r) for r in got} == divergence(rows, min_docs, 10)
    assert len(got) == len({tuple(r) for r in got})


def test_small_tables_and_parts_give_the_same(spark, monkeypatch):
    rows = audited(spark, sourced(4, 200))
    whole = sorted(source_audit.source_divergence(rows).collect())
    monkeypatch.setattr(source_audit, "TABLE_CELLS", 7)
    monkeypatch.setattr(source_audit, "PART_ROWS", 11)
    assert sorted(source_audit.source_divergence(rows).collect()) == whole


def test_a_text_is_tokenized_once(spark):
    rows = audited(spark, [("same words", "en", f"s{k % 3}") for k in range(30)] + [("same words", "de", "s0")])
    texts = source_audit.collapsed(rows, "text", "lang", "source").collect()
    assert sorted((r.lang, sorted((c.source, c.n) for c in r.copies)) for r in texts) == [
        ("de", [("s0", 1)]), ("en", [("s0", 10), ("s1", 10), ("s2", 10)]),
    ]


def test_large_counts_stay_exact(spark):
    n = 10**13 + 7
    got = spark.range(1).select(F.lit(n).alias("c"), F.lit(3 * n).alias("t"), F.lit(11).alias("v")).select(
        source_audit.share("c", "t", "v").alias("p")
    )
    assert got.first().p == 1 + 10**9 * (n + 2) // (3 * n + 22)


# --- empty tables -------------------------------------------------------------


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "go stop")], "item_id bigint, text string")
    assert lines.drop_common_lines(empty(spark)).collect() == []
    assert ranked_search.rank_documents(empty(spark), bench).collect() == []
    assert ranked_search.rank_documents(frame(spark, [(1, "go")]), bench.limit(0)).collect() == []
    assert ranked_search.rank_documents(frame(spark, [(1, None)]), bench).collect() == []
    assert source_audit.source_divergence(audited(spark, []).limit(0)).collect() == []
