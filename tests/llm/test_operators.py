"""The operators against brute force and the libraries they follow, on small and on awkward inputs."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from brute import (
    contamination,
    edits,
    kneser_ney,
    license_places,
    lowered,
    near,
    sha,
    shingles,
    url_parts,
    url_rule,
    words,
)
from pyspark.sql import functions as F

from lakeloom.llm import (
    bpe,
    chat,
    components,
    decontaminate,
    exact_dedup,
    licenses,
    ngram_join,
    quality_lm,
    tables,
    text,
    token_counts,
    toxicity,
    url_filter,
)

COUNT_MODEL = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

WORDS = "the of and rare Über naïve x1 go stop MIT Apache license general public licence 漢字 ß".split()
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One"), (5, "one"), (5, "one"), (None, "one"), (None, None),
    (6, "ÉCOLE école"), (7, "école École"), (8, "a" * 70_000), (9, "A" * 70_000), (10, "a" * 70_001),
    (11, "<|endoftext|> it's <|endoftext|>"), (12, "word " * 9000), (13, "!!! ... ???"),
]


def made(seed, n, size=40):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, size))) for _ in range(n)]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:  # names that operators use inside
        for c in ("n", "gram", "row", "root", "set_id", "_row_", "_text_", "count", "keep", "h", "label", "score"):
            df = df.withColumn(c, F.lit("x"))
    return df


def empty(spark):
    return frame(spark, [])


# --- decontamination ----------------------------------------------------------


def test_contamination_is_that_of_brute_force(spark):
    items = [(k, t) for k, t in enumerate(made(1, 12, 25))] + [(12, None), (13, ""), (None, "go stop x1"), (0, "the of")]
    items += [(3, items[3][1]), (14, "the of and")]
    docs = made(2, 30) + [f"x {t} y" for _, t in items if t] + [None, "", items[5][1][:20], "go STOP, x1"]
    rows = [(i % 7, t) for i, t in enumerate(docs)]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.contamination(frame(spark, rows), bench).collect()
    wanted = contamination(docs, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == sorted(
        (rows[i][0], *wanted[i]) for i in range(len(docs))
    )


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items = [(k, t) for k, t in enumerate(made(3, 20, 25)) if t]
    docs = frame(spark, [(i, f"{a} {b}") for i, ((_, a), (_, b)) in enumerate(zip(items, items[1:], strict=False))])
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(decontaminate.contamination(docs, bench, slop=2).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 100)
    assert sorted(decontaminate.contamination(docs, bench, slop=2).collect()) == whole


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon"
    docs = [(1, f"so {item} it"), (2, "alpha so beta gamma it delta epsilon"), (3, "alpha beta gamma x x x x delta epsilon")]
    bench = spark.createDataFrame([(9, item)], "item_id bigint, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.contamination(frame(spark, docs), bench, slop=2).collect()}
    assert got == {1: (["9"], ["9"]), 2: ([], ["9"]), 3: ([], [])}


def near_covered(docs, items, slop, window=10):
    """[(covered words, sorted item ids)] of proximity matches, by trying every word in every place."""
    out = []
    for said in docs:
        w, covered, found = words(said), set(), set()
        for item, t in items:
            every = words(t)
            n = min(window, len(every))
            for part in [every[k : k + n] for k in range(len(every) - n + 1)] if n else []:
                for start in range(-n - slop, len(w) + slop):
                    at = []
                    for off, term in enumerate(part):
                        places = [p for p in range(max(0, start + off - slop), min(len(w), start + off + slop + 1)) if w[p] == term]
                        at.append(min(places, key=lambda p: (abs(p - start - off), -p), default=None))  # noqa: B023
                    if None not in at and any(p == start + off for off, p in enumerate(at)):
                        covered |= set(range(min(at), max(at) + 1))
                        found.add(item)
        out.append((sorted(covered), sorted(map(str, found))))
    return out


def test_proximity_is_that_of_brute_force(spark):
    rng = random.Random(31)
    items = [(k, t) for k, t in enumerate(made(32, 6, 16)) if t]
    docs = made(33, 12)
    for _, t in items * 4:
        w = t.split()
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w.insert(rng.randrange(max(0, at - 2), at + 2), w.pop(at) if rng.random() < 0.5 else "zz")
        docs.append(" ".join(rng.choice([[], ["so"]]) + w))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(frame(spark, list(enumerate(docs))).coalesce(2), bench, slop=2)
    got = {r.doc_id: ([p for s in r.near_spans for p in range(s.first, s.last + 1)], r.near_items) for r in got.collect()}
    assert [got[i] for i in range(len(docs))] == near_covered(docs, items, 2)


def test_proximity_at_the_start_of_a_second_text(spark):
    w = [f"w{i}" for i in range(10)]
    moved = " ".join([w[1], w[0], *w[2:]])
    rows = [(1, "other words"), (2, f"{moved} so"), (3, " ".join([*w[:5], "so", *w[5:]])), (4, " ".join(w[:9]))]
    bench = spark.createDataFrame([(9, " ".join(w))], "item_id bigint, text string")
    # w0 is the rarest term: the place counted from it lies before the second text
    docs = frame(spark, [*rows, *((i, "w1 w2 w3 w4 w5 w6 w7 w8 w9") for i in range(10, 20))]).coalesce(1)
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, slop=1).collect()}
    assert {d: r.near_items for d, r in got.items() if r.near_items} == {2: ["9"], 3: ["9"]}
    assert [tuple(s) for s in got[2].near_spans] == [(0, 9)] and [tuple(s) for s in got[3].near_spans] == [(0, 10)]
    assert not any(r["items"] or r.n_hit for r in got.values())


def test_contamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(empty(spark), bench).collect() == []
    got = decontaminate.contamination(frame(spark, AWKWARD), bench).collect()
    assert len(got) == len(AWKWARD) and not any(r.n_hit for r in got)


# --- near duplicates ----------------------------------------------------------


def near_cases(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [" ".join(base)] * 3
    for k in range(150):  # a group of near copies larger than a block
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        docs.append(" ".join(w))
    shared = " ".join(f"s{i}" for i in range(30))
    for _ in range(120):  # a passage that many unlike texts share
        docs.append(shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))))
    for _ in range(30):
        w = [f"p{rng.randrange(10**6)}" for _ in range(rng.randint(1, 30))]
        docs += [" ".join(w), " ".join(w[:-1]), " ".join([*w, "z"]).upper()]
    rng.shuffle(docs)
    return [(1000 - i, t) for i, t in enumerate(docs)] + [(5000, None), (5001, ""), (5002, " \n"), (None, docs[0]), (7, docs[1]), (7, docs[2])]


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 64), (5, 80, 64), (3, 90, 4)])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_cases(k + block)
    got = ngram_join.near_duplicates(frame(spark, rows), words=k, similarity=(num, 100)).collect()
    key = lambda r: (r[0] is None, r)
    wanted = sorted(((d, *x) for (d, _), x in zip(rows, near(rows, k, num, 100), strict=True)), key=key)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == wanted


@pytest.mark.parametrize(("k", "num", "block", "tile"), [(3, 90, 64, 256), (5, 80, 64, 16), (3, 90, 4, 8)])
def test_similar_pairs_are_those_of_brute_force(spark, monkeypatch, k, num, block, tile):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rows = near_cases(k + block)
    classes, links = ngram_join.similar_pairs(frame(spark, rows), words=k, similarity=(num, 100))
    classes, links = classes.collect(), links.collect()
    first = {}
    for d, t in rows:
        if s := frozenset(shingles(t, k)):
            first.setdefault(s, set()).add(d)
    sets = sorted(first, key=lambda s: (len(s), sorted(s)))
    wanted = sorted(
        (*sorted((len(a), len(b))), len(a & b)) for i, a in enumerate(sets) for b in sets[i + 1 :] if 100 * len(a & b) >= num * len(a | b)
    )
    assert len(wanted) > 300
    assert sorted((*sorted((r.na, r.nb)), r.overlap) for r in links) == wanted
    assert all(r.a < r.b for r in links) and len({(r.a, r.b) for r in links}) == len(links)
    of = {}
    for r in classes:
        of.setdefault(r.class_id, set()).add(r.doc_id)
    assert sorted(map(len, first.values())) == sorted(len(v) for c, v in of.items() if c is not None)
    assert len(classes) == len(rows) and of[None] == {d for d, t in rows if not shingles(t, k)}


def test_named_pairs_have_rows_of_equal_sets(spark):
    rows = [(3, "a b c d"), (2, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "q r s"), (None, "q r s"), (8, None)]
    classes, links = ngram_join.similar_pairs(frame(spark, rows), words=1)
    got = sorted(map(tuple, ngram_join.named_pairs(classes, links).collect()), key=repr)
    assert got == [(2, 2, 4, 4, 4), (2, 3, 4, 4, 4), (2, None, 4, 4, 4), (None, None, 3, 3, 3)]
    assert ngram_join.named_pairs(*ngram_join.similar_pairs(empty(spark))).collect() == []


def test_near_duplicates_of_awkward_texts(spark):
    got = ngram_join.near_duplicates(frame(spark, AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    assert ngram_join.near_duplicates(empty(spark)).collect() == []


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(1, 1), (None, 3)]
    edges += [(1000 + i, 1001 + i) for i in range(60)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.id: r.root for r in got.collect()} == {x: find(x) for x in root}


# --- exact duplicates ---------------------------------------------------------


def test_exact_duplicates(spark):
    rows = [*AWKWARD, *((100 + i, t) for i, t in enumerate(made(4, 60, 3))), (300, "B" * 600), (301, "b" * 599 + "c"), (302, "b" * 600)]
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(lowered(t), []).append(d)
    wanted = []
    for body, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep = max(known) if known else None
        wanted += [(d, keep, len(ids), keep is None or d == keep, sha(body)) for d in ids]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)
    assert exact_dedup.exact_duplicates(empty(spark)).collect() == []


# --- tokens -------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_are_those_of_the_library(spark, name):
    path = public_tokenizers.path(name)
    rows = AWKWARD + [(50 + i, t) for i, t in enumerate(made(6, 30))] + [(99, "<|endof"), (98, "text|>")]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    got = token_counts.count_tokens(frame(spark, rows), path).collect()
    key = lambda r: (r[0] is None, r)
    wanted = [(d, len((t or "").encode()), count(t or "")) for d, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(wanted, key=key)
    assert token_counts.count_tokens(empty(spark), path).collect() == []


def test_token_cache_may_start_over(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 5)
    with open(COUNT_MODEL, "rb") as file:
        counter = token_counts.Counter(file.read(), np.empty(0, np.uint64), np.empty(0, np.int32))
    chunk = next(text.chunks(pa.array(made(8, 40))))
    assert (counter.counts(chunk) == counter.counts(chunk)).all()


def tiktoken_encoding():
    import base64

    import tiktoken

    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_are_those_of_the_library_and_decode(spark):
    library = tiktoken_encoding()
    rows = AWKWARD + [(50 + i, t) for i, t in enumerate(made(7, 30))] + [(99, "ab" * 3000), (98, "漢" * 500)]
    decoded = bpe.decode(bpe.encode(frame(spark, rows), RANKS), RANKS)
    key = lambda r: (r[0] is None, r)
    wanted = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in decoded.collect()), key=key) == sorted(wanted, key=key)
    digests = {r.n_tokens: r for r in bpe.with_digests(decoded).where("n_tokens > 0").collect()}
    for _, ids, raw in wanted:
        if ids and sum(len(i) == len(ids) for _, i, _ in wanted) == 1:
            packed = b"".join(i.to_bytes(4, "little") for i in ids)
            assert digests[len(ids)].ids_sha256 == sha(packed) and digests[len(ids)].decoded_sha256 == sha(raw)
    assert bpe.decode(bpe.encode(empty(spark), RANKS), RANKS).collect() == []


def test_perfect_hash_is_minimal():
    for n in (1, 2, 7, 1000):
        keys = text.mix(np.arange(1, n + 1, dtype=np.uint64))
        assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(n))


def test_hash_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(1, 2**63, 5000).astype(np.uint64))
    table = tables.HashTable(keys[:10], np.arange(1, 11))
    for a in range(10, len(keys), 700):
        part = keys[a : a + 700]
        table.add(part, np.arange(a + 1, a + 1 + len(part)))
    assert (table.get(keys) == np.arange(1, len(keys) + 1)).all()
    assert not table.get(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)].any()


# --- toxicity -----------------------------------------------------------------


def test_automaton_is_the_edit_distance():
    terms = [b"idiot", b"trash", b"trap", b"scum", b"worthless", "ékipe".encode()]
    automaton = toxicity.Automaton(terms)
    rng = random.Random(3)
    words = set(terms)
    for _ in range(3000):
        w = bytearray(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice([b"", b"x", b"i", b"t"])
        words.add(bytes(w) or b"q")
    words = sorted(words)
    data = np.frombuffer(b"".join(words) + bytes(8), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found, distance = automaton.run(data, ends - [len(w) for w in words], ends)
    for w, f, e in zip(words, found, distance, strict=True):
        best = min(d for t in terms if (d := edits(w, t)) == 0 or len(t) >= toxicity.FUZZY_BYTES)
        assert e == (best if best <= 1 else -1)
        assert f < 0 or edits(w, terms[f]) == best


def test_toxicity_learns_and_tells_quotations(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        w = [f"c{rng.randrange(300)}" for _ in range(30)]
        if i % 2:
            w[rng.randrange(30)], w[rng.randrange(30)] = "gronkle", "blirtzen"
        rows.append((i, " ".join(w)))
        labels.append((i, i % 2))
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(frame(spark, rows), known)
    assert {b"gronkle", b"blirtzen"} <= set(model.terms)
    tests = [(201, "you gronkle blirtzen"), (202, "nothing here"), (203, "you gronklee"), (204, "he said \"gronkle\" was a word"), (205, "you are a gronkle so"), *AWKWARD]
    got = toxicity.score(frame(spark, tests), model)
    assert got.count() == len(tests)
    score = {r.doc_id - 200: r for r in got.where("doc_id > 200").collect()}
    assert score[1].predicted == 1 and score[2].predicted == 0
    assert score[3].n_near == 1 and score[3].score > score[2].score
    assert score[4].n_quoted == 1 and score[4].score < score[5].score
    assert toxicity.score(empty(spark), model).collect() == []
    nothing = toxicity.train(empty(spark), known)
    assert toxicity.score(frame(spark, tests), nothing).where("predicted = 1").count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out())
    right = scored.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.97


# --- chat ---------------------------------------------------------------------

CONTROL = ["<|im_start|>", "<|im_end|>", "</s>[INST] ok [/INST]", "<\\s>", "<\\|im_end|>\n", "[\\\\INST]", "\\", ""]


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.choice([1, 2, 7, 60, 1200 if conv == 3 else 5])):
            role = "system" if turn == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "tool\nx\\n", None])
            said = " ".join(rng.choice([*CONTROL, "word", "é", "more words here"]) for _ in range(rng.randint(0, 40)))
            rows.append((conv, turn, role, said))
    rows += [(0, 0, "user", None), (0, 0, "user", None), (1, None, "assistant", "first"), (20, 700, "system", "late"), (20, 2000, "assistant", "x " * 5000)]
    return rows


@pytest.mark.parametrize(("stride", "history"), [(1024, 512), (40, 40), (7, 0)])
def test_windows_read_back(spark, stride, history):
    rows = conversations(stride)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("block", F.lit("x"))
    windows = chat.format_windows(df, stride=stride, history=history)
    back = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    by = {}
    for conv, turn, role, said in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", said or ""))
    assert set(back) == set(by)
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        assert back[conv].n_turns == len(turns)
        assert back[conv].turns == "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        assert back[conv].loss_text == "".join(t for _, _, r, t in turns if r == "assistant")
    for w in windows.collect():
        new = [t for t in w.turns if not t.repeated]
        assert new and w.text.startswith(chat.OPEN)
        for t in w.turns:
            assert w.text[t.start : t.end].endswith(chat.CLOSE)
            assert w.text[t.start + 1 : t.end].count("<|im_start|>") == 0
        first = [t for t in w.turns if t.role == "system" and t.repeated]
        assert len(first) <= 1 or history > 0
        assert len(w.loss) == sum(t.role == "assistant" for t in new)


def test_system_turn_leads_every_window(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, "user" if t % 2 else "assistant", "some words here") for t in range(1, 1500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_windows(df, stride=100, history=50).collect()
    assert len(got) > 50 and all(w.turns[0].role == "system" for w in got)
    later = [w for w in got if (w.block, w.window) != (0, 0)]
    assert all(w.turns[0].repeated and any(t.repeated and t.role != "system" for t in w.turns) for w in later)


@pytest.mark.parametrize("step", [1, 1000])
def test_history_fills_its_budget_whatever_the_turn_numbers(spark, step):
    rows = [(None if c else 1, t * step, "user", f"w{t}") for c in (0, 1) for t in range(1500)]
    rows += [(2, None if t % 2 else 0, "user", f"w{t:04}") for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    by = {}
    for w in chat.format_windows(df, stride=1024, history=512).collect():
        by.setdefault(w.conv_id, []).append(w)
    assert set(by) == {1, None, 2}
    for windows in by.values():
        windows.sort(key=lambda w: (w.block, w.window))
        # five tokens a turn: spans run on, and 102 turns come before each but the first
        assert [sum(t.repeated for t in w.turns) for w in windows] == [0] + [102] * (len(windows) - 1)
        assert len(windows) == 8 and sum(not t.repeated for w in windows for t in w.turns) == 1500


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_windows(df).collect() == []


def test_chat_plan_has_no_python(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.read_windows(chat.format_windows(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- quality ------------------------------------------------------------------


def test_perplexity_is_that_of_brute_force(spark):
    docs = [(i, t, "en" if i % 3 else None) for i, t in enumerate(made(11, 24, 30))]
    docs += [(90, None, "en"), (91, "", "en"), (92, "nobody trusts", "xx"), (93, "zzz", "en"), (None, "the of", "en")]
    trusted = [i for i in range(12)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumn("gram", F.lit(1))
    good = spark.createDataFrame([(i,) for i in [*trusted, None, 3]], "doc_id bigint")
    got = {(r.doc_id, r.lang): r for r in quality_lm.perplexities(df, good).collect()}
    assert len(got) == len(docs)
    for lang in ("en", None):
        chance = kneser_ney([(t or "").encode() for i, t, x in docs if x == lang and i in trusted], quality_lm.ORDER)
        for i, t, x in docs:
            if x != lang:
                continue
            raw = bytes([quality_lm.START] * 4) + (t or "").encode()
            bits = [-np.log2(chance(raw[k : k + 5])) for k in range(len(raw) - 4)]
            mine = got[i, x].bits
            assert mine is None if not bits else abs(mine - np.mean(bits)) < 1e-4, (i, x, t, mine, np.mean(bits))
    assert got[92, "xx"].kept and got[92, "xx"].perplexity == 256 and not got[90, "en"].kept


def test_answers_in_shards_give_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made(12, 12, 30))], "doc_id bigint, text string, lang string")
    good = spark.createDataFrame([(i,) for i in range(6)], "doc_id bigint")
    whole = {r.doc_id: r.bits for r in quality_lm.perplexities(df, good).collect()}
    monkeypatch.setattr(quality_lm, "SHARD_ROWS", 200)
    parts = {r.doc_id: r.bits for r in quality_lm.perplexities(df, good).collect()}
    assert all(whole[d] == pytest.approx(parts[d], rel=1e-6) if whole[d] else parts[d] is None for d in whole)


def test_quality_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert quality_lm.perplexities(df, df.select("doc_id")).collect() == []
    some = spark.createDataFrame([(1, "a", "en")], "doc_id bigint, text string, lang string")
    assert quality_lm.perplexities(some, df.select("doc_id")).first().kept


# --- URLs ---------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.org/en/1", "https://a.example.org/es/x?y=/fr/", "http://x.com/fr/1#a",
    "http://x.com/de/", "http://xcom/fr/", "http://com/fr/", "http://org", "http://org/", "ftp://u:p@Ä.org?x/y", "a://b://c/d",
    "http://x.com/de?x=1&y=2", "http://x.com\n/de/", "http://casino-win.net/" + "a/" * 3000, "http://casino-win.net/1",
]


def test_url_rules_and_parts(spark):
    rows = [(i % 5, u) for i, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("label", F.lit(3))
    got = url_filter.judge_urls(df).collect()
    wanted = []
    for i, u in rows:
        host, path = url_parts(u)
        wanted.append((i, host, path, *url_rule(host, path, url_filter.RULES)))
    assert sorted((r.page_id, r.host, r.path, str(r.rule)) for r in got) == sorted((i, h, p, str(r)) for i, h, p, r, _ in wanted)
    ruled = {(h, p): v for _, h, p, r, v in wanted if r}
    assert all(r.verdict == ruled[r.host, r.path] for r in got if r.rule)
    assert all(r.verdict in ("allow", "block") for r in got)
    assert url_filter.judge_urls(df.limit(0)).collect() == []


def test_url_trees_on_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host = url_filter.host_of(F.col("url"))
    known = F.when(F.col("page_id") % 5 != 0, url_filter.seed_labels(host))
    got = url_filter.judge_urls(pages, label=known, rules=()).join(pages, "page_id").where("page_id % 5 = 0")
    right = (F.col("verdict") == "block") == (url_filter.seed_labels(host_of := F.col("host")) == 1)
    assert got.agg(F.avg(right.cast("int"))).first()[0] > 0.97 and host_of is not None


# --- licences -----------------------------------------------------------------


def test_license_phrases(spark):
    docs = made(13, 60) + [None, "", "MIT License, Apache-license! general  PUBLIC license", "mit license mit license", "amit license", "mit licenses"]
    got = licenses.scan_licenses(frame(spark, list(enumerate(docs)))).collect()
    for r in got:
        n, found = license_places(docs[r.doc_id], licenses.PHRASES)
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == sorted({x for _, x in found}) and set(r.base_labels) <= set(r.labels)
        assert 0 <= r.score <= 1
    assert len(licenses.scan_licenses(frame(spark, AWKWARD)).collect()) == len(AWKWARD)
    assert licenses.scan_licenses(empty(spark)).collect() == []


def test_fuzzy_notices(spark):
    docs = {
        1: "x Relesed under the MIT Licence. y",
        2: "Licensed under the Apache Licens, Version 2.0",
        3: "licensed under CC BY-NC 4.0",
        4: "licensed to nobody",
        5: "released under",
        6: "the mit license",
    }
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, list(docs.items()))).collect()}
    assert got[2].labels == ["apache"] and got[2].n_base == 0 and 0.9 < got[2].score < 1
    assert got[2].spans[0].first_word == 0 and got[2].spans[0].last_word == 7
    assert got[3].labels == ["cc-by-nc"] and got[3].score == 1
    assert got[4].labels == [] and got[4].score == 0 and got[5].labels == []
    assert got[6].score == 1


def test_seeds_lose_no_notice():
    notices = licenses.compile_notices(licenses.NOTICES)
    rng = random.Random(4)
    for notice in notices:
        for _ in range(40):
            w = list(notice.text)
            for _ in range(rng.randint(0, notice.edits)):
                at = rng.randrange(1, len(w) - 1)
                w[at : at + rng.randint(0, 1)] = rng.choice([[], ["q"], ["e"]])
            said = "".join(w)
            if edits(said, notice.text) > notice.edits:
                continue
            plain = f"\nso {said} it\n".encode()
            assert any(s[2] == notice.label for s in licenses.fuzzy_spans(plain, [notice])), said


def test_repeated_notices_are_all_found(spark):
    from lakeloom.llm import queries

    exact, wrong = "licensed under the apache license version 2 0", "licensed undr the apache licence version 2 0"
    rng = random.Random(6)
    notices = licenses.compile_notices([(exact, "apache")])
    for said in ([wrong, exact, wrong, exact, wrong], [rng.choice([exact, wrong, "x é"]) for _ in range(60)]):
        plain = f"\nso {' '.join(said)}\n{wrong}\n".encode()
        spans = sorted(licenses.fuzzy_spans(plain, notices))
        starts, at = [], len("\nso ")
        for x in said:
            starts += [(at, at + len(x), x)] * (x != "x é")
            at += len(x.encode()) + 1
        starts.append((at, at + len(wrong), wrong))
        assert [(a, b) for a, b, _, _ in spans] == [(a, b) for a, b, _ in starts]
        assert all((score == 1) == (x == exact) for (_, _, x), (*_, score) in zip(starts, spans, strict=True))
    wide = "licensed " + "漢" * 2 + " under the apache license version 2 0"  # three characters, nine bytes with the blank
    notices = licenses.compile_notices([(exact, "apache"), ("all rights reserved", "proprietary")])
    plain = f"\n{wide} {wide.replace('漢漢 ', '')}\n".encode()
    assert len(licenses.fuzzy_spans(plain, notices)) == 1 + (edits(wide, exact) <= notices[0].edits)
    assert "spans" in queries.op10(spark, "/root/testdata/sf0.001").columns


# --- pipeline -----------------------------------------------------------------


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    word = lambda: f"c{rng.randrange(10**5)}"
    docs, labels = [], []
    for i in range(200):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            w[5], w[20], w[30] = "gronkle", "blirtzen", "gronkle"
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = {d for d, _ in docs if d % 4}
    item = " ".join(word() for _ in range(12))
    near_copy = docs[1][1].split()
    near_copy[30] = "changed"
    more = [(500, docs[2][1].upper()), (501, " ".join(near_copy)), (502, " ".join([*(word() for _ in range(30)), item]))]
    rows = [(d, t, "en", "src", len(t)) for d, t in docs + more]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    wanted = {*clean, 500} - {2}
    assert {r.doc_id for r in got} == wanted
    texts, library = dict(docs + more), tiktoken_encoding()
    for r in got:
        assert r.ids == library.encode_ordinary(texts[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_drop_rows_and_not_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(22)
    said = lambda: " ".join(f"c{rng.randrange(10**6)}" for _ in range(60))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = lambda rows: spark.createDataFrame([(d, t, "en", "src", len(t)) for d, t in rows], schema)
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    a, b, c, item = said(), said(), said(), " ".join(said().split()[:12])
    near_copy, leak = " ".join([*a.split()[:-1], "changed"]), f"{said()} {item}"
    moved = item.split()
    moved[4], moved[5] = moved[5], moved[4]
    near_leak = f"{said()} {' '.join(moved)}"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, i % 2) for i in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def stage(drop, rows):
        return left(drop(spark, docs(rows), str(tmp_path)))

    def wanted(*rows):
        return sorted(rows, key=repr)

    copies = [(7, a), (7, b), (9, a.upper()), (None, a), (None, b), (None, c), (None, c), (9, a.upper())]
    assert stage(corpus_pipeline.drop_copies, copies) == wanted((7, b), (9, a.upper()), (None, c))
    near_rows = [(7, near_copy), (7, b), (5, a), (None, a), (None, c), (None, f"{c} x")]
    kept = stage(corpus_pipeline.drop_near_copies, near_rows)
    assert kept[:2] == [(5, a), (7, b)] and len(kept) == 3 and kept[2][0] is None
    leaks = [(7, leak), (7, b), (None, leak), (None, c), (8, near_leak)]
    assert stage(corpus_pipeline.drop_contaminated, leaks) == wanted((7, b), (None, c))
    rude = lambda i: f"gronkle {said()} blirtzen" if i % 2 else said()
    known = [(i, rude(i)) for i in range(200)]
    toxic = [(7000, rude(1)), (7000, b), (None, rude(1)), (None, c)]
    kept = stage(corpus_pipeline.drop_toxic, known + toxic)
    assert [r for r in kept if r[0] in (7000, None)] == wanted((7000, b), (None, c))


def test_stages_take_an_empty_table(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_oracle_names(spark):
    from lakeloom.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    json.dumps(sorted(queries.ORACLES))


# --- one key of a row in all passes -------------------------------------------


def test_rows_keep_their_key_when_tasks_are_cut_anew(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = tables.with_row_key(docs.where("doc_id >= 0"), [F.col("doc_id")], "keyed")
    name = "spark.sql.files.maxPartitionBytes"
    before, first = spark.conf.get(name), sorted(map(tuple, keyed.collect()))
    try:
        spark.conf.set(name, "20000")
        assert sorted(map(tuple, keyed.collect())) == first and len({k for k, _ in first}) == docs.count()
        # behind a shuffle, or where rows repeat, the key is written
        for other in (docs.repartition(5), docs.withColumn("_", F.explode(F.array(F.lit(1), F.lit(2))))):
            keyed = tables.with_row_key(other, [F.col("doc_id")], "keyed")
            once = sorted(map(tuple, keyed.collect()))
            spark.conf.set(name, "50000")
            assert sorted(map(tuple, keyed.collect())) == once and len({k for k, _ in once}) == other.count()
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("shuffled", [False, True])
def test_links_stay_when_tasks_are_cut_anew_between_passes(spark, sf, monkeypatch, shuffled):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)) if shuffled else docs
    docs = docs.repartition(7) if shuffled else docs
    wanted = sorted(map(tuple, ngram_join.near_duplicates(docs, words=3, similarity=(90, 100)).select("doc_id", "component_id").collect()))
    name, verify = "spark.sql.files.maxPartitionBytes", ngram_join._verified
    before = spark.conf.get(name)

    def later(*args):
        spark.conf.set(name, "30000")
        return verify(*args)

    monkeypatch.setattr(ngram_join, "_verified", later)
    try:
        got = ngram_join.near_duplicates(docs, words=3, similarity=(90, 100)).select("doc_id", "component_id")
        assert sorted(map(tuple, got.collect())) == wanted
    finally:
        spark.conf.set(name, before)


def test_suffix_rates_leave_out_a_hosts_own_label(spark, monkeypatch):
    """Turning the label of one host changes the rates of other folds, never its own."""
    seen = []

    def keep(full, train_rows):
        seen.append({r["host"]: r["suffix_rate"] for r in full.select("host", "suffix_rate").distinct().collect()})
        return full.withColumn("score", F.lit(0.0))

    monkeypatch.setattr(url_filter, "_boosted", keep)
    rows = [(i, f"https://h{i % 40}.net/{i}", int(i % 40 % 3 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, y int")
    for label in (F.col("y"), F.when(F.col("url").contains("//h7."), 1 - F.col("y")).otherwise(F.col("y"))):
        url_filter.judge_urls(df, label=label, rules=()).collect()
    hosts = df.select(url_filter.host_of(F.col("url")).alias("host")).distinct()
    fold = dict(hosts.select("host", F.pmod(F.xxhash64("host"), F.lit(url_filter.FOLDS))).collect())
    before, after = seen
    for h in before:
        assert (before[h] == after[h]) == (fold[h] == fold["h7.net"])


def test_tables_of_frequent_pre_tokens_are_merged_without_a_shuffle_by_key(spark):
    texts = [(i, "the cat and the dog " * (1 + i % 3) + f"w{i}") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(9)
    model = open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()
    keys, lengths = token_counts.frequent_lengths(docs, model)
    assert len(set(keys.tolist())) == len(keys) == len(lengths) and (lengths > 0).all()
    one = token_counts.frequent_lengths(docs.coalesce(1), model)
    assert sorted(zip(keys.tolist(), lengths.tolist())) == sorted(zip(one[0].tolist(), one[1].tolist()))


def test_a_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Every set of a group met every leader, and its overlap with each was counted."""
    rows = [(i, " ".join(f"w{j}" if j != i else f"x{i}" for j in range(200))) for i in range(60)]
    counted, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *rest: counted.append(pairs.count()) or verify(pairs, *rest))
    got = ngram_join.near_duplicates(frame(spark, rows), words=3, similarity=(90, 100)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 60
    assert sum(counted) <= 4 * 60  # of 1770 pairs


# --- one worker a task for byte-level BPE -------------------------------------


def test_round_trip_is_encode_decode_and_digests_in_one_worker(spark, tmp_path):
    import corpus_pipeline
    from lakeloom.llm import queries

    rows = [*AWKWARD, *((50 + i, t) for i, t in enumerate(made(7, 30)))]
    docs = frame(spark, rows)
    key = lambda r: repr(tuple(r))
    steps = bpe.with_digests(bpe.decode(bpe.encode(docs, RANKS), RANKS), with_ids=True)
    assert sorted(bpe.round_trip(docs, RANKS, with_ids=True).collect(), key=key) == sorted(steps.collect(), key=key)
    assert bpe.round_trip(empty(spark), RANKS).collect() == []
    plans = [corpus_pipeline.encode(spark, docs, str(tmp_path)), queries.op9(spark, "/root/testdata/sf0.001")]
    for df in plans:
        # each step of its own in a plan is one more Python worker a task
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_cache_of_ids_may_start_over(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_IDS", 50)
    with open(RANKS, "rb") as file:
        made_of = bpe.Bpe(bpe.read_ranks(file.read()))
    library = tiktoken_encoding()
    for said in made(9, 12):
        (chunk,) = text.chunks(pa.array([said]))
        assert made_of.encode(chunk)[0].tolist() == library.encode_ordinary(said)


def test_a_group_meets_the_set_at_its_middle_first(spark, monkeypatch):
    """Copies with two changes are similar to the text they come from, not to each other: most met sets they are not similar to."""
    base = [f"w{j}" for j in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 100):
        copy = list(base)
        copy[i], copy[(i + 50) % 150] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(copy)))
    counted, verify = [], ngram_join._verify
    monkeypatch.setattr(ngram_join, "_verify", lambda pairs, *rest: counted.append(pairs.count()) or verify(pairs, *rest))
    got = ngram_join.near_duplicates(frame(spark, rows), words=3, similarity=(90, 100)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 100
    assert sum(counted) <= 2 * 100  # of 4950 pairs
