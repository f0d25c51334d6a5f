"""Registered queries of the operators, with the SQL that states their results where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm import (
    bpe,
    chat,
    decontaminate,
    exact_dedup,
    licenses,
    line_dedup,
    ngram_join,
    quality_lm,
    ranked_search,
    source_audit,
    token_counts,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What the first two queries find besides the columns that their SQL states.
DETAILS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DETAIL_ORACLES: dict[str, str] = {}

COUNT_MODEL = os.environ.get("LAKELOOM_COUNT_MODEL", public_tokenizers.path("byte_bpe_50k.json"))
RANKS = os.environ.get("LAKELOOM_RANKS", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))

# DuckDB: A-Z lower-cased and nothing else changed; its words
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def query(name: str, oracle: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        queries[name] = build
        if oracle:
            oracles[name] = oracle
        return build

    return register


def detail(name: str, oracle: str | None = None):
    return query(name, oracle, DETAILS, DETAIL_ORACLES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_decontamination",
    f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
     b AS (SELECT row_number() OVER () AS r, item_id, {WORDS} AS w FROM benchmark),
     win AS (
       SELECT DISTINCT item_id, w[k:k + 9] AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT len(g) AS n FROM win),
     grams AS (
       SELECT r, k, n, w[k:k + n - 1] AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
     hits AS (SELECT r, k, n, item_id FROM grams JOIN win USING (g)),
     covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
     items AS (
       SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@detail("op1_proximity")
def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches, with their items and places."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items, slop=decontaminate.SLOP)


@query(
    "op2_ngram_jaccard",
    f"""
WITH RECURSIVE d AS (
       SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (
       SELECT DISTINCT doc_id, w[k:k + 2] AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (
       SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
       GROUP BY ALL),
     links AS (
       SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
       WHERE 100 * o >= 90 * (na.n + nb.n - o)),
     reach AS (
       SELECT doc_id AS a, doc_id AS b FROM d
       UNION
       SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))
    return found.select("doc_id", "n_shingles", "component_id")


@detail(
    "op2_links",
    f"""
WITH d AS (
       SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (
       SELECT DISTINCT doc_id, w[k:k + 2] AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     pairs AS (
       SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
       GROUP BY ALL),
     links AS (
       SELECT a, b, na.n AS n_a, nb.n AS n_b, o, o = na.n AND o = nb.n AS same
       FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
       WHERE 100 * o >= 90 * (na.n + nb.n - o)),
     later AS (SELECT b FROM links WHERE same)
SELECT a, b, n_a, n_b, o AS overlap FROM links
WHERE a NOT IN (FROM later) AND (same OR b NOT IN (FROM later))
""",
)
def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link between two different sets, under their smallest ids, and from these ids to the rows of equal sets."""
    classes, links = ngram_join.similar_pairs(table(spark, sf_dir, "documents"), words=3, similarity=(90, 100))
    return ngram_join.named_pairs(classes, links)


@query(
    "op3_exact_dedup",
    f"""
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
       doc_id = max(doc_id) OVER t AS kept, sha256(x) AS text_sha256
FROM (SELECT doc_id, {LOWERED} AS x FROM documents) WINDOW t AS (PARTITION BY x)
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), COUNT_MODEL)
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "n_exact", "n_near", "n_quoted"
    )


@query("op6_chat_formatting")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "'</s>[INST] ok [/INST]'"
    more = spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', {said}), (-1L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    back = chat.read_windows(chat.format_windows(turns))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


@query("op7_quality_lm")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are documents labelled as good and not toxic."""
    labels = table(spark, sf_dir, "labels")
    trusted = labels.where("quality = 1 and toxic = 0").select("doc_id")
    return quality_lm.perplexities(table(spark, sf_dir, "documents"), trusted)


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


@query("op9_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        "spans",
    )


@query(
    "op11_line_dedup",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     e AS (SELECT r, k, ls[k] AS line FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS k FROM d)),
     l AS (
       SELECT r, k, line, trim({LOWERED.replace("coalesce(text, '')", "line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
       FROM e),
     common AS (SELECT key FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
     kept AS (
       SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS body FROM l
       WHERE key NOT IN (FROM common) GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, (len(ls) - coalesce(n, 0))::BIGINT AS n_dropped,
       sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more share."""
    found = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op13_source_divergence",
    rf"""
WITH d AS (
       SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWERED} AS x FROM documents),
     t AS (SELECT r, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
     v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
     g AS (SELECT DISTINCT lang, source FROM d),
     s AS (SELECT lang, source, coalesce(sum(c.n), 0)::BIGINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
     p AS (
       SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
              1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p,
              1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v) AS q
       FROM s JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
     pairs AS (
       SELECT g.lang, g.source, 'pair' AS part, h.source AS item,
              coalesce(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)), 0) AS value
       FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
            LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source
            LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term
       GROUP BY g.lang, g.source, h.source),
     terms AS (
       SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
     ranked AS (
       SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
       FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all pairs of sources of a language, and each source's ten most typical terms."""
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


@query(
    "op12_ranked_search",
    rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
     b AS (SELECT row_number() OVER () AS i, item_id, {WORDS} AS w FROM benchmark),
     q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(w) AS term FROM b) GROUP BY i, term),
     t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
     total AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS nw FROM d WHERE len(w) > 0),
     m AS (SELECT r, doc_id, 100 - 25 + (25 * len(w) * nd) // nw AS m FROM d, total WHERE len(w) > 0),
     weight AS (
       SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, total GROUP BY term, nd),
     scores AS (
       SELECT i, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
       FROM q JOIN weight USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY i, r),
     ranked AS (
       SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
       FROM scores JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN b USING (i) WHERE rank <= 20
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
