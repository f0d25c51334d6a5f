"""URL verdicts: host and path rules, then boosted trees on lexical features.

Features are length, depth, digit ratio, entropy, parameter counts and statistics
of the host's suffix over all URLs; the trees are fitted on labelled URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.tables import small
from lakeloom.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host and path)
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Host words that mark a URL as unwanted, for labels where no others are at hand.
SEED_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam")
#: Labelled URLs of each class the trees are fitted on, at most: those of smallest hash.
TRAIN_ROWS = 10_000
#: Folds of hosts; a URL's suffix rate leaves out the labels of its own fold.
FOLDS = 10

FEATURES = (
    "url_length", "host_length", "path_length", "depth", "host_parts", "digit_ratio", "hyphens",
    "host_entropy", "path_entropy", "parameters", "has_fragment", "secure", "suffix_share", "suffix_rate",
)


def host_of(url: Column) -> Column:
    """Behind the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null without one; of equal length, block first, then by name.

    Rules are a short list written by hand; each is one comparison.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[0] != "allow", r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(
        F.array_distinct(chars), F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c))
    )


def suffix_of(host: Column) -> Column:
    """The last two parts of a host, or all of it."""
    return F.substring_index(host, ".", -2)


def features(urls: DataFrame) -> DataFrame:
    """Adds the features that a URL has by itself to (url, host, path)."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return urls.withColumns(
        {
            "url_length": F.length(url).cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": count(F.col("path"), "/"),
            "host_parts": count(F.col("host"), r"\."),
            "digit_ratio": count(url, "[0-9]") / n,
            "hyphens": count(F.col("host"), "-"),
            "host_entropy": entropy(F.col("host")),
            "path_entropy": entropy(F.col("path")),
            "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1),
            "has_fragment": url.contains("#").cast("double"),
            "secure": url.startswith("https").cast("double"),
            "suffix": suffix_of(F.col("host")),
        }
    )


def seed_labels(host: Column, words: Sequence[str] = SEED_WORDS) -> Column:
    """1 for hosts with one of the words between dots and hyphens, else 0; null for an empty host."""
    parts = F.split(host, r"[.\-]")
    return F.when(host != "", F.arrays_overlap(parts, F.array(*map(F.lit, words))).cast("int"))


def judge_urls(
    urls: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label: Column | None = None,
    rules: Sequence[tuple[str, str]] = RULES,
    train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """(id, host, path, rule, verdict, score), one row per row of ``urls``.

    ``verdict`` is the longest fitting rule's, else block where ``score``, the
    trees' probability of label 1, is 0.5 or more. ``label`` is a column of
    ``urls``: 1 unwanted, 0 wanted, null unknown; by default the seed words of
    the host give it. Trees are fitted on at most ``train_rows`` URLs of each
    class, those of smallest hash; suffix statistics count all URLs, the rate of
    label 1 those in other folds of hosts than the URL's own.

    A null URL, or one without ``://``, has empty host and path and no rule.
    Null and repeated ids are rows like others. Without labels of both classes
    every score is the share of label 1 (0 without labels). An empty table gives
    no rows. Other columns are not read.
    """
    given = urls if label is None else urls.withColumn("_label_", label)
    base = given.select(
        F.col(id_col),
        F.col(url_col).alias("url"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        *([] if label is None else [F.col("_label_").cast("int").alias("label")]),
    )
    if label is None:
        base = base.withColumn("label", seed_labels(F.col("host")))
    made = features(base).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    folds = materialize(
        made.groupBy("suffix", "fold").agg(
            F.count(F.lit(1)).alias("f_n"),
            F.count("label").alias("f_known"),
            F.coalesce(F.sum("label"), F.lit(0)).alias("f_bad"),
        ),
        "folds",
    )
    suffixes = folds.groupBy("suffix").agg(F.sum("f_n").alias("n"), F.sum("f_known").alias("known"), F.sum("f_bad").alias("bad"))
    suffixes = materialize(suffixes, "suffixes")
    total, known, bad, longest = suffixes.agg(
        F.sum("n"), F.sum("known"), F.sum("bad"), F.max(F.octet_length("suffix"))
    ).first()
    row_bytes = 32 + (longest or 0)
    rate = (bad or 0) / known if known else 0.0
    # the share of label 1 outside each fold, towards which rates of rare suffixes tend
    by_fold = {r[0]: r[1:] for r in folds.groupBy("fold").agg(F.sum("f_known"), F.sum("f_bad")).collect()}
    shares = []
    for fold in range(FOLDS):
        k, b = by_fold.get(fold, (0, 0))
        shares.append((bad - b) / (known - k) if known and known > k else rate)
    outside = F.array(*map(F.lit, shares))
    stats = suffixes.select(
        "suffix",
        F.log10(F.col("n") / F.lit(float(total or 1))).alias("suffix_share"),
        F.col("known").alias("s_known"),
        F.col("bad").alias("s_bad"),
    )
    # what other folds of hosts say of a suffix, so that no host's own label is in its rate
    known_here = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = (
        made.join(small(stats, row_bytes), "suffix", "left")
        .join(small(folds.where("f_known > 0"), row_bytes), ["suffix", "fold"], "left")
        .withColumn(
            "suffix_rate",
            (F.col("s_bad") - known_here("f_bad") + 20 * outside[F.col("fold")])
            / (F.col("s_known") - known_here("f_known") + 20),
        )
    )
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    if not bad or bad == known:
        scored = full.withColumn("score", F.lit(float(rate)))
    else:
        scored = _boosted(full, train_rows)
    return scored.select(
        id_col,
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def _boosted(full: DataFrame, train_rows: int) -> DataFrame:
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    known = full.where("label is not null").select("label", "url", *FEATURES)
    # as many wanted ones as unwanted, each bounded
    sample = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("url"), "url").limit(train_rows)
        sample = part if sample is None else sample.unionByName(part)
    train = materialize(sample, "labelled")
    counts = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    # weights keep the share of the classes out of the fit
    weight = F.when(F.col("label") == 1, F.lit(1.0 / counts[1])).otherwise(F.lit(1.0 / counts[0])) * len(counts)
    trees = GBTClassifier(
        labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, stepSize=0.3, seed=7, minInstancesPerNode=5
    ).fit(assemble.transform(train.withColumn("weight", weight * min(counts.values()))))
    scored = trees.transform(assemble.transform(full))
    return scored.withColumn("score", vector_to_array("probability")[1])
