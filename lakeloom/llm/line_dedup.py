"""Removal of lines that many documents share, with DataFrame functions only.

Lines are normalised and hashed to 128 bits; each document gives each of its
hashes once, and hashes found in enough documents are common. A second pass
joins the lines with the common hashes and collects the positions of the dropped
lines under a 128-bit key of the whole text, so that no row needs a number and
copies of a text share their positions. A third pass reads the texts again and
puts the lines at the other positions together.

Counts and positions are combined before they are shuffled, so a line or a text
that a third of the rows hold is one row a task. The text pass joins on the
text's key; adaptive execution splits the rows of a text with many copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.tables import small
from lakeloom.session import materialize

#: Lines found in this many documents go, if their key has this many code points.
THRESHOLD, MIN_CHARS = 10, 1
#: White space that a key has at neither end: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of single bytes take the shorter way."""
    single = F.octet_length(text) == F.char_length(text)
    return F.when(single, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    return F.transform(F.split(lower_az(text), "\n"), lambda line: F.btrim(line, F.lit(BLANK)))


def hash128(value: Column) -> list[Column]:
    """Two independent 64-bit hashes; the second starts from another seed."""
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(1), value).alias("h2")]


def common_lines(texts: DataFrame, threshold: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the line keys found in at least ``threshold`` rows of ``texts`` (_text)."""
    keys = texts.select(F.explode(F.array_distinct(line_keys(F.col("_text")))).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars).select(*hash128(F.col("key")))
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold).drop("n")


def dropped_positions(texts: DataFrame, common: DataFrame, min_chars: int) -> DataFrame:
    """(t1, t2, dropped): the positions of common lines, for each different text that has any."""
    lines = texts.select(*text_key(), F.posexplode(line_keys(F.col("_text"))).alias("pos", "key"))
    # without this test a common key could share its hash with a shorter one
    lines = lines.where(F.char_length("key") >= min_chars).select("t1", "t2", "pos", *hash128(F.col("key")))
    found = lines.join(common, ["h1", "h2"], "left_semi")
    return found.groupBy("t1", "t2").agg(F.collect_set("pos").alias("dropped"))


def text_key() -> list[Column]:
    return [h.alias(f"t{k}") for k, h in enumerate(hash128(F.col("_text")), 1)]


def drop_common_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept), one row per row of ``docs``.

    A text is split at line feeds; null and empty texts are one empty line. A
    line's key is the line without white space at both ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in at least ``threshold``
    rows lose all their lines in every row; a row counts once for a key,
    however often it has the line, and rows that repeat an id or a whole text
    count each. ``n_lines`` is the number of lines before, ``kept`` the other
    lines as they were, joined by line feeds (empty if none is left). A null id
    stays null. An empty table gives an empty result. Other columns are not
    read. A text of any length is one row, with its positions beside it.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    common = small(materialize(common_lines(texts, threshold, min_chars), "common_lines"), 32)
    dropped = materialize(dropped_positions(texts, common, min_chars), "dropped_lines")
    rows = texts.select("doc_id", "_text", *text_key()).join(dropped, ["t1", "t2"], "left")
    lines = F.split("_text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped")
    # an array of one binds the lines once for all positions
    picked = F.transform(F.array(lines), lambda every: F.transform(left, lambda at: F.get(every, at)))
    return rows.select(
        "doc_id",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(F.array_join(picked[0], "\n")).alias("kept"),
    )
