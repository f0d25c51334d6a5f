"""Chat formatting into budgeted windows, with DataFrame functions only.

All turns are sorted into even parts, so that a conversation of any length is
many groups. Prefix sums over the parts' token sums and then within each part
give every turn its place in its conversation, which deals the turns to spans of
``stride`` tokens; a span never cuts a turn. A window is a span with the
conversation's first system turn in front and the last turns before the span, up
to ``history`` tokens, as context. Only turns that a window brings for the first
time, said by the assistant, are under its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.session import materialize, shuffle_partitions

# Control strings of public chat templates.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]"

#: Windows in a block.
BLOCK_WINDOWS = 64
#: Tokens of a span, and of the turns repeated before it.
STRIDE, HISTORY = 1024, 512


def escape(text: Column) -> Column:
    """Makes control strings in a text ordinary: one backslash more behind the first character."""
    return F.regexp_replace(text, rf"([<\[])(\\*)({_CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_CONTROL})", "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line: a role ends at the first line feed."""
    line = F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n"))
    return escape(line)


def unescape_role(role: Column) -> Column:
    line = F.replace(unescape(role), F.lit("\\n"), F.lit("\n"))
    return F.replace(line, F.lit("\\b"), F.lit("\\"))


def turn_tokens(text: Column) -> Column:
    """Words and marks of a text, and four for the turn's own marks."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 4).cast("bigint")


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, turn, role, text, tokens, start, total, leads): tokens of the conversation before each turn and in all.

    ``leads`` marks the conversation's first system turn.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text", "tie")]
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        # repeated rows may fall into several parts
        F.monotonically_increasing_id().alias("tie"),
    )
    parts = shuffle_partitions(turns.sparkSession)
    sorted_ = rows.repartitionByRange(parts, F.col("conv_id").asc_nulls_first(), *order)
    rows = materialize(
        sorted_.withColumn("part", F.spark_partition_id()).withColumn("tokens", turn_tokens(F.col("text"))), "turns"
    )
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        rows.groupBy("conv_id", "part")
        .agg(F.sum("tokens").alias("size"), F.min(F.when(F.col("role") == "system", F.col("part"))).alias("has_system"))
        .withColumn("base", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
        .withColumn("total", F.sum("size").over(Window.partitionBy("conv_id")))
        .withColumn("lead_part", F.min("has_system").over(Window.partitionBy("conv_id")))
        .select(F.col("conv_id").alias("of"), F.col("part").alias("in_part"), "base", "total", "lead_part")
    )
    before = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.count(F.when(F.col("role") == "system", 1)).over(before), F.lit(0))
    leads = (F.col("role") == "system") & (F.col("part") == F.col("lead_part")) & (earlier == 0)
    return (
        rows.join(sums, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
        .withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        .withColumn("leads", F.coalesce(leads, F.lit(False)))
        .select("conv_id", "turn", "role", "text", "tokens", "start", "total", "leads")
    )


def _led(placed: DataFrame, stride: int) -> DataFrame:
    """The conversation's first system turn, once for each later window."""
    block = lambda span: F.floor(span / BLOCK_WINDOWS).cast("bigint")
    since, last = F.floor(F.col("start") / stride), F.floor((F.col("total") - 1) / stride)
    system = placed.where("leads").select(
        F.col("conv_id").alias("of"),
        since.alias("since"),
        "start",
        "turn",
        "text",
        "tokens",
        F.explode(F.sequence(block(since), block(last))).alias("in_block"),
    )
    windows = placed.select("conv_id", F.floor(F.col("start") / stride).cast("bigint").alias("window")).distinct()
    match = F.col("conv_id").eqNullSafe(F.col("of")) & (block(F.col("window")) == F.col("in_block"))
    return (
        windows.join(system, match)
        .where("window > since")
        .select(
            "conv_id", "turn", F.lit("system").alias("role"), "text", "start", "tokens", "window",
            F.lit(True).alias("repeated"), F.lit(0).alias("rank"),
        )
    )


def format_windows(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    stride: int = STRIDE,
    history: int = HISTORY,
) -> DataFrame:
    """(conv_id, block, window, text, turns, loss, n_tokens), one row per window.

    ``turns`` (start, end, role, repeated) and ``loss`` (start, end) are ranges
    of code points of ``text``. Every row of the input is new in exactly one
    window and repeated in the windows that use it as history or as the system
    turn. A window has at most ``stride`` tokens of new turns besides its last
    one; a turn longer than that still stays whole. ``history`` may not be above
    ``stride``. ``window`` rises within a conversation, with gaps behind longer
    turns; ``block`` counts each 64 of these numbers.

    A null text or role is empty; a null turn number comes before the others;
    rows that tie in conversation and turn are ordered by role and text, and
    repeated rows are turns of their own; rows of a null conversation form one
    conversation. An empty table gives no windows. Other columns are not read.
    """
    if not 0 <= history <= stride:
        raise ValueError("history must be from 0 to stride")
    placed = _placed(turns, conv, turn, role, text)
    spans = placed.withColumn("span", F.floor(F.col("start") / stride).cast("bigint"))
    in_span = Window.partitionBy("conv_id", "span")
    spans = spans.withColumn("span_end", F.max(F.col("start") + F.col("tokens")).over(in_span))
    target = lambda window, repeated, rank: F.struct(
        window.cast("bigint").alias("window"), F.lit(repeated).alias("repeated"), F.lit(rank).alias("rank")
    )
    none = F.array().cast("array<struct<window:bigint,repeated:boolean,rank:int>>")
    # what fits the history lies in the span before, as it is no longer than a span
    recent = ~F.col("leads") & (F.col("span_end") < F.col("total")) & (F.col("span_end") - F.col("start") <= history)
    targets = F.concat(
        F.array(target(F.col("span"), False, 2)),
        F.when(recent, F.array(target(F.floor(F.col("span_end") / stride), True, 1))).otherwise(none),
    )
    own = spans.select("conv_id", "turn", "role", "text", "start", "tokens", F.explode(targets).alias("t")).select(
        "conv_id", "turn", "role", "text", "start", "tokens", "t.*"
    )
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    dealt = own.unionByName(_led(placed, stride)).select(
        "conv_id",
        F.floor(F.col("window") / BLOCK_WINDOWS).cast("bigint").alias("block"),
        "window",
        "turn",
        "role",
        "start",
        "tokens",
        "repeated",
        "rank",
        head.alias("head"),
        escape(F.col("text")).alias("body"),
    )
    dealt = dealt.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    ahead = (
        Window.partitionBy("conv_id", "block", "window")
        .orderBy("rank", "start", F.col("turn").asc_nulls_first(), "role", "body")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    laid = dealt.withColumn("at", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    part = F.struct(
        F.col("at").alias("start"),
        (F.col("at") + F.col("size")).alias("end"),
        "role",
        "repeated",
        (F.col("at") + F.length("head")).alias("from"),
        (F.col("at") + F.col("size") - len(CLOSE)).alias("to"),
        F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
    )
    return (
        laid.groupBy("conv_id", "block", "window")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("tokens").alias("n_tokens"))
        .select(
            "conv_id",
            "block",
            "window",
            F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("text"),
            F.transform(
                "parts",
                lambda p: F.struct(
                    p["start"].alias("start"), p["end"].alias("end"), p["role"].alias("role"), p["repeated"].alias("repeated")
                ),
            ).alias("turns"),
            F.transform(
                F.filter("parts", lambda p: (p["role"] == "assistant") & ~p["repeated"]),
                lambda p: F.struct(p["from"].alias("start"), p["to"].alias("end")),
            ).alias("loss"),
            "n_tokens",
        )
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars): conversations read back from their windows.

    ``turns`` are role, line feed, text, line feed of every turn in order;
    ``loss_text`` is all text under the loss masks, unescaped. One conversation
    is one row, as long as all its text.
    """

    def between(start: Column, end: Column) -> Column:
        return F.substring(F.col("text"), start.cast("int") + 1, (end - start).cast("int"))

    def read_turn(t: Column) -> Column:
        piece = between(t["start"], t["end"])
        role = F.regexp_extract(piece, r"(?s)^<\|im_start\|>([^\n]*)\n", 1)
        skip = F.length(role) + len(OPEN) + 1
        body = F.substring(piece, skip + 1, F.length(piece) - skip - len(CLOSE))
        return F.concat(unescape_role(role), F.lit("\n"), unescape(body), F.lit("\n"))

    own = F.filter("turns", lambda t: ~t["repeated"])
    parts = windows.select(
        "conv_id",
        F.struct(
            "block",
            "window",
            F.size(own).cast("bigint").alias("n"),
            F.array_join(F.transform(own, read_turn), "").alias("said"),
            F.array_join(F.transform("loss", lambda s: unescape(between(s["start"], s["end"]))), "").alias("loss"),
            F.length("text").cast("bigint").alias("chars"),
        ).alias("part"),
    )
    total = lambda name: F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p[name])
    joined = lambda name: F.array_join(F.transform("parts", lambda p: p[name]), "")
    return (
        parts.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id",
            total("n").alias("n_turns"),
            joined("said").alias("turns"),
            joined("loss").alias("loss_text"),
            total("chars").alias("formatted_chars"),
        )
    )
