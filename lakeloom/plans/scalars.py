"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import scalars as S
from lakeloom.plans.registry import query
from lakeloom.session import shuffle_partitions


@query("upper", "F1", "SELECT c_custkey, upper(c_mktsegment) AS tier FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.upper("c_mktsegment").alias("tier"))


SQL_WHITE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\v]"


@query(
    "strip_lower",
    "F2",
    f"""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(text, '^{SQL_WHITE}+', ''),
          '{SQL_WHITE}+$', ''))) AS clean_md5 FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", F.md5(S.strip_lower("text")).alias("clean_md5"))


@query("format_prefix", "F3", "SELECT o_orderkey, 'result: ' || o_orderpriority AS line FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.format_prefix("result", "o_orderpriority").alias("line"))


@query("prefix", "F4", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.month_of("o_orderdate").alias("month"))


@query(
    "zero_pad",
    "F5",
    """SELECT c_custkey, 'Customer_' || lpad(c_custkey::VARCHAR, 7, '0') AS name,
              'T' || lpad(c_nationkey::VARCHAR, 4, '0') AS ticker FROM customer""",
)
def _(t):
    return t.customer.select(
        "c_custkey",
        S.zero_pad("c_custkey", 7, "Customer_").alias("name"),
        S.zero_pad("c_nationkey", 4, "T").alias("ticker"),
    )


@query(
    "percent_format",
    "F6",
    """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
            r AS (SELECT event_type, round(n::DECIMAL(20,0) / (SELECT sum(n) FROM c), 4) AS rate
                  FROM c)
       SELECT string_agg(event_type || ': ' || round(rate::DECIMAL(18,8) * 100, 2)::DECIMAL(18,2)
                || '%', chr(10) ORDER BY event_type) AS report,
              (SELECT sum(n) FROM c)::BIGINT AS total FROM r""",
)
def _(t):
    from lakeloom.operators.aggregates import share_of_total, type_counts

    rates = share_of_total(type_counts(t.events, "event_type"))
    line = F.concat("event_type", F.lit(": "), S.percent_format("rate"))
    # one line per event type: the list is as short as the report itself
    return rates.groupBy("total").agg(
        F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("report")
    )


@query("md5_8", "F7", "SELECT event_id, substr(md5(event_id::VARCHAR), 1, 8) AS hash FROM events")
def _(t):
    return t.events.select("event_id", S.md5_8("event_id").alias("hash"))


@query(
    "sha256_hex",
    "F8",
    """SELECT o_orderkey, sha256(o_orderpriority) AS full_hash,
              substr(sha256(o_orderkey::VARCHAR), 1, 8) AS short_hash FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey",
        S.sha256_hex("o_orderpriority").alias("full_hash"),
        S.sha256_hex("o_orderkey", 8).alias("short_hash"),
    )


@query(
    "sha256_iterated",
    "F9",
    """SELECT c_custkey, substr(list_reduce(list_concat([c_custkey::VARCHAR], range(1, 501)::VARCHAR[]),
              lambda a, b: sha256(a)), 1, 16) AS hash FROM customer""",
)
def _(t):
    # 500 digests per row: spread by work, not by bytes
    keys = t.customer.select("c_custkey").repartition(shuffle_partitions(t.spark))
    return keys.select(
        "c_custkey", F.substring(S.sha256_iterated("c_custkey", 500), 1, 16).alias("hash")
    )


@query(
    "hex_to_int",
    "F10",
    "SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 10000 AS users FROM customer",
)
def _(t):
    return t.customer.select(
        "c_custkey", (S.hex_to_int(S.md5_8("c_name")) % 10000).alias("users")
    )


@query(
    "unit_score",
    "F11",
    """SELECT c_custkey, ('0x' || substr(md5(c_name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score
       FROM customer""",
)
def _(t):
    return t.customer.select("c_custkey", S.unit_score("c_name").alias("score"))


@query(
    "square_scale",
    "F12",
    """SELECT event_id, round(pow(value, 2), 6) AS squared, round(value * 0.85, 6) AS scaled,
              round(value / 100, 6) AS hundredth FROM events""",
)
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id",
        F.round(F.pow(v, F.lit(2)), 6).alias("squared"),
        F.round(v * 0.85, 6).alias("scaled"),
        F.round(v / 100, 6).alias("hundredth"),
    )


@query(
    "sin_cos",
    "F13",
    """SELECT c_custkey, round(sin(c_custkey * 0.3) * 100, 6) AS wave,
              round(cos(c_custkey * 0.2), 6) AS swing FROM customer""",
)
def _(t):
    key = F.col("c_custkey")
    return t.customer.select(
        "c_custkey",
        F.round(F.sin(key * 0.3) * 100, 6).alias("wave"),
        F.round(F.cos(key * 0.2), 6).alias("swing"),
    )


@query(
    "round_n",
    "F14",
    """SELECT l_orderkey, round(l_extendedprice::DECIMAL(18,4) * l_tax::DECIMAL(18,4), 2)::DOUBLE AS tax2
       FROM lineitem""",
)
def _(t):
    tax = S.round_money(S.money("l_extendedprice") * S.money("l_tax"), 2)
    return t.lineitem.select("l_orderkey", tax.cast("double").alias("tax2"))


@query("text_length", "F15", "SELECT doc_id, length(text) * 100 AS price FROM documents")
def _(t):
    return t.documents.select(
        "doc_id", (F.length("text").cast("bigint") * 100).alias("price")
    )


@query(
    "parse_int",
    "F16",
    """SELECT p_partkey, try_cast(substr(p_brand, 7) AS BIGINT) AS brand_no,
              coalesce(try_cast(substr(p_brand, 6) AS BIGINT), -1) AS bad_no FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        S.parse_int("p_brand", 6).alias("brand_no"),
        S.fill_default(S.parse_int("p_brand", 5), -1).alias("bad_no"),
    )


@query(
    "json_get",
    "F17",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k,
              '{"id":' || event_id || ',"type":"' || event_type || '"}' AS encoded FROM events""",
)
def _(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select(
        "event_id",
        parsed["k"].alias("k"),
        F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias(
            "encoded"
        ),
    )


@query(
    "safe_name",
    "F18",
    r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
          url || '[k=' || page_id || ', t=ä]', '/', '__'), ':', '--'), '[', '_'), ']', ''), '=', '_'),
          ',', '_'), ' ', '_'), '[^\p{L}\p{N}_.\-]', '_', 'g')) AS name_md5 FROM pages""",
)
def _(t):
    text = F.concat("url", F.lit("[k="), F.col("page_id").cast("string"), F.lit(", t=ä]"))
    return t.pages.select("page_id", F.md5(S.safe_name(text)).alias("name_md5"))


@query(
    "fill_default",
    "F19",
    """SELECT doc_id, coalesce(quality, -1)::BIGINT AS quality FROM documents
       LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    df = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return df.select("doc_id", S.fill_default("quality", -1).cast("bigint").alias("quality"))


@query(
    "array_map_helpers",
    "F20",
    """SELECT c_custkey,
              array_to_string(list_sort([c_name, 'm'] || [c_mktsegment]), '|') AS merged,
              'c=' || c_nationkey || ',name=' || c_name || ',tier=' || upper(c_mktsegment) AS zipped
       FROM customer""",
)
def _(t):
    merged = S.sorted_concat(F.array("c_name", F.lit("m")), F.array("c_mktsegment"))
    base = F.create_map(F.lit("name"), "c_name", F.lit("tier"), "c_mktsegment")
    later = S.zip_map(
        F.array(F.lit("tier"), F.lit("c")),
        F.array(F.upper("c_mktsegment"), F.col("c_nationkey").cast("string")),
    )
    from lakeloom.operators.partitions import key_suffix

    return t.customer.select(
        "c_custkey",
        F.array_join(merged, "|").alias("merged"),
        key_suffix(S.merge_maps(base, later)).alias("zipped"),
    )
