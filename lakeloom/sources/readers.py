"""Sources."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.functions.scalars import hex_to_int

# Choices of the generated rows.
STATUSES = ["completed", "completed", "completed", "returned", "cancelled"]
TIERS = ["bronze", "silver", "gold", "platinum"]

# URI schemes and the Hadoop scheme that serves them; others serve themselves.
URI_SCHEMES = {
    "abfs": "abfss",
    "abfss": "abfss",
    "s3": "s3a",
    "s3a": "s3a",
    "gs": "gs",
    "gcs": "gs",
    "file": "file",
}


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def scan_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines or arrays; the schema is explicit so no inference pass is run."""
    return spark.read.schema(schema).option("multiLine", "false").json(path)


def inbox_scan(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """CSV files dropped below ``pattern``, each row with the identity of its file."""
    rows = spark.read.schema(schema).option("header", "true").csv(pattern)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )


def scan_uri(
    spark: SparkSession,
    uri: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read any URI a Hadoop file system serves; the case of its scheme does not count.

    ``options`` holds store settings (keys, endpoints); they apply to this read only.
    """
    scheme, sep, rest = uri.partition("://")
    if sep:
        scheme = scheme.lower()
        uri = f"{URI_SCHEMES.get(scheme, scheme)}://{rest}"
    reader = spark.read.format(fmt).options(**(options or {}))
    return (reader.schema(schema) if schema else reader).load(uri)


def synthesize_rows(ids: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """Repeatable order-like facts, one per id.

    Every attribute is a hash of (seed, id, attribute), so any task can produce
    any row and a retried task produces the same one.
    """

    def draw(name: str, modulus: int):
        token = F.concat_ws(":", F.lit(str(seed)), F.lit(name), F.col(id_col).cast("string"))
        return F.pmod(hex_to_int(F.substring(F.md5(token), 1, 8)), F.lit(modulus))

    pick = lambda name, items: F.element_at(
        F.array(*[F.lit(i) for i in items]), (draw(name, len(items)) + 1).cast("int")
    )
    return ids.select(
        F.col(id_col).alias("order_id"),
        draw("customer", 10_000).alias("customer_id"),
        draw("product", 500).alias("product_id"),
        (draw("quantity", 20) + 1).alias("quantity"),
        ((draw("price", 49_501) + 500) / 100).alias("unit_price"),
        F.format_string(
            "2022-%02d-%02d", draw("month", 12) + 1, draw("day", 28) + 1
        ).alias("order_date"),
        pick("status", STATUSES).alias("status"),
        pick("tier", TIERS).alias("tier"),
    )
