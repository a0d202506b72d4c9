"""The 24-column sales file: explicit schema, permissive or strict reading, and the canonical typed projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

#: File header and the canonical name of each column, in file order (one header name ends with a space).
HEADER = {
    "index": "source_index", "Order ID": "order_id", "Date": "order_date", "Status": "status", "Fulfilment": "fulfilment",
    "Sales Channel ": "sales_channel", "ship-service-level": "ship_service_level", "Style": "style", "SKU": "sku", "Category": "category",
    "Size": "size", "ASIN": "asin", "Courier Status": "courier_status", "Qty": "quantity", "currency": "currency", "Amount": "amount",
    "ship-city": "ship_city", "ship-state": "ship_state", "ship-postal-code": "ship_postal_code", "ship-country": "ship_country",
    "promotion-ids": "promotion_ids", "B2B": "is_b2b", "fulfilled-by": "fulfilled_by", "Unnamed: 22": "unnamed_22",
}
SALES_COLUMNS = tuple(HEADER.values())
CORRUPT = "_corrupt_record"

#: Order of garment sizes; sizes outside the list have no rank.
SIZE_RANK = {"XS": 1, "S": 2, "M": 3, "L": 4, "XL": 5, "XXL": 6, "3XL": 7, "4XL": 8, "5XL": 9, "6XL": 10}


def raw_schema(corrupt: bool = False) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in HEADER]
    return T.StructType(fields + [T.StructField(CORRUPT, T.StringType())] * corrupt)


def read_raw(spark: SparkSession, path: str, strict: bool = False, multi_line: bool = False) -> DataFrame:
    """All-string rows under canonical names plus `_corrupt_record` (null for sound rows; not there when strict).

    The header is checked by name: a renamed column fails the read. strict fails on the first malformed row; otherwise a row with too few or too
    many fields keeps its raw text. Blank lines give no row.
    """
    reader = (
        spark.read.schema(raw_schema(not strict)).option("header", True).option("enforceSchema", False).option("escape", '"').option("encoding", "UTF-8")
        .option("multiLine", multi_line).option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnPruning", False)  # a pruned parse would not notice a wrong number of fields
    )
    if not strict:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    df = reader.csv(path)
    return df.select(*[F.col(f"`{h}`").alias(c) for h, c in HEADER.items()], *([CORRUPT] if not strict else []))


def canonical(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 31 typed columns of a raw all-string frame; `keep` names further columns to carry along.

    Text is trimmed of characters up to U+0020, blank is null; enumerations are upper-cased; invalid numbers, days and flags are null; no row is
    dropped. Promotions become a distinct array in first-seen order, empty for null. Null-safe flags are never null.
    """
    up, tx = X.upper_text, X.text
    ids = X.list_items("promotion_ids")
    base = raw.select(
        *keep,
        X.parse_long("source_index").alias("source_index"), tx("order_id").alias("order_id"), X.parse_date("order_date").alias("order_date"),
        up("status").alias("status"), up("fulfilment").alias("fulfilment"), up("sales_channel").alias("sales_channel"), up("ship_service_level").alias("ship_service_level"),
        up("style").alias("style"), up("sku").alias("sku"), up("category").alias("category"), up("size").alias("size"), up("asin").alias("asin"),
        up("courier_status").alias("courier_status"), X.parse_int("quantity").alias("quantity"), up("currency").alias("currency"), X.parse_double("amount").alias("amount"),
        up("ship_city").alias("ship_city"), up("ship_state").alias("ship_state"), X.postal_code("ship_postal_code").alias("ship_postal_code"), up("ship_country").alias("ship_country"),
        F.array_distinct(ids).alias("promotion_ids"), F.size(ids).alias("_n"), X.parse_boolean("is_b2b").alias("is_b2b"), up("fulfilled_by").alias("fulfilled_by"),
    )
    shipped = F.coalesce(F.contains(F.col("status"), F.lit("SHIPPED")), F.lit(False))
    cancelled = F.coalesce(F.contains(F.col("status"), F.lit("CANCELLED")), F.lit(False))
    names = [c for c in base.columns if c not in ("_n", "is_b2b", "fulfilled_by", *keep)]
    return base.select(
        *keep, *names,
        F.size("promotion_ids").alias("promotion_count"), (F.col("_n") - F.size("promotion_ids")).alias("duplicate_promotion_count"),
        "is_b2b", "fulfilled_by", X.month_of("order_date").alias("order_month"), X.lookup(F.col("size"), SIZE_RANK).alias("size_rank"),
        shipped.alias("is_shipped"), cancelled.alias("is_cancelled"), (shipped & F.coalesce(F.col("quantity") > 0, F.lit(False))).alias("is_bought"),
        F.coalesce(F.col("ship_state") != "APO", F.lit(False)).alias("is_valid_state"),
    )


def read_sales(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(canonical rows, rejected raw rows with their text); strict returns None for the second and fails on malformed rows."""
    raw = read_raw(spark, path, strict)
    if strict:
        return canonical(raw), None
    # Always true; Spark refuses to read the corrupt text alone, as a count of rejected rows would.
    read = F.coalesce(F.length("source_index") >= 0, F.lit(True))
    return canonical(raw.where(F.col(CORRUPT).isNull() & read)), raw.where(F.col(CORRUPT).isNotNull() & read)
