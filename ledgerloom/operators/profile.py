"""Whole-table profile in one pass, frequency tables, and their Markdown report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import DECIMAL, INTEGER, is_blank, list_items, month_of, parse_date, text, trimmed, upper_text
from ..session import bounded_rows


def integrity(raw: DataFrame) -> DataFrame:
    """One row of integrity metrics of raw sales rows."""
    bad = lambda c, p: F.count_if(F.coalesce(~text(c).rlike(p), F.lit(False)))
    rows = raw.select("*", parse_date("order_date").alias("_d"), F.size(list_items("promotion_ids")).alias("_p"), upper_text("ship_state").alias("_s"))
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("_d").alias("parsed_dates"),
        F.count_if(F.col("_d").isNull()).alias("invalid_dates"),
        F.min("_d").alias("min_date"),
        F.max("_d").alias("max_date"),
        bad("quantity", INTEGER).alias("invalid_quantities"),
        bad("amount", DECIMAL).alias("invalid_amounts"),
        F.count_if(F.col("_s") == "APO").alias("apo_rows"),
        F.min("_p").cast("bigint").alias("min_promotions"),
        F.max("_p").cast("bigint").alias("max_promotions"),
        F.avg("_p").alias("avg_promotions"),
    )


def distinct_values(raw: DataFrame) -> DataFrame:
    """(metric, value): distinct order ids and states, and surplus rows of repeated indexes."""
    orders = raw.where(~is_blank("order_id")).agg(F.count_distinct("order_id").alias("value")).select(F.lit("distinct_order_ids").alias("metric"), "value")
    states = raw.agg(F.count_distinct(upper_text("ship_state")).alias("value")).select(F.lit("distinct_states").alias("metric"), "value")
    repeated = raw.groupBy("source_index").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value"))
    return orders.unionByName(states).unionByName(repeated.select(F.lit("duplicate_index_rows").alias("metric"), "value"))


def blanks(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, blank_rows) of all columns from one pass."""
    counts = raw.agg(*[F.count_if(is_blank(c)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("blank_rows")) for c in columns])).alias("_p")
    return counts.select(pairs).select("_p.*")


def frequencies(raw: DataFrame, column: str, upper: bool = False) -> DataFrame:
    """(value, n) by trimmed value, most frequent first."""
    v = trimmed(column)
    return raw.groupBy((F.upper(v) if upper else v).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value"))


def group_sizes(rows: DataFrame, group: Sequence[str], above: int = 1000) -> DataFrame:
    """One row: number of groups, of groups above a size, and the largest size, for skew and partition estimates."""
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("group_count"), F.count_if(F.col("n") > above).alias("large_groups"), F.max("n").alias("largest"))


def largest_group(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *group).limit(1)


def largest_sku_month(raw: DataFrame) -> DataFrame:
    """(sku, month, n): the SKU and month of the order date with most raw rows, ties by name. Rows without a SKU or a valid date take no part."""
    rows = raw.select(upper_text("sku").alias("sku"), month_of(parse_date("order_date")).alias("month"))
    return largest_group(rows.where(F.col("sku").isNotNull() & F.col("month").isNotNull()), ["sku", "month"])


def partition_estimate(total_bytes: int, rows: int, largest: int, partition_bytes: int = 128 * 1024 * 1024) -> dict:
    """Bytes of the largest group at the average row size, against a read partition."""
    size = total_bytes * largest / rows if rows else 0.0
    return {"largest_bytes": size, "partitions": size / partition_bytes, "fits": size <= partition_bytes}


def markdown_table(header: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *map(line, rows)])


def report(raw: DataFrame, columns: Sequence[str], most: int = 10_000) -> str:
    """Markdown of the whole profile; frequency tables are those of low-cardinality columns and are checked for size."""
    metrics = [*integrity(raw).first().asDict().items(), *[(r["metric"], r["value"]) for r in distinct_values(raw).collect()]]
    parts = ["# Data profile", "## Input integrity", markdown_table(["Metric", "Value"], [(k, f"{v:.4f}" if isinstance(v, float) else v) for k, v in metrics])]
    if "sku" in columns:
        top = [(r["sku"], r["month"], r["n"]) for r in largest_sku_month(raw).collect()]
        parts += ["## Largest SKU and month", markdown_table(["SKU", "Month", "Rows"], top)]
    parts += ["## Missing values", markdown_table(["Column", "Null or blank rows"], [tuple(r) for r in blanks(raw, columns).collect()])]
    for c, upper in (("status", False), ("size", False), ("ship_state", True)):
        rows = bounded_rows(frequencies(raw, c, upper), most)
        parts += [f"## Distribution of {c}", markdown_table(["Value", "Rows"], [("<NULL>" if r["value"] is None else r["value"], r["n"]) for r in rows])]
    return "\n\n".join(parts) + "\n"
