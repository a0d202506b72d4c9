"""The general data-preparation queries (p1, p3, p5, p7) over the sales tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DECIMAL, is_blank, parse_date, parse_exact, text, upper_text
from ..operators import corrupt_rows, load_profile, packed_values, rolling
from ..session import cut
from ..sources.sales import SALES_COLUMNS
from ..sources.tables import table

KINDS = {"quantity": "integer", "amount": "decimal", "order_date": "date"}
CATEGORIES, IDENTIFIERS, SEQUENCES = ("status", "size"), ("order_id", "source_index"), ("source_index",)
WINDOWS = (7, 30)
NUMERIC = ("amount", "quantity", "source_index")


def promotions(spark: SparkSession, d: str) -> DataFrame:
    return packed_values.unpack(table(spark, d, "amazon_sales"), "promotion_ids", ["row_id"], table(spark, d, "promotion_list"), "promotion_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return promotions(spark, d).select("row_id", "pos", F.col("value").alias("promotion_id"))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    """(error, is_listed, n_values, n_rows) of all values."""
    return promotions(spark, d).groupBy("error", "is_listed").agg(F.count(F.lit(1)).alias("n_values"), F.count_distinct("row_id").alias("n_rows"))


def p1_errors(spark: SparkSession, d: str) -> DataFrame:
    """Values with a malformed quote or outside the promotion list."""
    return promotions(spark, d).where(F.col("error").isNotNull() | ~F.col("is_listed"))


def sales_checked(spark: SparkSession, d: str) -> DataFrame:
    return corrupt_rows.classify_columns(table(spark, d, "amazon_sales"), KINDS)


def lines_checked(spark: SparkSession, d: str) -> DataFrame:
    return corrupt_rows.parse_lines(table(spark, d, "sales_raw"), "raw_line", SALES_COLUMNS, KINDS, ["row_id", "raw_line"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    bad = sales_checked(spark, d).where(F.size("reasons") > 0).select("row_id")
    return bad.unionByName(lines_checked(spark, d).where(F.size("reasons") > 0).select("row_id"))


def p3_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Each rejected row with its reasons as one text and, for raw lines, the line as it was."""
    cols = ["row_id", F.array_join("reasons", ",").alias("reasons")]
    none = F.lit(None).cast("string").alias("raw_text")
    lines = lines_checked(spark, d).where(F.size("reasons") > 0).select(*cols, F.col("raw_line").alias("raw_text"))
    return sales_checked(spark, d).where(F.size("reasons") > 0).select(*cols, none).unionByName(lines)


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    """All valid rows of both tables, the checked columns typed."""
    keep = ["row_id", *SALES_COLUMNS]
    both = sales_checked(spark, d).select(*keep, "reasons").unionByName(lines_checked(spark, d).select(*keep, "reasons"))
    return corrupt_rows.typed(corrupt_rows.split_rows(both)[0], KINDS)


def dated_sales(spark: SparkSession, d: str) -> DataFrame:
    sales = table(spark, d, "amazon_sales")
    return sales.select(upper_text("ship_state").alias("ship_state"), upper_text("size").alias("size"), parse_date("order_date").alias("order_day"), parse_exact("amount").alias("amount"), "load_id")


def stated() -> Column:
    """Entities are states; rows without one only take part in the range of days."""
    return F.col("ship_state").isNotNull()


def p5_rolling_state_size(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(dated_sales(spark, d), ["ship_state", "size"], F.col("order_day"), F.col("amount"), WINDOWS, stated())


def p5_rolling_state(spark: SparkSession, d: str) -> DataFrame:
    return rolling.rolling_totals(dated_sales(spark, d), ["ship_state"], F.col("order_day"), F.col("amount"), WINDOWS, stated())


def p5_late_corrections(spark: SparkSession, d: str) -> DataFrame:
    """The trees of all loads but the last, brought up to date by the last load's rows as corrections."""
    sales = dated_sales(spark, d)
    entity, newest = ["ship_state"], sales.agg(F.max("load_id")).first()[0]
    last = F.col("load_id") == F.lit(newest)
    days = lambda part: rolling.daily(part, entity, F.col("order_day"), F.col("amount"))
    stored = cut(rolling.tree_nodes(days(sales.where(~last)), entity))
    return rolling.answers(cut(rolling.apply_corrections(stored, days(sales.where(last)), entity)), entity, WINDOWS, stated())


def p5_left_out(spark: SparkSession, d: str) -> DataFrame:
    """(row_id, reason) of rows that take no part in the totals, or whose amount takes none: no_day, no_state, no_amount (blank), amount_invalid,
    amount_too_large (more digits than exact sums hold)."""
    sales = table(spark, d, "amazon_sales")
    amount = text("amount")
    reason = (
        F.when(parse_date("order_date").isNull(), "no_day").when(is_blank("ship_state"), "no_state").when(amount.isNull(), "no_amount")
        .when(~amount.rlike(DECIMAL), "amount_invalid").when(parse_exact("amount").isNull(), "amount_too_large")
    )
    return sales.select("row_id", reason.alias("reason")).where("reason IS NOT NULL")


def _rounded(changes: DataFrame) -> DataFrame:
    return changes.withColumn("shift", F.round("shift", 6))


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(load_profile.changed_loads(table(spark, d, "amazon_sales"), "load_id", CATEGORIES, IDENTIFIERS, SEQUENCES))


def p7_column_changes(spark: SparkSession, d: str) -> DataFrame:
    """p7_changes for every column: blanks, written forms, single and rare values of all of them."""
    return _rounded(load_profile.changed_loads(table(spark, d, "amazon_sales"), "load_id", SALES_COLUMNS, SALES_COLUMNS, SEQUENCES))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_changes(spark, d).select("load_id", "column_name").distinct()


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    sales = table(spark, d, "amazon_sales")
    found = load_profile.profile(sales, "load_id", SALES_COLUMNS, NUMERIC)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "stddev", "skewness", "shift")})


def p7_numeric_profile(spark: SparkSession, d: str) -> DataFrame:
    """Valid counts and ranges of the numeric columns as numbers."""
    return load_profile.numeric_ranges(table(spark, d, "amazon_sales"), "load_id", NUMERIC)


def p7_numeric_shift(spark: SparkSession, d: str) -> DataFrame:
    sums = load_profile.power_sums(table(spark, d, "amazon_sales"), "load_id", ["amount", "quantity"])
    return load_profile.standardised_shift(sums).select("load_id", "column_name", "valid", "beyond", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "skewness", "shift")])


def p7_pattern_violations(spark: SparkSession, d: str) -> DataFrame:
    patterns = {"order_id": r"^[A-Z][0-9]+-[0-9]+-[0-9]+$", "source_index": r"^[0-9]+$", "ship_postal_code": r"^[0-9]{6}(\.0)?$", "order_date": r"^[0-9]{2}-[0-9]{2}-[0-9]{2}$"}
    return load_profile.pattern_violations(table(spark, d, "amazon_sales"), "load_id", patterns)


QUERIES = {f.__name__: f for f in (p1_found, p1_summary, p1_errors, p3_found, p3_rejects, p3_loaded, p5_rolling_state_size, p5_rolling_state, p5_late_corrections, p5_left_out, p7_found, p7_changes, p7_column_changes, p7_profile, p7_numeric_profile, p7_numeric_shift, p7_pattern_violations)}
