"""Rows that fail to parse: kept apart with the reason while all others load typed.

Raw lines are read permissively under an explicit all-string schema that retains the corrupt text; the retained and the accepted lines
are then reclassified by quoting, field count and cast checks. Everything is one narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DATE, DECIMAL, INTEGER, is_blank, parse_date, text

#: A quoted field opens at the start or after a comma and closes before a comma or at the end; inside, a quote is doubled; elsewhere none stands.
SOUND_LINE = r'(?s)\A(?:"(?:[^"]++|"")*+"|[^",]*+)(?:,(?:"(?:[^"]++|"")*+"|[^",]*+))*+\z'


def invalid_integer(c: Column | str) -> Column:
    """Non-blank and no 32-bit integer; never null."""
    t = text(c)
    return t.isNotNull() & (~t.rlike(INTEGER) | t.try_cast("int").isNull())


def invalid_decimal(c: Column | str) -> Column:
    return F.coalesce(~text(c).rlike(DECIMAL), F.lit(False))


def invalid_date(c: Column | str, pattern: str = "MM-dd-yy", shape: str = DATE) -> Column:
    t = text(c)
    return t.isNotNull() & (~t.rlike(shape) | F.try_to_date(t, pattern).isNull())


CHECKS = {"integer": invalid_integer, "decimal": invalid_decimal, "date": invalid_date}
CASTS = {
    "integer": lambda c: text(c).try_cast("int"),
    "decimal": lambda c: F.when(text(c).rlike(DECIMAL), text(c).try_cast("double")),
    "date": parse_date,
}


def cast_reasons(columns: dict[str, Column], kinds: dict[str, str]) -> Column:
    """array<string> of `<column>_invalid`, in the order of kinds."""
    return F.array_compact(F.array(*[F.when(CHECKS[kind](columns[name]), F.lit(f"{name}_invalid")) for name, kind in kinds.items()]))


def sound_quoting(line: Column) -> Column:
    return line.rlike(SOUND_LINE)


def field_count(line: Column) -> Column:
    """Fields of a soundly quoted line: commas outside quotes and one."""
    bare = F.regexp_replace(line, r'"[^"]*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def classify_columns(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """`df` with `reasons` (array<string>, empty for valid rows; a column of that name is replaced). Blank and null values are valid; all other
    columns, whatever their names, pass through. An empty table gives an empty table."""
    return df.withColumn("reasons", cast_reasons({c: F.col(c) for c in kinds}, kinds))


def parse_lines(df: DataFrame, line: str, columns: Sequence[str], kinds: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """keys..., the line's columns as strings, corrupt_text, reasons. Blank and null lines are no records and give no row.

    reasons: `quoting_unsound`, `field_count_<n>` for n fields instead of len(columns), `<column>_invalid`; empty for a sound record.
    The columns of an unsound line are null; the raw text stays in corrupt_text. A repeated line gives a row each time.
    """
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `_corrupt` string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "escape": '"', "maxCharsPerColumn": "-1"}
    raw = F.col(line)
    lines = df.where(~is_blank(line)).select(*keys, raw.alias("_line"))
    # A generator keeps Catalyst from inlining the parse into each of the fields' checks.
    parsed = F.explode(F.array(F.struct(sound_quoting(F.col("_line")).alias("_sound"), F.from_csv(F.col("_line"), F.lit(schema), options).alias("_r")))).alias("_p")
    read = lines.select(*keys, "_line", parsed).select(*keys, "_line", "_p.*")
    count = F.when(F.col("_sound"), field_count(F.col("_line")))
    whole = F.col("_sound") & (count == len(columns))
    shape = F.when(~F.col("_sound"), F.array(F.lit("quoting_unsound"))).when(~whole, F.array(F.concat(F.lit("field_count_"), count.cast("string"))))
    reasons = F.coalesce(shape, cast_reasons({c: F.col(f"_r.`{c}`") for c in columns}, kinds))
    return read.select(*keys, *[F.when(whole, F.col(f"_r.`{c}`")).alias(c) for c in columns], F.coalesce(F.col("_r._corrupt"), F.when(~whole, F.col("_line"))).alias("corrupt_text"), reasons.alias("reasons"))


def split_rows(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of a frame with `reasons`."""
    return classified.where(F.size("reasons") == 0).drop("reasons"), classified.where(F.size("reasons") > 0)


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The checked columns cast to int, double and date; others unchanged."""
    return df.withColumns({name: CASTS[kind](F.col(name)) for name, kind in kinds.items()})
