"""Column -> Column normalisers and strict parsers. All of them are built-in expressions and keep codegen whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to U+0020 count as blank at both ends of a value.
BLANKS = "".join(map(chr, range(33)))

INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
DATE = r"^[0-9]{2}-[0-9]{2}-[0-9]{2}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(BLANKS))


def text(c: Column | str) -> Column:
    """Trimmed text; blank gives null."""
    return F.nullif(trimmed(c), F.lit(""))


def upper_text(c: Column | str) -> Column:
    return F.upper(text(c))


def is_blank(c: Column | str) -> Column:
    """True for null, empty and all-blank values; never null."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def parse_date(c: Column | str, pattern: str = "MM-dd-yy", shape: str = DATE) -> Column:
    """Real days in exactly this shape; anything else gives null."""
    t = text(c)
    return F.when(t.rlike(shape), F.try_to_date(t, pattern))


def parse_long(c: Column | str) -> Column:
    t = text(c)
    return F.when(t.rlike(INTEGER), t.try_cast("bigint"))


def parse_int(c: Column | str) -> Column:
    t = text(c)
    return F.when(t.rlike(INTEGER), t.try_cast("int"))


def parse_double(c: Column | str) -> Column:
    """Plain decimals only: no exponent, NaN or infinity."""
    t = text(c)
    return F.when(t.rlike(DECIMAL), t.try_cast("double"))


def parse_units(c: Column | str, scale: int = 4) -> Column:
    """A plain decimal as an exact count of 10**-scale units (bigint); null for a number that is no whole count of units or none that fits: nothing is
    rounded. parse_double has those numbers."""
    t = text(c)
    whole = rf"^[+-]?(?:[0-9]+(?:\.[0-9]{{0,{scale}}}0*)?|\.[0-9]{{1,{scale}}}0*)$"
    exact = F.when(t.rlike(whole), t.try_cast(f"decimal({18 + scale},{scale})"))
    return (exact * F.lit(10**scale)).try_cast("bigint")


#: Type of exact amounts: 20 digits before the point and 8 after it. Sums of up to 10**10 of the largest still fit.
EXACT = "decimal(28,8)"


def parse_exact(c: Column | str) -> Column:
    """A plain decimal as an exact number that can be summed and taken back; decimals beyond the eighth are rounded, and a number of more than 20 digits
    before the point gives null."""
    t = text(c)
    return F.when(t.rlike(DECIMAL), t.try_cast(EXACT))


def parse_boolean(c: Column | str) -> Column:
    t = F.lower(text(c))
    return F.when(t == "true", True).when(t == "false", False)


def postal_code(c: Column | str) -> Column:
    """Drops one terminal `.0`."""
    return F.regexp_replace(text(c), r"\.0$", "")


def month_of(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM")


def lookup(c: Column, entries: dict) -> Column:
    """Value of a small fixed dictionary; a missing or null key gives null."""
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    return F.try_element_at(table, c)


def written_form(c: Column | str) -> Column:
    """The shape of a value: a run of digits becomes one 9, each upper-case letter A, each lower-case letter a."""
    shape = F.regexp_replace(trimmed(c), r"[0-9]+", "9")
    return F.regexp_replace(F.regexp_replace(shape, r"\p{Lu}", "A"), r"\p{Ll}", "a")


def list_items(c: Column | str, separator: str = ",") -> Column:
    """Trimmed, non-blank parts of a delimited field in order; null and blank give an empty array."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separator, -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(parts, lambda x: x != "")


def fixed_decimals(c: Column | str, digits: int) -> Column:
    """Text with fixed decimals; null stays null."""
    c = col(c)
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c))
