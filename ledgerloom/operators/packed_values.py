"""Several values packed in one field: a parsing expression grammar compiled to one JVM pattern.

    Field   <- (Delim / Item)*
    Item    <- Quoted / Plain / Known / Open / Close / Bare
    Quoted  <- '"' ('""' / '\\' . / [^"\\])* '"' &End   /   the same with single quotes
    Plain   <- '"' ('""' / [^"])* '"' &End              (a backslash that escapes nothing)
    Known   <- a listed value that itself holds delimiters, quotes or brackets, &End
    Open    <- '['                                      (at the start of an item: a bracketed list begins, whose items are items of the field)
    Close   <- ']'                                      (at the end of an item)
    Bare    <- (!Delim !CloseAtEnd .)+                  (takes over when a quote is malformed; flagged; brackets inside are part of it)
    End     <- blank* (Delim / ']' / end of field)

Ordered choice and the greedy, non-returning repetition of such a grammar are exactly the atomic groups and possessive quantifiers of
Java's patterns, so the parse runs inside `regexp_extract_all`, in linear time, without Python and without recursion on long fields: lists in lists are
taken apart by their brackets, which are tokens of their own, counted and dropped.
When a quote is not closed properly the quoted alternatives fail as a whole and the parse backtracks to Bare.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, trimmed
from ..session import bounded_rows

#: Fixed characters that separate values; a slash separates only between blanks.
DELIMITERS = ",;|\t\r\n"
#: Listed values that hold delimiters or quotes become alternatives of the pattern; more of them raise.
MAX_KNOWN = 5000
#: A quoted item that holds nothing.
NOTHING = "(?:\"[\\x00-\\x20]*\"|'[\\x00-\\x20]*')"


def _java_literal(s: str) -> str:
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in s)


def grammar(known: list[str] = (), delimiters: str = DELIMITERS) -> str:
    """The pattern of one Item."""
    d = "".join(_java_literal(c) for c in delimiters)
    gap = "[" + "".join(_java_literal(c) for c in BLANKS if c not in delimiters) + "]*+"
    end = rf"(?={gap}(?:[{d}\]]|/(?:[\x00-\x20]|\z)|\z))"
    double = rf'"(?:[^"\\]++|""|\\.)*+"{end}'
    single = rf"'(?:[^'\\]++|''|\\.)*+'{end}"
    plain = rf'"(?:[^"]++|"")*+"{end}'
    listed = [rf"{_java_literal(k)}{end}" for k in sorted(set(known), key=lambda k: (-len(k), k))]
    slash = r"(?<![\x00-\x20]|\A)/|/(?![\x00-\x20]|\z)"
    bare = rf"(?=[^\x00-\x20])(?:[^{d}/\[\]]++|\[[^{d}\[\]]*+\]|\[|\](?!{gap}(?:[{d}\]]|/(?:[\x00-\x20]|\z)|\z))|{slash})++"
    return "(?s)(?>" + "|".join([double, single, plain, *listed, r"\[", rf"\]{end}", bare]) + ")"


def needs_alternative(value: str, delimiters: str = DELIMITERS) -> bool:
    return any(c in value for c in delimiters + "\"'[]") or " / " in value


def field_tokens(field: Column, known: list[str] = (), delimiters: str = DELIMITERS) -> Column:
    """array<string> of a field's items as written and its brackets; null and blank fields give an empty array."""
    return F.regexp_extract_all(trimmed(F.coalesce(field, F.lit(""))), F.lit(grammar(known, delimiters)), F.lit(0))


def item_tokens(field: Column, tokens: Column) -> Column:
    """The tokens without brackets and without items that hold nothing."""
    # Only quotes can hold nothing; most fields have no such pair and no bracket and skip the filters.
    whole = F.when(field.rlike(r"[\[\]]"), F.filter(tokens, lambda t: ~t.isin("[", "]"))).otherwise(tokens)
    return F.when(field.rlike(NOTHING), F.filter(whole, lambda t: ~t.rlike(rf"^{NOTHING}[\x00-\x20]*$"))).otherwise(whole)


def bracket_error(field: Column, tokens: Column) -> Column:
    """`unclosed_bracket` or `unopened_bracket` where a field's brackets do not pair, else null."""
    count = lambda b: F.size(F.filter(tokens, lambda t: t == b))
    off = F.when(count("[") > count("]"), "unclosed_bracket").when(count("[") < count("]"), "unopened_bracket")
    return F.when(field.rlike(r"[\[\]]"), off)


SOUND_DOUBLE = r'(?s)^(?:"(?:[^"\\]++|""|\\.)*+"|"(?:[^"]++|"")*+")$'
SOUND_SINGLE = r"(?s)^'(?:[^'\\]++|''|\\.)*+'$"
#: A sound quoted text with more text behind it.
GOES_ON = r"""(?s)^(?:"(?:[^"\\]++|""|\\.)*+"[^"]|'(?:[^'\\]++|''|\\.)*+'[^'])"""


def item_value(token: Column) -> tuple[Column, Column]:
    """(value, error) of a token: quotes taken off and decoded; error is null, `text_after_quote` or `unclosed_quote`."""
    t = F.btrim(token, F.lit(BLANKS))
    body = F.substring(t, F.lit(2), F.length(t) - 2)
    starts = t.startswith('"') | t.startswith("'")
    double, single = t.startswith('"') & t.rlike(SOUND_DOUBLE), t.startswith("'") & t.rlike(SOUND_SINGLE)
    odd = (F.length(t) - F.length(F.replace(t, F.lit('"'), F.lit("")))) % 2 == 1
    goes_on = starts & ~double & ~single & t.rlike(GOES_ON)
    broken = ~double & ~single & ~goes_on & (starts | odd)
    decoded = (
        F.when(double, F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r"(?s)\\(.)", "$1"))
        .when(single, F.regexp_replace(F.replace(body, F.lit("''"), F.lit("'")), r"(?s)\\(.)", "$1"))
        .when(broken, F.regexp_replace(t, "^[\"']|[\"']$", ""))
        .otherwise(t)
    )
    return F.btrim(decoded, F.lit(BLANKS)), F.when(goes_on, F.lit("text_after_quote")).when(broken, F.lit("unclosed_quote"))


def parse_packed(field: Column, known: list[str] = (), delimiters: str = DELIMITERS) -> Column:
    """array<struct<pos int, value string, error string>> of the non-blank values of a field; null and blank give an empty array.

    error: null, `unclosed_quote` (a leading or an odd quote that has no sound partner; the raw text without it is the value), `text_after_quote` (the raw
    text is the value), or `unclosed_bracket` / `unopened_bracket` on every other value of a field whose brackets do not pair.
    """
    tokens = field_tokens(field, known, delimiters)
    off = bracket_error(field, tokens)

    def item(t: Column, i: Column) -> Column:
        value, error = item_value(t)
        return F.struct((i + 1).alias("pos"), value.alias("value"), F.coalesce(error, off).alias("error"))

    return F.transform(item_tokens(field, tokens), item)


def folded(c: Column) -> Column:
    """Spelling key: lower case, blank runs as one space."""
    return F.lower(F.regexp_replace(F.btrim(c, F.lit(BLANKS)), r"[\x00-\x20]+", " "))


def unpack(df: DataFrame, field: str, keys: list[str], listed: DataFrame | None = None, listed_column: str | None = None, delimiters: str = DELIMITERS) -> DataFrame:
    """One row (keys..., pos, value, error, is_listed) per value of `field`.

    listed: an optional reference list; its spelling replaces a value that differs only in case or blanks. It joins by value (Catalyst
    broadcasts it under its own threshold and shuffles otherwise); only its entries holding delimiters or quotes go into the grammar.
    Blank fields and null fields give no row; an empty table gives an empty table; repeated values keep their own positions. Columns of
    `df` other than keys and the field are not read, so names cannot clash.
    """
    known: list[str] = []
    if listed is not None:
        c = F.col(listed_column)
        awkward = listed.where(c.rlike(f"[{''.join(re.escape(d) for d in delimiters)}\"'\\[\\]]| / ")).select(c.alias("v")).distinct()
        known = [r["v"] for r in bounded_rows(awkward, MAX_KNOWN)]
    base = df.where(~F.coalesce(trimmed(field) == "", F.lit(True)))
    # Items are decoded after they are exploded, in generated code, rather than inside an interpreted array function.
    parsed = base.select(*keys, F.col(field).alias("_field"), field_tokens(F.col(field), known, delimiters).alias("_tokens"))
    # Once a field, before its items are exploded: afterwards either would be worked out or copied once an item.
    fields = parsed.select(*keys, bracket_error(F.col("_field"), F.col("_tokens")).alias("_off"), item_tokens(F.col("_field"), F.col("_tokens")).alias("_items"))
    items = fields.select(*keys, "_off", F.posexplode("_items").alias("_i", "_token"))
    value, error = item_value(F.col("_token"))
    error = F.coalesce(error, F.col("_off"))
    rows = items.select(*keys, (F.col("_i") + 1).alias("pos"), value.alias("value"), error.alias("error"))
    if listed is None:
        return rows.withColumn("is_listed", F.lit(None).cast("boolean"))
    entry = listed.select(folded(F.col(listed_column)).alias("_key"), F.col(listed_column).alias("_listed")).groupBy("_key").agg(F.min("_listed").alias("_listed"))
    joined = rows.withColumn("_key", folded(F.col("value"))).join(entry, "_key", "left")
    return joined.select(*keys, "pos", F.coalesce("_listed", "value").alias("value"), "error", F.col("_listed").isNotNull().alias("is_listed"))
