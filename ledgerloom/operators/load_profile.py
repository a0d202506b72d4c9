"""Column-level quality profile per load, and the loads in which a column changed.

All statistics come from mergeable partial aggregates. Numeric columns keep power sums (counts and sums of the first four powers of scaled
integers, exact in limbs), so profiles of loads or days add up to the profile of their union without rereading rows; shares are the power sums of 0/1
variables. Standardised differences between loads follow from either.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, parse_double, parse_units, trimmed, written_form
from ..session import bounded_rows, cut

#: Loads that one comparison may cover.
MAX_LOADS = 100_000
#: Slack for comparing shares of counts held as doubles.
EPS = 1e-9
#: What a profile has of numeric columns.
NUMBERS = ("valid", "beyond", "min_value", "max_value", "mean", "stddev", "skewness", "shift")


def value_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load_id, column_name, value, n): grouped counts of trimmed values, blank as null. Pre-aggregated before the only shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.nullif(trimmed(c), F.lit("")).alias("value")) for c in columns])).alias("_p")
    return df.select(F.col(load).alias("load_id"), pairs).select("load_id", "_p.*").groupBy("load_id", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, load: str, columns: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """One row per (load_id, column_name): rows, blanks, distinct values, range as text, most common written form and its violations,
    and for `numeric` columns (null for others) valid numbers, their range, mean, deviation, skewness and standardised shift against the other loads.

    Null, empty and all-blank values are blanks; a load of blanks only has null ranges. Values are compared trimmed.
    """
    counts = value_counts(df, load, columns)
    form = F.when(F.col("value").isNotNull(), written_form("value"))
    forms = counts.withColumn("form", form).groupBy("load_id", "column_name", "form").agg(
        F.sum("n").alias("n"), F.count("value").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    best = F.max(F.when(F.col("form").isNotNull(), F.struct("n", "form")))
    texts = forms.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.sum(F.when(F.col("form").isNull(), F.col("n")).otherwise(0)).alias("blank_count"),
        F.sum("d").alias("distinct_count"),
        F.min("lo").alias("min_text"),
        F.max("hi").alias("max_text"),
        F.count("form").alias("form_count"),
        best.alias("_best"),
    )
    texts = texts.select(
        "load_id", "column_name", "row_count", "blank_count", "distinct_count", "min_text", "max_text", "form_count",
        F.col("_best.form").alias("common_form"), (F.col("row_count") - F.col("blank_count") - F.coalesce(F.col("_best.n"), F.lit(0))).alias("off_form_count"),
    )
    if not numeric:
        return texts
    sums = power_sums(df, load, numeric)
    moved = standardised_shift(sums).join(sums.select("load_id", "column_name", F.col("lo").alias("min_value"), F.col("hi").alias("max_value")).withColumnsRenamed({"load_id": "_load", "column_name": "_column"}), F.col("load_id").eqNullSafe(F.col("_load")) & (F.col("column_name") == F.col("_column")))
    moved = moved.select(F.col("_load"), "_column", *NUMBERS)
    return texts.join(moved, F.col("load_id").eqNullSafe(F.col("_load")) & (F.col("column_name") == F.col("_column")), "left").drop("_load", "_column")


#: Numbers are split into three limbs of this base, so that every product of up to four limbs sums exactly over 10**14 rows.
LIMB = 10**6
#: Exponents (i, j, k) of the limbs in the sums of first to fourth powers.
MONOMIALS = [(i, j, k) for i in range(5) for j in range(5) for k in range(5) if 1 <= i + j + k <= 4]


def _named(e: tuple[int, int, int]) -> str:
    return "e" + "".join(map(str, e))


def power_sums(df: DataFrame, load: str, numeric: Sequence[str], scale: int = 4) -> DataFrame:
    """(load_id, column_name, valid, n, e..., b1..b4, lo, hi): sums of the first four powers of the valid numbers, in units of 10**-scale.

    The sums of two profiles add up to those of their union. A number is split into limbs, low to high, of base LIMB; e<ijk> is the exact sum of
    low**i * middle**j * high**k, from which `power` has the sums of powers. They hold the n numbers that are whole counts of units below LIMB**3.
    b1..b4 are sums of powers of the other valid - n numbers, finer or larger, as doubles. lo and hi are the range of all valid numbers.
    """
    def pair(c: str) -> Column:
        return F.struct(F.lit(c).alias("column_name"), parse_units(c, scale).alias("u"), parse_double(c).alias("x"))

    pairs = F.explode(F.array(*[pair(c) for c in numeric])).alias("_p")
    rows = df.select(F.col(load).alias("load_id"), pairs).select("load_id", "_p.*")
    u = F.col("u")
    # Remainders keep the number's sign, so that the limbs add up to it.
    limbs = [F.expr(f"u % {LIMB}L"), F.expr(f"(u div {LIMB}L) % {LIMB}L"), F.expr(f"u div {LIMB * LIMB}L")]
    rows = rows.withColumn("u", F.when((u > -(LIMB**3)) & (u < LIMB**3), u)).select("*", *[x.alias(f"_l{k}") for k, x in enumerate(limbs)])

    def product(e: tuple[int, int, int]) -> Column:
        factors = [F.col(f"_l{k}") for k, times in enumerate(e) for _ in range(times)]
        some = factors[0]
        for x in factors[1:3]:
            some = some * x
        value = some.cast("decimal(19,0)") if len(factors) < 4 else (some.cast("decimal(19,0)") * factors[3].cast("decimal(7,0)")).cast("decimal(26,0)")
        # Most numbers have one limb: the others' sums then skip the row.
        return F.when(F.abs("u") >= LIMB, value) if e[1] or e[2] else value

    sums = [F.coalesce(F.sum(product(e)), F.lit(0)).cast("decimal(38,0)").alias(_named(e)) for e in MONOMIALS]
    beyond = F.when(F.col("u").isNull(), F.col("x") * float(10**scale))
    sums += [F.coalesce(F.sum(F.pow(beyond, F.lit(k))), F.lit(0.0)).alias(f"b{k}") for k in range(1, 5)]
    return rows.groupBy("load_id", "column_name").agg(F.count("x").alias("valid"), F.count("u").alias("n"), *sums, F.min("x").alias("lo"), F.max("x").alias("hi"))


def power(k: int, exact: bool = False) -> Column:
    """The sum of k-th powers, in units, as a double; `exact` leaves out the numbers beyond the exact sums."""
    total = F.lit(0.0) if exact else F.col(f"b{k}")
    for e in MONOMIALS:
        if sum(e) == k:
            times = math.factorial(k) // math.prod(map(math.factorial, e))
            total = total + F.col(_named(e)).cast("double") * float(times * LIMB ** (e[1] + 2 * e[2]))
    return total


def numeric_ranges(df: DataFrame, load: str, numeric: Sequence[str]) -> DataFrame:
    """(load_id, column_name, row_count, blank_count, valid_count, min_value, max_value): the range of the valid numbers as doubles, in numeric order."""
    def pair(c: str) -> Column:
        return F.struct(F.lit(c).alias("column_name"), is_blank(c).alias("blank"), parse_double(c).alias("x"))

    pairs = F.explode(F.array(*[pair(c) for c in numeric])).alias("_p")
    rows = df.select(F.col(load).alias("load_id"), pairs).select("load_id", "_p.*")
    counts = [F.count(F.lit(1)).alias("row_count"), F.count_if("blank").alias("blank_count"), F.count("x").alias("valid_count")]
    return rows.groupBy("load_id", "column_name").agg(*counts, F.min("x").alias("min_value"), F.max("x").alias("max_value"))


def merge_power_sums(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Power sums added up over everything but `keys`."""
    added = [F.sum(_named(e)).cast("decimal(38,0)").alias(_named(e)) for e in MONOMIALS] + [F.sum(f"b{k}").alias(f"b{k}") for k in range(1, 5)]
    return sums.groupBy(*keys).agg(F.sum("valid").alias("valid"), F.sum("n").alias("n"), *added, F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def standardised_shift(sums: DataFrame, scale: int = 4) -> DataFrame:
    """(load_id, column_name, valid, beyond, mean, stddev, skewness, shift) of all valid numbers: shift is the difference of a load's mean from the mean
    of all other loads together, divided by the pooled standard deviation; all of it follows from the sums. Null where there are fewer than two
    values or no spread. beyond: numbers of which the sums are doubles."""
    unit = float(10**scale)
    own = sums.select("load_id", "column_name", "valid", (F.col("valid") - F.col("n")).alias("beyond"), F.col("valid").cast("double").alias("n"), *[power(k).alias(f"s{k}") for k in (1, 2, 3)])
    # The other loads are added up from both sides, not subtracted from the total: next to one load's large powers theirs would be lost in rounding.
    sides = [Window.partitionBy("column_name").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("load_id"), F.desc("load_id"))]
    x = own.withColumns({f"{side}_{k}": F.coalesce(F.sum(k).over(w), F.lit(0.0)) for side, w in zip(("lower", "higher"), sides) for k in ("n", "s1", "s2")})
    of = {k: F.col(k) for k in ("n", "s1", "s2", "s3")}
    rest = {k: F.col(f"lower_{k}") + F.col(f"higher_{k}") for k in ("n", "s1", "s2")}

    def spread(of: dict[str, Column]) -> Column:
        return F.greatest(F.lit(0.0), F.try_divide(of["s2"], of["n"]) - F.pow(F.try_divide(of["s1"], of["n"]), 2))

    mean, other = F.try_divide(of["s1"], of["n"]), F.try_divide(rest["s1"], rest["n"])
    var = spread(of)
    pooled = F.sqrt((var + spread(rest)) / 2)
    third = F.try_divide(of["s3"], of["n"]) - 3 * mean * F.try_divide(of["s2"], of["n"]) + 2 * F.pow(mean, 3)
    shift = F.when((of["n"] >= 2) & (rest["n"] >= 2) & (pooled > 0), (mean - other) / pooled)
    skew = F.when((of["n"] >= 2) & (var > 0), third / F.pow(var, 1.5))
    return x.select("load_id", "column_name", "valid", "beyond", (mean / unit).alias("mean"), (F.sqrt(var) / unit).alias("stddev"), skew.alias("skewness"), shift.alias("shift"))


def _against_median(shares: DataFrame, limit: float) -> DataFrame:
    """shares: (column_name, measure, load_id, share, shift), complete over loads. Cases differ from the measure's median by `limit` or more."""
    # One row per load in a group, so a group is as large as the number of loads.
    w = Window.partitionBy("column_name", "measure")
    return shares.withColumn("median_share", F.percentile("share", 0.5).over(w)).where(F.abs(F.col("share") - F.col("median_share")) >= limit - EPS)


def changed_loads(df: DataFrame, load: str, categories: Sequence[str], identifiers: Sequence[str], sequences: Sequence[str] = (), limit: float = 0.10) -> DataFrame:
    """(load_id, column_name, measure, share, median_share, shift) of every share that leaves the median of its loads by `limit` or more; shift is its
    standardised difference from all other loads together (infinite where neither side has any spread).

    Measures: `blank`; for categories `value=<v>` and `rare` (values absent from most loads); for identifiers `off_form` (not the
    column's most common written form); for sequences, a subset of identifiers, `seen_before` (stood already in a lower load).
    A row with a null load belongs to no load and is left out. Blank values are no values. Ties between forms go to the lesser text.
    """
    rows = df.where(F.col(load).isNotNull())
    # Counts per load and value or form are small and used several times: they are made once, in one scan of their columns each.
    values = cut(value_counts(rows, load, categories)) if categories else None
    forms = cut(_forms(rows, load, identifiers, categories, values)) if identifiers else None
    counted = values if values is not None else forms
    if counted is not None:
        sizes = counted.where(F.col("column_name") == [*categories, *identifiers][0]).groupBy("load_id").agg(F.sum("n").alias("load_rows"))
    else:
        sizes = rows.groupBy(F.col(load).alias("load_id")).agg(F.count(F.lit(1)).alias("load_rows"))
    # One row per load; the list is checked for size before it becomes a literal.
    listed = sorted((r["load_id"], r["load_rows"]) for r in bounded_rows(sizes, MAX_LOADS))
    if not listed:
        nothing = F.lit(None)
        return rows.select(F.col(load).alias("load_id"), *[nothing.cast(t).alias(c) for c, t in (("column_name", "string"), ("measure", "string"), ("share", "double"), ("median_share", "double"), ("shift", "double"))]).where("false")
    loads = F.from_json(F.lit("[" + ",".join(f'{{"load_id":{a},"load_rows":{b}}}' for a, b in listed) + "]"), "array<struct<load_id:bigint,load_rows:bigint>>")
    parts, counted_again = [], [c for c in sequences if c in categories]
    if categories:
        # A share under the limit in every load cannot leave its median by the limit, so only values that reach it in some load are compared.
        sized = values.join(rows.sparkSession.range(1).select(F.inline(loads)), "load_id")
        large = sized.where(F.col("n") >= F.col("load_rows") * (limit - 2 * EPS)).select("column_name", "value").distinct()
        named = values.join(large.where(F.col("value").isNotNull()), ["column_name", "value"]).select("column_name", F.concat(F.lit("value="), F.col("value")).alias("measure"), "load_id", "n")
        missing = values.where(F.col("value").isNull()).select("column_name", F.lit("blank").alias("measure"), "load_id", "n")
        found = values.where(F.col("value").isNotNull())
        by_value = Window.partitionBy("column_name", "value")
        ranged = found.withColumn("absent", F.lit(len(listed)) - F.count(F.lit(1)).over(by_value)).withColumn("first_load", F.min("load_id").over(by_value))
        again = F.col("column_name").isin(counted_again) & (F.col("load_id") > F.col("first_load")) if counted_again else F.lit(False)
        # Both measures of a value's loads come from one shuffle by value.
        marked = ranged.groupBy("column_name", "load_id").agg(F.sum(F.when(F.col("absent") > len(listed) / 2.0, F.col("n"))).alias("rare"), F.sum(F.when(again, F.col("n"))).alias("seen_before"))
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("n")) for m in ("rare", "seen_before")])).alias("_p")
        parts += [named, missing, marked.select("column_name", "load_id", each).select("column_name", "_p.measure", "load_id", "_p.n").where(F.col("n").isNotNull())]
    if identifiers:
        blank = forms.where(F.col("form").isNull()).select("column_name", F.lit("blank").alias("measure"), "load_id", "n")
        found = forms.where(F.col("form").isNotNull())
        total = found.groupBy("column_name", "form").agg(F.sum("n").alias("all_n"))
        common = total.groupBy("column_name").agg(F.min_by("form", F.struct(-F.col("all_n"), F.col("form"))).alias("common"))
        off = found.join(common, "column_name").where(F.col("form") != F.col("common")).groupBy("column_name", "load_id").agg(F.sum("n").alias("n"))
        parts += [blank, off.select("column_name", F.lit("off_form").alias("measure"), "load_id", "n")]
    parts += [seen_before(rows, load, c) for c in sequences if c not in counted_again]
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    # A column that is both category and identifier has its blanks counted by either.
    counts = counts.groupBy("column_name", "measure", "load_id").agg(F.max("n").alias("n"))
    # Every measure gets a share in every load, 0 where it has no rows.
    each = counts.groupBy("column_name", "measure").agg(F.map_from_entries(F.collect_list(F.struct("load_id", "n"))).alias("_by_load"), F.sum("n").alias("_all"))
    full = each.select("column_name", "measure", "_by_load", "_all", F.explode(loads).alias("_l")).select("column_name", "measure", "_by_load", "_all", "_l.*")
    # The counts are the power sums of a 0/1 variable, so its standardised difference from the other loads follows from them.
    all_rows, n = float(sum(b for _, b in listed)), F.coalesce(F.try_element_at("_by_load", F.col("load_id")), F.lit(0)).cast("double")
    share, other = n / F.col("load_rows"), F.try_divide(F.col("_all") - n, F.lit(all_rows) - F.col("load_rows"))
    pooled = F.sqrt((share * (1 - share) + other * (1 - other)) / 2)
    shift = F.when(share == other, 0.0).when(pooled > 0, (share - other) / pooled).otherwise(F.when(share > other, float("inf")).when(share < other, float("-inf")))
    shares = full.select("column_name", "measure", "load_id", share.alias("share"), shift.alias("shift"))
    # Were every load's share within limit / 2 of that of the others together, all shares would lie within limit / 2 of the whole table's and none would
    # leave the median by limit. A difference of limit / 2 is a standardised one of limit or more, as no share's deviation exceeds 1/2: so only
    # measures with such a shift in some load are compared with their median.
    by_measure = Window.partitionBy("column_name", "measure")
    shifted = shares.withColumn("_most", F.max(F.abs("shift")).over(by_measure)).where(F.col("_most") >= limit - 4 * EPS)
    return _against_median(shifted, limit).select("load_id", "column_name", "measure", "share", "median_share", "shift")


def _forms(rows: DataFrame, load: str, identifiers: Sequence[str], categories: Sequence[str], values: DataFrame | None) -> DataFrame:
    """form_counts of the identifiers; those that are categories too take them from their value counts."""
    both = [c for c in identifiers if c in categories]
    alone = [c for c in identifiers if c not in categories]
    parts = [form_counts(rows, load, alone)] if alone else []
    if both:
        form = F.when(F.col("value").isNotNull(), written_form("value")).alias("form")
        parts.append(values.where(F.col("column_name").isin(both)).groupBy("load_id", "column_name", form).agg(F.sum("n").alias("n")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def form_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load_id, column_name, form, n): grouped counts of written forms, blank as null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(~is_blank(c), written_form(c)).alias("form")) for c in columns])).alias("_p")
    return df.select(F.col(load).alias("load_id"), pairs).select("load_id", "_p.*").groupBy("load_id", "column_name", "form").agg(F.count(F.lit(1)).alias("n"))


def seen_before(rows: DataFrame, load: str, column: str) -> DataFrame:
    """(column_name, measure, load_id, n): rows whose non-blank value stands in a lower load too. Exact; a hot value is counted per load
    before the shuffle by value, so no value's group is larger than the number of loads."""
    per = rows.where(~is_blank(column)).groupBy(trimmed(column).alias("v"), F.col(load).alias("load_id")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("v")
    again = per.withColumn("first_load", F.min("load_id").over(first)).where(F.col("load_id") > F.col("first_load"))
    return again.groupBy("load_id").agg(F.sum("n").alias("n")).select(F.lit(column).alias("column_name"), F.lit("seen_before").alias("measure"), "load_id", "n")


def pattern_violations(df: DataFrame, load: str, patterns: dict[str, str]) -> DataFrame:
    """(load_id, column_name, checked, violations) against given Java patterns; blank values are not checked."""
    def pair(c: str, p: str) -> Column:
        return F.struct(F.lit(c).alias("column_name"), (~is_blank(c)).alias("has"), F.coalesce(~trimmed(c).rlike(p), F.lit(False)).alias("bad"))

    pairs = F.explode(F.array(*[pair(c, p) for c, p in patterns.items()])).alias("_p")
    return (
        df.select(F.col(load).alias("load_id"), pairs).select("load_id", "_p.*").groupBy("load_id", "column_name")
        .agg(F.count_if("has").alias("checked"), F.count_if(F.col("has") & F.col("bad")).alias("violations"))
    )
