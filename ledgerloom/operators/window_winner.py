"""The leading item of each entity over the days before each day, with a window length that depends on the entity.

Rows are first reduced to exact moments per (entity, day, item); only those are spread over the days whose window holds them, so the spreading
works on at most entities * days * items rows, whatever the number of input rows. A window ends the day before its date and dates past the last
row, or without any row of their own, have a result as long as their window holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = 100
#: Rows above which an entity's window is short, and both lengths in days.
BUSY, SHORT, LONG = 10_000, 5, 10


def value_sums(value: Column, units: int = UNITS) -> list[Column]:
    """Aggregates m, s1, s2 (values, exact sum and sum of squares in 1/units) and off, d1, d2: values that are no whole number of units or too large
    for the exact sums, and the sums of all values as doubles, which hold where off is not 0."""
    x = value.cast("double")
    u = F.round(x * units)
    on = (F.abs(u) < 1e13) & (F.abs(x * units - u) <= F.greatest(F.abs(u), F.lit(1.0)) * 1e-12)
    exact = F.when(on, u.cast("bigint")).cast("decimal(19,0)")
    return [
        F.count(x).alias("m"), F.sum(exact).cast("decimal(28,0)").alias("s1"), F.sum((exact * exact).cast("decimal(28,0)")).cast("decimal(38,0)").alias("s2"),
        F.count_if(x.isNotNull() & ~on).alias("off"), F.sum(x).alias("d1"), F.sum(x * x).alias("d2"),
    ]


#: Merges of the sums of value_sums.
SUMS = {"m": "bigint", "s1": "decimal(28,0)", "s2": "decimal(38,0)", "off": "bigint", "d1": "double", "d2": "double"}


def merged_sums(names: dict[str, str] = SUMS) -> list[Column]:
    return [F.sum(c).cast(t).alias(c) for c, t in names.items()]


def moments(df: DataFrame, entity: str, day: str, item: str, value: str, units: int = UNITS) -> DataFrame:
    """(entity, day, item, n, m, s1, s2, off, d1, d2): rows, and value_sums of the value."""
    rows = df.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), F.col(item).alias("_i"), F.col(value).alias("_v"))
    found = rows.groupBy("_e", "_d", "_i").agg(F.count(F.lit(1)).alias("n"), *value_sums(F.col("_v"), units))
    return found.withColumnsRenamed({"_e": entity, "_d": day, "_i": item})


def population_variance(m: Column, s1: Column, s2: Column, units: int = UNITS, off: Column | None = None, d1: Column | None = None, d2: Column | None = None) -> Column:
    """(m*s2 - s1^2) / m^2 with an exact numerator; from the doubles where a value is off the grid of units; null without values, never negative."""
    spread = (m.cast("decimal(10,0)") * s2).cast("decimal(38,0)") - (s1 * s1).cast("decimal(38,0)")
    exact = spread.cast("double") / (m.cast("double") * m.cast("double")) / float(units * units)
    if off is not None:
        exact = F.when(off > 0, d2 / m - F.pow(d1 / m, 2)).otherwise(exact)
    return F.when(m > 0, F.greatest(F.lit(0.0), exact))


def variance_of(prefix: str = "") -> Column:
    """population_variance of the columns that value_sums made."""
    c = {k: F.col(prefix + k) for k in SUMS}
    return population_variance(c["m"], c["s1"], c["s2"], UNITS, c["off"], c["d1"], c["d2"])


def spread_days(daily: DataFrame, day: str, length: Column, into: str = "window_date") -> DataFrame:
    """Each row once for every date whose window of `length` preceding days holds it: day + 1 .. day + length."""
    return daily.withColumn(into, F.explode(F.transform(F.sequence(F.lit(1), length), lambda k: F.date_add(F.col(day), k))))


def window_winner(df: DataFrame, entity: str, day: str, item: str, value: str, busy_above: int = BUSY, short: int = SHORT, long: int = LONG) -> DataFrame:
    """(entity, window_date, item, purchase_count, population_variance): per entity and date the item with most rows in the preceding window; ties go to
    the lesser variance (undefined last), then to the lesser name.

    The window has `short` days for entities with more than `busy_above` rows, else `long`. All rows of an entity count for that, those without day
    or item too; windows hold only rows with both. Rows without entity take no part. A null value counts as a row but not for the variance. Variances
    are exact for values of whole cents; a window that holds finer or larger values than the exact sums take has the variance of its doubles.
    """
    daily = moments(df.where(F.col(entity).isNotNull()), entity, day, item, value)
    whole = Window.partitionBy(entity)
    daily = daily.withColumn("_rows", F.sum("n").over(whole)).where(F.col(day).isNotNull() & F.col(item).isNotNull())
    length = F.when(F.col("_rows") > busy_above, F.lit(short)).otherwise(F.lit(long))
    spread = spread_days(daily, day, length)
    held = spread.groupBy(entity, "window_date", item).agg(F.sum("n").alias("purchase_count"), *merged_sums())
    held = held.withColumn("population_variance", variance_of())
    first = Window.partitionBy(entity, "window_date").orderBy(F.desc("purchase_count"), F.asc_nulls_last("population_variance"), F.asc(item))
    best = held.withColumn("_place", F.row_number().over(first)).where(F.col("_place") == 1)
    return best.select(entity, "window_date", item, "purchase_count", "population_variance")
