"""Doubles as 64-bit integers of the same order, by arithmetic of the JVM alone, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANTISSA = 52
#: Keys above infinity's stand for NaN, which sorts last, as in Spark.
NAN_KEY = (2047 << MANTISSA) + 1


def with_key(df: DataFrame, value: Column, name: str) -> DataFrame:
    """`df` with bigint `name`: key(a) < key(b) where a < b; -0.0 and 0.0 share key 0; NaN is the largest; null stays null. Exact for every double.

    Each step is a projection of its own: Catalyst keeps those apart whose results are used repeatedly, so nothing is computed twice.
    """
    x, a, g, e, h, s = (F.col(f"_{name}_{c}") for c in "xagehs")
    two = F.lit(2.0)
    columns = list(df.columns)

    def step(d: DataFrame, keep: str, out: str, value: Column) -> DataFrame:
        return d.select(*columns, *[f"_{name}_{c}" for c in keep], value.alias(f"_{name}_{out}"))

    d = df.select(*columns, value.cast("double").alias(f"_{name}_x"))
    d = step(d, "x", "a", F.abs(x))
    d = step(d, "xa", "g", F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.when((a > 0) & (a < F.lit(float("inf"))), a))).cast("int"))))
    d = step(d, "xa", "e", F.when((g > -1022) & (a < F.pow(two, g)), g - 1).when((g < 1023) & (a >= F.pow(two, g + 1)), g + 1).otherwise(g))
    # Scaling by powers of two is exact; two steps keep every factor in range.
    d = step(d, "xae", "h", F.floor((F.lit(MANTISSA) - e) / 2).cast("int"))
    finite = F.when(~F.isnan(a) & (a != F.lit(float("inf"))), a)
    d = step(d, "xaeh", "s", (finite * F.pow(two, h) * F.pow(two, F.lit(MANTISSA) - e - h)).cast("bigint"))
    bits = F.when(a >= F.lit(2.2250738585072014e-308), s + F.shiftleft((e + 1022).cast("bigint"), MANTISSA)).otherwise(s)
    bits = F.when(a == 0, F.lit(0)).when(F.isnan(a), F.lit(NAN_KEY)).when(a == F.lit(float("inf")), F.lit(2047 << MANTISSA)).otherwise(bits)
    d = step(d, "x", "s", bits)
    return d.select(*columns, F.when(x < 0, -s).otherwise(s).cast("bigint").alias(name))


def from_key(key: Column) -> Column:
    """The double of a key."""
    b = F.abs(key)
    e = F.shiftright(b, MANTISSA).cast("int")
    m = b.bitwiseAND(F.lit((1 << MANTISSA) - 1))
    two = F.lit(2.0)
    normal = (m + F.lit(1 << MANTISSA)).cast("double")
    shift = e - 1075
    half = F.floor(shift / 2).cast("int")
    value = F.when(e == 0, m.cast("double") * F.pow(two, F.lit(-537)) * F.pow(two, F.lit(-537))).otherwise(normal * F.pow(two, half) * F.pow(two, shift - half))
    value = F.when(b > F.lit(2047 << MANTISSA), F.lit(float("nan"))).when(b == F.lit(2047 << MANTISSA), F.lit(float("inf"))).otherwise(value)
    return F.when(key < 0, -value).otherwise(value)
