"""Dynamic percentile thresholds per group, approximate and exact, with statistics of the rows that reach them.

Exact results come from one pass: rows are reduced to moments per (group, value), which give the percentiles by frequency and the statistics of
the rows from the threshold up without joining a row to its threshold. `statistics` keeps the join form for thresholds from elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .window_winner import SUMS, merged_sums, value_sums, variance_of

ACCURACY = 10_000
PERCENTILES = (0.8, 0.9)
EXACT, APPROX = "exact_type7", "approx"
RESULT = ("method", "percentile", "threshold", "total_order_count", "qualifying_order_count", "qualifying_amount_count", "amount_stddev_pop")


def observations(df: DataFrame, key: str, group: Sequence[str], value: str, amount: str) -> DataFrame:
    """(group..., value, amount) of rows with key and all group parts."""
    whole = F.col(key).isNotNull()
    for g in group:
        whole = whole & F.col(g).isNotNull()
    return df.where(whole).select(*group, F.col(value).cast("int").alias("value"), F.col(amount).alias("amount"))


def _long(grouped: DataFrame, group: Sequence[str], method: str, percentiles: Sequence[float]) -> DataFrame:
    """Wide to long in one pass: one row per percentile."""
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, percentiles)).alias("percentile"), F.col("t").alias("threshold"))).alias("_p")
    return grouped.select(*group, pairs, "total_order_count").select(*group, F.lit(method).alias("method"), F.col("_p.percentile"), F.col("_p.threshold").cast("double").alias("threshold"), "total_order_count")


def approximate(obs: DataFrame, group: Sequence[str], percentiles: Sequence[float] = PERCENTILES, accuracy: int = ACCURACY) -> DataFrame:
    """(group..., method, percentile, threshold, total_order_count) by Spark's mergeable quantile summary."""
    grouped = obs.groupBy(*group).agg(F.percentile_approx("value", list(percentiles), accuracy).alias("t"), F.count(F.lit(1)).alias("total_order_count"))
    return _long(grouped, group, APPROX, percentiles)


def exact(obs: DataFrame, group: Sequence[str], percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """The same, exact with linear interpolation between neighbours (type 7), from value frequencies."""
    counts = obs.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    grouped = counts.groupBy(*group).agg(F.percentile("value", F.array(*map(F.lit, percentiles)), F.col("n")).alias("t"), F.sum("n").alias("total_order_count"))
    return _long(grouped, group, EXACT, percentiles)


def exact_by_array(obs: DataFrame, group: Sequence[str], percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """The type-7 formula on sorted arrays; a second implementation to hold `exact` against. An array has one entry (value, rows up to it) per distinct
    value of a group, however many rows hold it."""
    counts = obs.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    grouped = counts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("x"), F.sum("n").alias("total_order_count"))
    # Running sums, as one fold over the sorted values.
    none = F.array().cast("array<struct<value:int,upto:bigint>>")
    before = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["upto"], F.lit(0).cast("bigint"))
    upto = F.aggregate("x", none, lambda a, v: F.concat(a, F.array(F.struct(v["value"].alias("value"), (before(a) + v["n"]).alias("upto")))))
    each = grouped.withColumn("x", upto).withColumn("percentile", F.explode(F.array(*map(F.lit, percentiles))))
    h = (F.col("total_order_count") - 1) * F.col("percentile")
    at = lambda k: F.get(F.filter("x", lambda v: v["upto"] > k), F.lit(0))["value"].cast("double")
    lo, hi = at(F.floor(h)), at(F.ceil(h))
    return each.select(*group, F.lit(EXACT).alias("method"), "percentile", (lo + (h - F.floor(h)) * (hi - lo)).alias("threshold"), "total_order_count")


def value_moments(obs: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., value, n, m, s1, s2, off, d1, d2): rows, and the sums of the amounts (window_winner.value_sums)."""
    return obs.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"), *value_sums(F.col("amount")))


def _qualifying(met: DataFrame, group: Sequence[str]) -> DataFrame:
    out = met.groupBy(*group, "method", "percentile", "threshold", "total_order_count").agg(F.sum("n").alias("qualifying_order_count"), *merged_sums())
    sd = F.sqrt(variance_of())
    out = out.withColumn("qualifying_amount_count", F.col("m"))
    return out.withColumn("amount_stddev_pop", F.when(F.col("qualifying_amount_count") < 2, 0.0).otherwise(F.coalesce(sd, F.lit(0.0)))).select(*group, *RESULT)


def statistics(obs: DataFrame, thresholds: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., RESULT): rows of the group whose value reaches the threshold, their amounts and the population deviation of these (0.0 below two).

    Rows are reduced to moments per (group, value) before the join, so the fan-out per percentile multiplies those only.
    """
    met = value_moments(obs, group).join(thresholds, list(group)).where(F.col("value").cast("double") >= F.col("threshold"))
    return _qualifying(met, group)


def approximate_result(obs: DataFrame, group: Sequence[str]) -> DataFrame:
    return statistics(obs, approximate(obs, group), group)


def exact_result(obs: DataFrame, group: Sequence[str], percentiles: Sequence[float] = PERCENTILES) -> DataFrame:
    """Exact thresholds and their statistics from one scan: both follow from the moments per (group, value), so there is no join. A window holds the
    distinct values of a group."""
    whole = Window.partitionBy(*group)
    m = value_moments(obs, group)
    t = F.percentile("value", F.array(*map(F.lit, percentiles)), F.col("n")).over(whole)
    each = m.withColumns({"t": t, "total_order_count": F.sum("n").over(whole), "method": F.lit(EXACT)})
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, percentiles)).alias("percentile"), F.col("t").alias("threshold"))).alias("_p")
    met = each.select(*group, "value", "n", *SUMS, "method", "total_order_count", pairs).select("*", "_p.percentile", "_p.threshold")
    return _qualifying(met.where(F.col("value").cast("double") >= F.col("threshold")), group)


COMPARED = ("threshold", "qualifying_order_count", "amount_stddev_pop")


def _differences(paired: DataFrame) -> DataFrame:
    """Flags of different threshold (1e-12), membership and deviation (1e-9)."""
    apart = lambda c, e: F.abs(F.col(f"approx_{c}") - F.col(f"exact_{c}")) > e
    flags = {"threshold_differs": apart("threshold", 1e-12), "qualifying_set_differs": F.col("membership_difference_count") > 0, "stddev_differs": apart("amount_stddev_pop", 1e-9)}
    return paired.withColumns(flags)


def comparison(obs: DataFrame, approx: DataFrame, exact: DataFrame, group: Sequence[str]) -> DataFrame:
    """Two given results side by side per (group..., percentile) with their differences; `compare` makes the same from the observations alone."""
    key = [*group, "percentile"]
    named = lambda d, p: d.select(*key, *[F.col(c).alias(f"{p}_{c}") for c in COMPARED])
    paired = named(approx, "approx").join(named(exact, "exact"), key)
    counts = obs.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.col("value").cast("double")
    apart = (v >= F.col("approx_threshold")) != (v >= F.col("exact_threshold"))
    member = counts.join(paired.select(*key, "approx_threshold", "exact_threshold"), list(group)).groupBy(*key).agg(F.sum(F.when(apart, F.col("n")).otherwise(0)).alias("membership_difference_count"))
    return _differences(paired.join(member, key))


def compare(obs: DataFrame, group: Sequence[str], percentiles: Sequence[float] = PERCENTILES, accuracy: int = ACCURACY) -> DataFrame:
    """The comparison of both methods from two scans and one join: the moments per (group, value) give the exact thresholds, and both sides' counts and
    deviations in one aggregation."""
    whole = Window.partitionBy(*group)
    levels = F.array(*map(F.lit, percentiles))
    m = value_moments(obs, group).withColumn("te", F.percentile("value", levels, F.col("n")).over(whole))
    rough = obs.groupBy(*group).agg(F.percentile_approx("value", list(percentiles), accuracy).cast("array<double>").alias("ta"))
    pairs = F.explode(F.arrays_zip(levels.alias("percentile"), F.col("ta"), F.col("te"))).alias("_p")
    each = m.join(rough, list(group)).select(*group, "value", "n", *SUMS, pairs)
    each = each.select("*", F.col("_p.percentile"), F.col("_p.ta").alias("approx_threshold"), F.col("_p.te").alias("exact_threshold")).drop("_p")
    v = F.col("value").cast("double")
    within = {p: v >= F.col(f"{p}_threshold") for p in ("approx", "exact")}
    sums = [F.coalesce(F.sum(F.when(q, F.col(c))), F.lit(0)).cast(t).alias(f"{p}_{c}") for p, q in within.items() for c, t in ({"n": "bigint"} | SUMS).items()]
    apart = F.sum(F.when(within["approx"] != within["exact"], F.col("n")).otherwise(0)).alias("membership_difference_count")
    met = each.groupBy(*group, "percentile", "approx_threshold", "exact_threshold").agg(*sums, apart)

    def deviation(p: str) -> Column:
        sd = F.sqrt(variance_of(f"{p}_"))
        return F.when(F.col(f"{p}_m") < 2, 0.0).otherwise(F.coalesce(sd, F.lit(0.0)))

    columns = [x for p in within for x in (F.col(f"{p}_threshold"), F.col(f"{p}_n").alias(f"{p}_qualifying_order_count"), deviation(p).alias(f"{p}_amount_stddev_pop"))]
    return _differences(met.select(*group, "percentile", *columns, "membership_difference_count"))


def summary(compared: DataFrame) -> DataFrame:
    """Groups and differing groups per percentile."""
    flags = ("threshold_differs", "qualifying_set_differs", "stddev_differs")
    return compared.groupBy("percentile").agg(F.count(F.lit(1)).alias("group_count"), *[F.count_if(f).alias(f"{f}_count") for f in flags])


def strongest(compared: DataFrame, group: Sequence[str], n: int = 1) -> DataFrame:
    """The n groups whose deviations differ most, ties by key."""
    gap = F.abs(F.col("approx_amount_stddev_pop") - F.col("exact_amount_stddev_pop"))
    return compared.withColumn("stddev_gap", gap).orderBy(F.desc("stddev_gap"), *group, "percentile").limit(n)


def checksum(result: DataFrame) -> DataFrame:
    """One row that depends on every column of every row; forces a full evaluation in benchmarks."""
    numeric = [f.name for f in result.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
    return result.agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(c).alias(f"sum_{c}") for c in numeric], F.bit_xor(F.xxhash64(*result.columns)).alias("mixed"))


def invalid_rows(result: DataFrame, group: Sequence[str] = ("sku", "month")) -> DataFrame:
    """Rows that break what holds by definition; none is the expected result. A null in a compared column breaks it as well."""
    c = F.col
    holds = [*[c(g).isNotNull() for g in (*group, "method", "threshold", "amount_stddev_pop")]]
    holds += [
        c("total_order_count") >= 1, c("qualifying_order_count") >= c("qualifying_amount_count"), c("qualifying_order_count") <= c("total_order_count"),
        c("amount_stddev_pop") >= 0, (c("qualifying_amount_count") >= 2) | (c("amount_stddev_pop") == 0),
        # Beyond these: known methods and percentiles, a number as threshold, at least one row that reaches it.
        c("method").isin(EXACT, APPROX), c("percentile").isin(*PERCENTILES), ~F.isnan("threshold"), ~F.isnan("amount_stddev_pop"), c("qualifying_order_count") >= 1,
    ]
    whole = holds[0]
    for h in holds[1:]:
        whole = whole & h
    return result.where(~F.coalesce(whole, F.lit(False)))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != 1)
