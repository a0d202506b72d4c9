"""Percentiles of very large numeric columns by radix selection over mergeable digit histograms.

Values become order-preserving 64-bit integers. A partial result of a shard or day is a histogram of their first PARTIAL_BITS bits, with the least and
largest value of each bin: partials of any split of the rows add up, and already bound every percentile, as all rows of a bin lie between these two. Exact
values follow by radix selection: histogram successive digits, and follow only the digit that holds each target rank. The first digits are read from the
partials; the rest from the rows, of which a pass takes those whose leading bits are a digit still open. A digit of one value only is settled at once.

At most targets * groups digits survive a pass, whatever the number of rows; each pass adds counts up before its shuffle. A hot group is spread over its
digits, of which a task sees at most 2**20; ties collapse into counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .order_bits import from_key, with_key

#: Bits of a stored partial: sign, 11 of exponent and 12 of mantissa, hence a relative bin width of 2**-12 at most.
PARTIAL_BITS = 24
#: Bits of the passes over partials, which make up PARTIAL_BITS, and of those over rows, which make up the other 40.
PARTIAL_DIGITS, ROW_DIGITS = (20, 4), (14, 13, 13)
LEVEL = "_level"
#: Counted open digits up to which a pass broadcasts them; more are joined by shuffle. It changes the plan, not the result.
BROADCAST_ROWS = 50_000


def keyed(df: DataFrame, value: str, columns: Sequence[str]) -> DataFrame:
    """(columns..., bin bigint): whole keys of the values that are not null; NaN is the largest."""
    rows = df.select(*columns, F.col(value).alias("_value")).where(F.col("_value").isNotNull())
    return with_key(rows, F.col("_value"), "bin").drop("_value")


def partials(df: DataFrame, value: str, groups: Sequence[str], parts: Sequence[str] = ()) -> DataFrame:
    """(parts..., groups..., bin, n, lo, hi bigint): mergeable histograms of PARTIAL_BITS bits per part and group, with the ends of each bin's values as keys.
    Null values are not counted; repeated rows count each time; a partial has at most 2**PARTIAL_BITS bins, however many rows."""
    rows = keyed(df, value, [*parts, *groups]).withColumn("_key", F.col("bin"))
    cutoff = rows.withColumn("bin", F.shiftright("_key", 64 - PARTIAL_BITS))
    return cutoff.groupBy(*parts, *groups, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("lo"), F.max("_key").alias("hi"))


SUMS = (lambda: F.sum("n").alias("n"), lambda: F.min("lo").alias("lo"), lambda: F.max("hi").alias("hi"))


def merge(histograms: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Partials of any split of the rows, added up."""
    return histograms.groupBy(*groups, "bin").agg(*[s() for s in SUMS])


def spread(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Each row once per grouping set, told apart by `_level` (the set's names); columns outside the set are null. Counts add up wherever they are added up
    later, so nothing is merged here."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    level = [F.struct(F.lit(",".join(s)).alias(LEVEL), *[(F.col(c) if c in s else F.lit(None).cast(df.schema[c].dataType)).alias(c) for c in columns]) for s in sets]
    rest = [c for c in ("bin", "n", "lo", "hi") if c in df.columns]
    return df.select(F.explode(F.array(*level)).alias("_g"), *rest).select("_g.*", *rest)


def _targets(percentiles: Sequence[float]) -> Column:
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n_values"))).cast("bigint")
    return F.array(*[F.struct(F.lit(float(p)).alias("p"), rank(p).alias("rank")) for p in percentiles])


def _follow(counts: DataFrame, groups: Sequence[str], within: Sequence[str]) -> DataFrame:
    """counts: (groups..., n_values, within..., targets, digit, n, lo, hi) -> one row per digit that holds targets, their ranks made relative to it.
    A window holds one digit's bins of one group, at most 2**bits of that digit, whatever the number of rows."""
    w = Window.partitionBy(*groups, *within).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.sum("n").over(w))
    before = F.col("_upto") - F.col("n")
    inside = F.filter("targets", lambda t: (t["rank"] <= F.col("_upto")) & (t["rank"] > before))
    kept = upto.withColumn("targets", F.transform(inside, lambda t: F.struct(t["p"].alias("p"), (t["rank"] - before).alias("rank"))))
    return kept.where(F.size("targets") > 0).select(*groups, "n_values", F.col("digit").alias("prefix"), "targets", "lo", "hi")


def _first(histogram: DataFrame, groups: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    digit = F.shiftright("bin", PARTIAL_BITS - PARTIAL_DIGITS[0]).alias("digit")
    first = histogram.groupBy(*groups, digit).agg(*[s() for s in SUMS])
    return _follow(first.withColumn("n_values", F.sum("n").over(Window.partitionBy(*groups))).withColumn("targets", _targets(percentiles)), groups, [])


def _next(source: DataFrame, bits: int, done: int, width: int, open_: DataFrame, many: int, groups: Sequence[str]) -> DataFrame:
    """One pass: the following `width` bits of the rows of `source` (keys of `bits` bits) whose first `done` bits are an open digit."""
    data = source.select(*[F.col(g).alias(f"_{g}") for g in groups], F.shiftright("bin", bits - done).alias("_prefix"), F.shiftright("bin", bits - done - width).alias("digit"), "n", "lo", "hi")
    open_ = open_.drop("lo", "hi")
    on = F.col("_prefix") == F.col("prefix")
    for g in groups:
        on = on & F.col(f"_{g}").eqNullSafe(F.col(g))
    # At most one open digit per target and group.
    met = data.join(F.broadcast(open_) if many <= BROADCAST_ROWS else open_, on)
    return _follow(met.groupBy(*groups, "n_values", "prefix", "targets", "digit").agg(*[s() for s in SUMS]), groups, ["prefix"])


def _passes(histogram: DataFrame, rows: DataFrame | None, sets: Sequence[Sequence[str]] | None, groups: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """(groups..., n_values, targets, lo, hi) of the digits that hold the targets after all passes over the histogram and, where given, over the rows."""
    kept = cut(_first(histogram, groups, percentiles))
    done, out = PARTIAL_DIGITS[0], []
    plan = [(PARTIAL_BITS, w) for w in PARTIAL_DIGITS[1:]] + [(64, w) for w in ROW_DIGITS if rows is not None]
    for bits, width in plan:
        out.append(kept.where(F.col("lo") == F.col("hi")))
        open_ = kept.where(F.col("lo") < F.col("hi"))
        many = open_.count()
        if not many:
            kept = None
            break
        source = histogram
        if bits == 64:
            # Rows outside all open digits, whatever their group, leave before they are spread over the grouping sets.
            leading = open_.select(F.col("prefix").alias("_leading")).distinct()
            near = rows.join(leading, F.shiftright("bin", 64 - done) == F.col("_leading"), "left_semi")
            near = spread(near, sets) if sets else near
            source = near.select(*groups, "bin", F.lit(1).cast("bigint").alias("n"), F.col("bin").alias("lo"), F.col("bin").alias("hi"))
        kept = cut(_next(source, bits, done, width, open_, many, groups))
        done += width
    if kept is not None:
        out.append(kept)
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found.select(*groups, F.explode("targets").alias("_t"), "n_values", "lo", "hi").select(*groups, "_t.p", "n_values", "lo", "hi")


def select_ranks(histogram: DataFrame, rows: DataFrame, groups: Sequence[str], percentiles: Sequence[float], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(groups..., p, n_values, value): the value of rank ceil(p * n), at least 1, of each group; exact.

    `histogram` has the partials (groups..., bin, n, lo, hi), merged or not, best stored, as two passes read it; `rows` the same values as (groups..., bin)
    with whole keys, of which only digits that hold several values are read again. With `sets` the histogram is spread over them and the rows are not yet. Groups without values have no row; null group parts form their own
    group; ties and repeated rows count each time; an empty histogram gives no row.
    """
    found = _passes(histogram, rows, sets, groups, percentiles)
    return found.select(*groups, "p", "n_values", from_key(F.col("lo")).alias("value"))


def bounded(histogram: DataFrame, groups: Sequence[str], percentiles: Sequence[float]) -> DataFrame:
    """(groups..., p, n_values, low, high, estimate, error_bound) from partials alone: the true value lies in [low, high], the ends of the values in its bin,
    so |estimate - value| <= error_bound, about (high - low) / 2 and at most 2**-12 of the value."""
    found = _passes(histogram, None, None, groups, percentiles)
    edges = found.select(*groups, "p", "n_values", from_key(F.col("lo")).alias("low"), from_key(F.col("hi")).alias("high"))
    edges = edges.withColumn("estimate", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") / 2 + F.col("high") / 2))
    return edges.withColumn("error_bound", F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.greatest(F.col("estimate") - F.col("low"), F.col("high") - F.col("estimate"))))
