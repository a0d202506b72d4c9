"""Rolling totals over trailing periods from segment trees kept as rows.

One tree per entity and time shard of 64 days: node (level, idx) holds sum and count of the days [idx*2^level, (idx+1)*2^level) of its
shard. A trailing window is the union of a few canonical nodes, so each node knows beforehand which end days it answers; a fixed table of
a few hundred rows (window, level, idx) -> end day is joined by hash and the answers are summed. Nodes without activity do not exist.
A late correction changes the node of its day and that node's ancestors only: `apply_corrections` adds 7 delta rows per corrected day.

Sums are exact decimals, so trees of different loads add up and corrections can take amounts back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EXACT
from ..session import cut

LEVELS = 7
SHARD_DAYS = 1 << (LEVELS - 1)
#: Type of sums of amounts.
SUM = "decimal(38,8)"


def canonical_nodes(lo: int, hi: int) -> list[tuple[int, int]]:
    """The fewest tree nodes (level, idx) that cover the days lo..hi of one shard."""
    nodes, level = [], 0
    hi += 1
    while lo < hi:
        if lo & 1:
            nodes.append((level, lo))
            lo += 1
        if hi & 1:
            hi -= 1
            nodes.append((level, hi))
        lo, hi, level = lo >> 1, hi >> 1, level + 1
    return nodes


def query_plan(windows: Sequence[int]) -> list[tuple[int, int, int, int]]:
    """(window, level, idx, ahead): node (level, idx) of shard s belongs to the window that ends on day s*64 + ahead. Bounded by the
    windows alone: about 64 * 2 * log2(64) rows per window and shard spanned."""
    plan = []
    for w in windows:
        if w < 1:
            raise ValueError("a window covers at least one day")
        for end in range(SHARD_DAYS):
            left, back = end - w + 1, 0
            while True:
                base = -back * SHARD_DAYS
                lo, hi = max(left, base), min(end, base + SHARD_DAYS - 1)
                plan += [(w, level, idx, end + back * SHARD_DAYS) for level, idx in canonical_nodes(lo - base, hi - base)]
                if left >= base:
                    break
                back += 1
    return plan


def daily(df: DataFrame, entity: Sequence[str], day: Column, amount: Column) -> DataFrame:
    """(entity..., day int, s, n): rows of one entity and day summed before any further step, which also takes apart hot entities."""
    rows = df.select(*entity, F.unix_date(day).alias("day"), amount.cast(EXACT).alias("u")).where(F.col("day").isNotNull())
    return rows.groupBy(*entity, "day").agg(F.coalesce(F.sum("u"), F.lit(0)).cast(SUM).alias("s"), F.count("u").alias("n"))


def tree_nodes(days: DataFrame, entity: Sequence[str]) -> DataFrame:
    """(entity..., shard, level, idx, s, n) of the days' nodes and all their ancestors."""
    day = F.col("day")
    shard = F.floor(day / SHARD_DAYS).cast("int")
    at = days.select(*entity, shard.alias("shard"), (day - shard * SHARD_DAYS).alias("_i"), "s", "n")
    up = at.select(*entity, "shard", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"), "_i", "s", "n")
    node = up.select(*entity, "shard", "level", F.expr("shiftright(_i, level)").alias("idx"), "s", "n")
    return node.groupBy(*entity, "shard", "level", "idx").agg(F.sum("s").cast(SUM).alias("s"), F.sum("n").alias("n"))


def apply_corrections(nodes: DataFrame, corrections: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Add the corrections' (entity..., day, s, n) deltas to a stored tree: only the ancestors of corrected days get a delta row."""
    both = nodes.unionByName(tree_nodes(corrections, entity))
    return both.groupBy(*entity, "shard", "level", "idx").agg(F.sum("s").cast(SUM).alias("s"), F.sum("n").alias("n"))


def window_totals(nodes: DataFrame, entity: Sequence[str], first: int, last: int, windows: Sequence[int]) -> DataFrame:
    """(entity..., day int, s_<w>, n_<w> ...) for every entity of the tree and every day first..last (days since 1970)."""
    spark = nodes.sparkSession
    plan = query_plan(windows)
    rows = ", ".join(f"({w},{level},{idx},{ahead})" for w, level, idx, ahead in plan)
    # A constant table whose size depends on the windows alone.
    table = F.broadcast(spark.sql(f"SELECT * FROM VALUES {rows} AS t(w, level, idx, ahead)"))
    parts = nodes.join(table, ["level", "idx"]).select(*entity, (F.col("shard") * SHARD_DAYS + F.col("ahead")).alias("day"), "w", "s", "n")
    parts = parts.where(F.col("day").between(first, last))
    grid = nodes.where(F.col("level") == LEVELS - 1).select(*entity).distinct()
    grid = grid.select(*entity, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"), F.lit(0).alias("w"), F.lit(0).cast(SUM).alias("s"), F.lit(0).cast("bigint").alias("n"))
    pick = lambda c, w: F.sum(F.when(F.col("w") == w, F.col(c)).otherwise(F.lit(0).cast({"s": SUM, "n": "bigint"}[c])))
    return parts.unionByName(grid).groupBy(*entity, "day").agg(*[x for w in windows for x in (pick("s", w).alias(f"s_{w}"), pick("n", w).alias(f"n_{w}"))])


def rolling_totals(df: DataFrame, entity: Sequence[str], day: Column, amount: Column, windows: Sequence[int] = (7, 30), shown: Column | None = None) -> DataFrame:
    """(entity..., day date, total_<w> double, n_<w> bigint, average_<w> double) per entity and day between the first and last day of `df`.

    Every entity with a dated row gets every day, days without activity included: total 0.0, count 0, average null. Rows without a day are left
    out; null amounts count for the entity's presence but not for totals, counts and averages. Null entity parts form their own entity.
    Repeated rows count each time. An empty table gives an empty table. `shown` is a condition on the entity: the days are those of the whole table
    all the same.
    """
    return answers(cut(tree_nodes(daily(df, entity, day, amount), entity)), entity, windows, shown)


def answers(nodes: DataFrame, entity: Sequence[str], windows: Sequence[int] = (7, 30), shown: Column | None = None) -> DataFrame:
    """The totals of a stored tree for its entities, or those `shown`, and every day between the tree's first and last."""
    day = F.col("shard") * SHARD_DAYS + F.col("idx")
    bounds = nodes.where(F.col("level") == 0).agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    lo, hi = (bounds["lo"], bounds["hi"]) if bounds["lo"] is not None else (0, 0)
    return present(window_totals(nodes if shown is None else nodes.where(shown), entity, lo, hi, windows), entity, windows)


def present(totals: DataFrame, entity: Sequence[str], windows: Sequence[int]) -> DataFrame:
    out = []
    for w in windows:
        s, n = F.col(f"s_{w}").cast("double"), F.col(f"n_{w}")
        out += [s.alias(f"total_{w}"), n.alias(f"n_{w}"), F.when(n > 0, s / n).alias(f"average_{w}")]
    return totals.select(*entity, F.date_from_unix_date("day").alias("day"), *out)
