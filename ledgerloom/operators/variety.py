"""Median number of distinct items per family, by region and month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPES = ("global", "local")


def ranked_families(df: DataFrame, family: str, rank: str, least: int) -> DataFrame:
    """Families with at least one row of rank `least` or more; nothing else about the row matters."""
    return df.where((F.col(rank) >= least) & F.col(family).isNotNull()).select(family).distinct()


def family_variety(df: DataFrame, region: str, month: str, family: str, item: str, rank: str) -> DataFrame:
    """(region, month, family, variety, top_rank): exact distinct items, pre-aggregated per item before they are counted; no rank is 0."""
    rows = df.select(region, month, family, item, F.coalesce(F.col(rank), F.lit(0)).alias("_rank"))
    whole = rows.where(F.col(region).isNotNull() & F.col(month).isNotNull() & F.col(family).isNotNull() & F.col(item).isNotNull())
    items = whole.groupBy(region, month, family, item).agg(F.max("_rank").alias("_rank"))
    return items.groupBy(region, month, family).agg(F.count(F.lit(1)).alias("variety"), F.max("_rank").alias("top_rank"))


def median_variety(df: DataFrame, region: str, month: str, family: str, item: str, rank: str, least: int = 6, scope: str = "global", universe: DataFrame | None = None) -> DataFrame:
    """(region, month, median_variety, eligible_style_count, eligibility_scope).

    global: families that reach rank `least` anywhere in `universe` (default: all rows of df, of whatever region); local: in the same region and month.
    Odd groups give the middle, even ones the mean of the two middle values. Groups without an eligible family have no row.
    """
    if (scope := scope.lower()) not in SCOPES:
        raise ValueError(f"scope is one of {SCOPES}")
    if scope == "global":
        # The distinct families are broadcast only where AQE measures them to be small.
        df = df.join(ranked_families(df if universe is None else universe, family, rank, least), family, "left_semi")
    found = family_variety(df, region, month, family, item, rank)
    if scope == "local":
        found = found.where(F.col("top_rank") >= least)
    out = found.groupBy(region, month).agg(F.median("variety").alias("median_variety"), F.count(F.lit(1)).alias("eligible_style_count"))
    return out.withColumn("eligibility_scope", F.lit(scope))
