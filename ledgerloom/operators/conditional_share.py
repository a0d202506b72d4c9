"""Share of records per group that carry enough long-lived tags and stay below a reference average."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small

#: How the small sides are joined: by Catalyst and AQE from measured sizes; by broadcast where Catalyst's estimate is under the session's bound, else as
#: auto; or by sort-merge.
STRATEGIES = {"auto": lambda d: d, "broadcast": broadcast_if_small, "merge": lambda d: d.hint("merge")}


@dataclass(frozen=True)
class Frames:
    """The relations the result is made of, each lazy."""

    periods: DataFrame
    valid_tags: DataFrame
    averages: DataFrame
    candidates: DataFrame
    tag_counts: DataFrame
    flagged: DataFrame
    result: DataFrame


def tag_periods(df: DataFrame, tags: str, day: str) -> DataFrame:
    """(tag, first_day, last_day, active_days): whole days between first and last dated row of each tag."""
    rows = df.where(F.col(day).isNotNull()).select(F.explode(tags).alias("tag"), F.col(day).alias("_d"))
    seen = rows.groupBy("tag").agg(F.min("_d").alias("first_day"), F.max("_d").alias("last_day"))
    return seen.withColumn("active_days", F.datediff("last_day", "first_day").cast("bigint"))


def conditional_share(
    df: DataFrame, key: str, group: str, region: str, day: str, tags: str, amount: str, averaged: Column, candidate: Column,
    least_days: int = 2, least_tags: int = 3, strategy: str = "auto",
) -> Frames:
    """Per group: candidates, qualifying ones and their percentage.

    Candidates are rows where `candidate` holds, with group and key; one qualifies with at least `least_tags` tags that live `least_days` days or more
    and an amount strictly below the average of its region, taken over rows where `averaged` holds. Missing tags, averages and amounts never
    qualify but stay in the denominator. `key` tells rows apart; tags of rows with an equal key count together.
    """
    side = STRATEGIES[strategy]
    periods = tag_periods(df, tags, day)
    valid = periods.where(F.col("active_days") >= least_days).select("tag")
    averages = df.where(averaged & F.col(amount).isNotNull()).groupBy(region).agg(F.avg(amount).alias("average"))
    rows = df.where(candidate & F.col(group).isNotNull() & F.col(key).isNotNull()).select(key, group, region, tags, amount)
    held = rows.select(key, F.explode(tags).alias("tag")).join(side(valid), "tag")
    counts = held.groupBy(key).agg(F.count("tag").alias("valid_tags"))
    flagged = rows.select(key, group, region, amount).join(side(counts), key, "left")
    flagged = flagged.join(side(averages), region, "left").withColumn("valid_tags", F.coalesce("valid_tags", F.lit(0)))
    qualifies = F.coalesce((F.col("valid_tags") >= least_tags) & (F.col(amount) < F.col("average")), F.lit(False))
    flagged = flagged.withColumn("qualifies", qualifies)
    result = flagged.groupBy(group).agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if("qualifies").alias("qualifying_count"))
    result = result.withColumn("qualifying_percentage", F.col("qualifying_count") * 100.0 / F.col("candidate_count"))
    return Frames(periods, valid, averages, rows, counts, flagged, result)
