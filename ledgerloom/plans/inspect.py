"""Physical plan metrics, equivalence of plans, row counters and timing."""

from __future__ import annotations

import re
import statistics
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import cut

TOKENS = {
    "broadcast_hash_joins": r"BroadcastHashJoin",
    "sort_merge_joins": r"SortMergeJoin",
    "shuffle_exchanges": r"Exchange hashpartitioning",
    "broadcast_exchanges": r"BroadcastExchange",
    "sort_nodes": r"\bSort ",
}


def plan_counts(df: DataFrame) -> dict[str, int]:
    """Nodes of the physical plan as text, before adaptive changes, whether or not the frame has run."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return {name: len(re.findall(token, plan)) for name, token in TOKENS.items()}


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


def equivalent(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows in which two results differ, counted with multiplicity in both directions. Each result is computed once."""
    a, b = cut(a), cut(b)
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    right = b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"))
    return left.select("only_left", F.lit(0).cast("bigint").alias("only_right")).unionByName(right.select(F.lit(0).cast("bigint").alias("only_left"), "only_right")).agg(F.sum("only_left").alias("only_left"), F.sum("only_right").alias("only_right"))


def counted(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """`df` with counters that fill in while it runs, without a pass of their own: rows, and rows per condition."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("row_count"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), seen


def job_stages(spark: SparkSession, group: str, action: Callable[[], object]) -> tuple[object, list[int]]:
    """The result of an action and the ids of the stages it ran under a job group."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        result = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    return result, sorted({s for j in jobs if j for s in j.stageIds})


def interleaved(actions: dict[str, Callable[[], object]], runs: int = 5) -> dict[str, dict[str, float]]:
    """One warm-up each, then `runs` interleaved runs; mean and sample deviation in seconds."""
    if runs < 2:
        raise ValueError("at least two runs")
    for action in actions.values():
        action()
    took: dict[str, list[float]] = {k: [] for k in actions}
    for _ in range(runs):
        for name, action in actions.items():
            t = time.perf_counter()
            action()
            took[name].append(time.perf_counter() - t)
    return {k: {"mean": statistics.mean(v), "stddev": statistics.stdev(v), "best": min(v)} for k, v in took.items()}
