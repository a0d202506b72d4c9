"""Ranks within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A group is split by hash into this many parts.
PARTS = 128


def seeded_ranks(df: DataFrame, groups: Sequence[str], key: Sequence[str], name: str = "rank", seed: int = 0, parts: int = PARTS) -> DataFrame:
    """`df` with bigint `name`: 0, 1, ... within each group, in an order drawn by hash of `key` and `seed`.

    The hash splits a group into parts; rows are numbered inside (group, part) and offset by the sizes of the parts before, so that a group with a
    third of all rows costs `parts` tasks. `key` should tell rows apart; equal keys get adjacent ranks. Both steps share one shuffle by (group, part).
    """
    h = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    keyed = df.withColumn("_h", h).withColumn("_part", F.pmod("_h", F.lit(parts)).cast("int"))
    within = Window.partitionBy(*groups, "_part").orderBy("_h", *key)
    numbered = keyed.withColumn("_n", F.row_number().over(within))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(*[F.col(g).alias(f"_{g}") for g in groups], F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    on: Column = F.col("_part") == F.col("_p")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return numbered.join(offsets, on).withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_h", "_part", "_n", "_p", "_before", *[f"_{g}" for g in groups])
