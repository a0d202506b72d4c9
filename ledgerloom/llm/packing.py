"""Items of varying length packed into containers of fixed capacity by bulk-synchronous best fit.

Lengths are whole numbers up to the capacity, so documents and gaps in range order are runs of equal lengths: at most `capacity` runs each, however
many documents there are. A round sweeps both sorted runs: each item goes to its successor, the smallest gap that holds it; where more items than
containers meet, those of higher rank (longer, then earlier) win and the rest moves on to the next larger gap; items without a gap open new containers.
Then gaps are updated and the next round begins. Items of half a capacity and more are placed first, then those of a quarter and more, and so on.

The sweeps run over the runs alone, one task a kind of container, which sees one row per length up to the capacity. The documents take part twice: they
are counted by length, and each gets its container from its rank among the documents of its length (`ranks.seeded_ranks`), found among the placed runs
of its length and block of ranks by one ordered pass. Nothing reaches the driver and nothing is broadcast.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranks import seeded_ranks

#: Ranks of one length that are looked up together: a task of the last step sees at most that many items and as many runs.
BLOCK = 4096
RUN = "pack_name string, length bigint, first bigint, upto bigint, container bigint, slot bigint"


def place_runs(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """counts: items by length 1..capacity. Returns placed runs {length: [(first rank, first container, round)]} and the number of containers.

    A run's items have consecutive ranks and go to consecutive containers, one each; it ends where the next begins.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("a length lies outside 1..capacity")
    used = dict.fromkeys(left, 0)
    placed: dict[int, list[tuple[int, int, int]]] = {s: [] for s in left}
    gaps: dict[int, list[tuple[int, int]]] = {}
    containers, rounds, least = 0, 0, capacity

    def put(size: int, first: int, n: int) -> None:
        placed[size].append((used[size], first, rounds))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]

    while left:
        least = least // 2 if least > 1 else 0
        while active := sorted((s for s in left if s > least), reverse=True):
            rounds += 1
            opened: dict[int, list[tuple[int, int]]] = {}
            order = sorted(gaps)
            moved = False
            for size in active:
                at = bisect.bisect_left(order, size)
                while size in left and at < len(order):
                    gap = order[at]
                    runs = gaps[gap]
                    while runs and size in left:
                        lo, hi = runs.pop()
                        n = min(hi - lo, left[size])
                        put(size, lo, n)
                        moved = True
                        if gap > size:
                            opened.setdefault(gap - size, []).append((lo, lo + n))
                        if lo + n < hi:
                            runs.append((lo + n, hi))
                    if not runs:
                        del gaps[gap]
                        order.pop(at)
                    else:
                        at += 1
            rest = [s for s in active if s in left]
            # Whatever found no gap this round waits while containers filled just now may still hold it.
            if rest and not (moved and any(g >= rest[-1] for g in opened)):
                need = -(-sum(s * left[s] for s in rest) // capacity)
                for size in rest:
                    n = min(need, left[size])
                    put(size, containers, n)
                    if capacity > size:
                        opened.setdefault(capacity - size, []).append((containers, containers + n))
                    containers += n
                    need -= n
                    if not need:
                        break
            for gap, runs in opened.items():
                gaps.setdefault(gap, []).extend(runs)
    return placed, containers


def pieces(df: DataFrame, size: str, capacities: Sequence[tuple[str, int]]) -> DataFrame:
    """`df` once per container kind and piece: pack_name, piece, start, length. An item is split only where it alone exceeds the capacity: into full
    pieces and one rest. An item of length 0 has one piece of length 0; a null length gives no row."""
    kinds = F.array(*[F.struct(F.lit(name).alias("pack_name"), F.lit(int(c)).cast("bigint").alias("capacity")) for name, c in capacities])
    if not capacities:
        kinds = F.array().cast("array<struct<pack_name:string,capacity:bigint>>")
    each = df.where(F.col(size).isNotNull()).withColumn("_k", F.explode(kinds)).select(*df.columns, "_k.*")
    last = F.greatest(F.lit(0), F.ceil(F.col(size) / F.col("capacity")) - 1).cast("int")
    each = each.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return each.select("*", start.alias("start"), F.least(F.col("capacity"), F.col(size) - start).alias("length"))


def pack(df: DataFrame, key: str, size: str, capacities: Sequence[tuple[str, int]]) -> DataFrame:
    """(pack_name, capacity, container_id, slot, key, piece, start, length): every piece once, sum of lengths per container at most its capacity.

    Containers are numbered from 0 within a kind; slot orders a container's pieces. Pieces of length 0 need no space and have a null container. Ties
    of equal lengths are ordered by hash of the key; repeated keys are items of their own. An empty table packs to an empty table.
    """
    items = cut(pieces(df.select(key, size), size, capacities).select(key, "pack_name", "capacity", "piece", "start", "length"))
    some = items.where(F.col("length") > 0)
    runs = some.groupBy("pack_name", "capacity", "length").agg(F.count(F.lit(1)).alias("n")).groupBy("pack_name", "capacity").applyInPandas(_placed, RUN)
    # A run goes to every block of ranks it reaches into, an item to its own; in each block the last run that begins up to an item's rank is the item's.
    block = lambda c: F.floor(c / BLOCK)
    starts = runs.withColumn("_block", F.explode(F.sequence(block(F.col("first")), block(F.col("upto") - 1))))
    start = F.greatest(F.col("first"), F.col("_block") * BLOCK)
    columns = ["capacity", key, "piece", "start"]
    starts = starts.select("pack_name", "length", "_block", start.alias("rank"), F.struct("first", "container", "slot").alias("_run"), *[F.lit(None).cast(items.schema[c].dataType).alias(c) for c in columns])
    ranked = seeded_ranks(some, ["pack_name", "length"], [key, "piece"])
    ranked = ranked.select("pack_name", "length", block(F.col("rank")).alias("_block"), "rank", F.lit(None).cast(starts.schema["_run"].dataType).alias("_run"), *columns)
    order = Window.partitionBy("pack_name", "length", "_block").orderBy("rank", F.col("_run").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = starts.withColumn("_item", F.lit(False)).unionByName(ranked.withColumn("_item", F.lit(True))).withColumn("_at", F.last("_run", ignorenulls=True).over(order)).where("_item")
    container = F.col("_at.container") + F.col("rank") - F.col("_at.first")
    full = met.select("pack_name", "capacity", container.alias("container_id"), F.col("_at.slot").alias("slot"), key, "piece", "start", "length")
    nothing = F.lit(None).cast("bigint")
    empty = items.where(F.col("length") == 0).select("pack_name", "capacity", nothing.alias("container_id"), nothing.alias("slot"), key, "piece", "start", "length")
    return full.unionByName(empty)


def _placed(counts: pd.DataFrame) -> pd.DataFrame:
    """Placed runs of one kind of container from its items by length."""
    name, capacity = counts["pack_name"].iloc[0], int(counts["capacity"].iloc[0])
    sizes = {int(s): int(n) for s, n in zip(counts["length"], counts["n"])}
    out = []
    for length, runs in place_runs(sizes, capacity)[0].items():
        ends = [first for first, _, _ in runs[1:]] + [sizes[length]]
        out += [(name, length, first, upto, container, slot) for (first, container, slot), upto in zip(runs, ends)]
    return pd.DataFrame(out, columns=["pack_name", "length", "first", "upto", "container", "slot"])


def checked(packed: DataFrame, key: str) -> DataFrame:
    """(pack_name, capacity, items, overfull, broken, split_needlessly): items placed, containers above their capacity, items whose pieces are not the whole
    item each part once, and items split though a container would hold them. The last three are 0 by definition."""
    over = packed.where(F.col("container_id").isNotNull()).groupBy("pack_name", "capacity", "container_id").agg(F.sum("length").alias("_t")).groupBy("pack_name", "capacity").agg(F.count_if(F.col("_t") > F.col("capacity")).alias("overfull"))
    each = packed.groupBy("pack_name", "capacity", key).agg(
        F.count(F.lit(1)).alias("_n"), F.max("piece").alias("_last"), F.sum("length").alias("_size"), F.max(F.col("start") + F.col("length")).alias("_end"), F.count_if(F.col("start") != F.col("piece") * F.col("capacity")).alias("_off")
    )
    broken = (F.col("_n") != F.col("_last") + 1) | (F.col("_size") != F.col("_end")) | (F.col("_off") > 0)
    items = each.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("items"), F.count_if(broken).alias("broken"), F.count_if((F.col("_n") > 1) & (F.col("_size") <= F.col("capacity"))).alias("split_needlessly"))
    return items.join(over, ["pack_name", "capacity"], "left").select("pack_name", "capacity", "items", F.coalesce("overfull", F.lit(0)).alias("overfull"), "broken", "split_needlessly")


def fill(packed: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, least_containers, tokens, unused_share) of packed pieces; least: the tokens divided by the capacity, rounded up."""
    each = packed.where(F.col("container_id").isNotNull()).groupBy("pack_name", "capacity").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("length").alias("tokens")
    )
    room = F.col("containers") * F.col("capacity")
    return each.select("pack_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"), "tokens", (1 - F.col("tokens") / room).alias("unused_share"))
