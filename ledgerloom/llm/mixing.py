"""Sources mixed to target shares of the total size by subset-sum budget fitting.

Documents are counted by exact length per source. The total is the largest for which no source needs more than `max_repeats` uses of a record; a
source's budget is its share of it. Whole passes over a source come first; for the rest of its budget each length gives its even part, and the
remaining few tokens are fitted exactly by a bounded-knapsack program over the lengths not yet used. Which documents of a length are taken is drawn by
seeded rank. Each mix is fitted in a task of its own from counts by length; nothing but the list of targets reaches the driver.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranks import seeded_ranks

#: Size of the budget that the exact program fits, at least; at most this plus three times the longest length in use.
FIT = 8192
#: Steps of the exact program between two states that are kept; those in between are made again when they are needed.
KEPT = 64


def knapsack(counts: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """How many of each length, at most `counts`, so that their sum is the largest one up to `budget`; which lengths take part is drawn by `seed`."""
    parts = []
    for length, n in sorted(counts.items()):
        n = min(n, budget // length) if length else 0
        k = 1
        while n > 0:
            take = min(k, n)
            parts.append((length, take))
            n -= take
            k *= 2
    random.Random(seed).shuffle(parts)
    mask = (1 << (budget + 1)) - 1
    step = lambda reach, part: (reach | reach << (part[0] * part[1])) & mask
    # Bit s of a state tells that the parts so far can make up s.
    kept, now, done = [1], 1, 0
    for part in parts:
        now, done = step(now, part), done + 1
        if now >> budget & 1:
            break
        if done % KEPT == 0:
            kept.append(now)
    at = now.bit_length() - 1
    chosen: dict[int, int] = {}
    for k in range(len(kept) - 1, -1, -1):
        block = parts[k * KEPT : min(done, (k + 1) * KEPT)]
        states = [kept[k]]
        for part in block:
            states.append(step(states[-1], part))
        for before, (length, take) in zip(reversed(states[:-1]), reversed(block)):
            if not before >> at & 1:
                chosen[length] = chosen.get(length, 0) + take
                at -= length * take
    return chosen


def fit_budget(counts: dict[int, int], budget: int, seed: int = 0) -> dict[int, int]:
    """Counts by length, within `counts`, whose sum is `budget` or as near below as the lengths allow.

    Most of the budget is spread evenly over all lengths (in seeded order, what a length rounds off going to the next), so that the drawn documents
    keep the source's mix of lengths; the rest is fitted exactly. Where the lengths left over cannot make up the rest, less is spread.
    """
    total = sum(length * n for length, n in counts.items())
    if budget >= total:
        return dict(counts)
    best: dict[int, int] = {}
    for part in (0.9, 0.75, 0.5, 0.25, 0.0):
        chosen = _fit(counts, budget, total, part, seed)
        if _size(chosen) > _size(best):
            best = chosen
        if _size(best) == budget:
            break
    return best


def _size(counts: dict[int, int]) -> int:
    return sum(length * n for length, n in counts.items())


def _fit(counts: dict[int, int], budget: int, total: int, part: float, seed: int) -> dict[int, int]:
    order = sorted(counts)
    random.Random(seed).shuffle(order)
    rest, carry = budget, 0.0
    share = part * budget / total
    chosen = dict.fromkeys(counts, 0)
    for length in order:
        want = counts[length] * share + carry
        n = min(int(want), counts[length], rest // length)
        carry = min(want - n, 1.0)
        chosen[length] = n
        rest -= n * length
    # A further even pass brings what is left down to the size of the exact program.
    keep = FIT + 2 * max(counts, default=0)
    while rest > keep:
        before = rest
        spare = sum(length * (n - chosen[length]) for length, n in counts.items())
        for length in order:
            n = min(counts[length] - chosen[length], max(0, rest - keep) // length, -(-(counts[length] - chosen[length]) * rest // spare))
            chosen[length] += n
            rest -= n * length
        if rest == before:
            break
    for length, n in knapsack({length: n - chosen[length] for length, n in counts.items() if n > chosen[length]}, rest, seed).items():
        chosen[length] += n
    return {length: n for length, n in chosen.items() if n}


def plan_mix(targets: Sequence[tuple[str, float, int]], counts: dict[str, dict[int, int]], total: int | None = None, seed: int = 0) -> tuple[int, dict[str, tuple[int, int, dict[int, int]]]]:
    """targets: (source, share, max_repeats). Returns the total and {source: (budget, whole passes, extra uses by length)}.

    Without `total` the largest feasible one is taken. With one, a source that cannot reach its budget within max_repeats gives all it may. A source
    with a share and no records makes the feasible total 0.
    """
    sizes = {s: sum(length * n for length, n in counts.get(s, {}).items()) for s, _, _ in targets}
    wanted = [(s, share, most) for s, share, most in targets if share and share > 0]
    if total is None:
        total = int(min((sizes[s] * most / share for s, share, most in wanted), default=0) + 1e-6)
    out = {}
    for s, share, most in wanted:
        budget = round(share * total)
        size = sizes[s]
        passes = min(most, budget // size) if size else 0
        rest = budget - passes * size
        extra = fit_budget(counts[s], rest, seed) if passes < most and rest and size else {}
        out[s] = (budget, passes, extra)
    return total, out


def mix(documents: DataFrame, key: str, source: str, size: str, targets: DataFrame, seed: int = 0, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, plan). records: (mix_name, source, key, size, uses) for each record used; plan: (mix_name, source, target_share, max_repeats, budget).

    targets: mix_name, source, target_share, max_repeats. Records without a source or of another source, and records of null or zero size, are in no
    mix; targets without a mix or source are left out, a null share is 0 and null max_repeats 1, repeated targets count once. Ties of equal length are drawn by seeded hash of the key.
    """
    wanted = targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull())
    goals = wanted.select("mix_name", "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("bigint").alias("max_repeats"))
    listed = goals.select("source").distinct()
    used = documents.where(F.col(size) > 0).select(F.col(key), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens")).join(listed, "source", "left_semi")
    counts = used.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        """Budgets (n_tokens null) and what to take of each length, of one mix."""
        own = [tuple(r) for r in rows[["source", "target_share", "max_repeats"]].drop_duplicates().sort_values("source").itertuples(index=False)]
        sizes: dict[str, dict[int, int]] = {}
        for s, length, n in rows.loc[rows["n"].notna(), ["source", "n_tokens", "n"]].sort_values(["source", "n_tokens"]).itertuples(index=False):
            sizes.setdefault(s, {})[int(length)] = int(n)
        _, found = plan_mix([(s, float(share), int(most)) for s, share, most in own], sizes, total, seed)
        name, out = rows["mix_name"].iloc[0], []
        for s, share, most in own:
            budget, passes, extra = found.get(s, (0, 0, {}))
            out.append((name, s, share, most, budget, None, None, None))
            out += [(name, s, share, most, budget, length, passes, extra.get(length, 0)) for length in sizes.get(s, {}) if passes or extra.get(length)]
        frame = pd.DataFrame(out, columns=["mix_name", "source", "target_share", "max_repeats", "budget", "n_tokens", "passes", "extra"])
        return frame.astype({c: "Int64" for c in ("max_repeats", "budget", "n_tokens", "passes", "extra")})

    # A mix's task sees one row per source and length.
    schema = "mix_name string, source string, target_share double, max_repeats bigint, budget bigint, n_tokens bigint, passes bigint, extra bigint"
    plans = cut(goals.join(counts, "source", "left").groupBy("mix_name").applyInPandas(fitted, schema))
    chosen = plans.where(F.col("n_tokens").isNotNull()).select("mix_name", "source", "n_tokens", "passes", "extra")
    ranked = seeded_ranks(used, ["source", "n_tokens"], [key], seed=seed)
    # One row per mix, source and length: broadcast where AQE measures it to be small, else joined by (source, length).
    records = ranked.join(chosen, ["source", "n_tokens"]).withColumn("uses", F.col("passes") + (F.col("rank") < F.col("extra")).cast("bigint"))
    records = records.where(F.col("uses") > 0).select("mix_name", "source", key, "n_tokens", "uses")
    return records, plans.where(F.col("n_tokens").isNull()).select("mix_name", "source", "target_share", "max_repeats", "budget")


def shares(records: DataFrame, plan: DataFrame) -> DataFrame:
    """What each source reached: records, tokens, most uses of one record and share of its mix, next to target and budget."""
    reached = records.groupBy("mix_name", "source").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    total = reached.groupBy("mix_name").agg(F.sum("tokens").alias("mix_tokens"))
    out = plan.join(reached, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return out.select("mix_name", "source", "target_share", "max_repeats", "budget", zero("records"), zero("tokens"), zero("most_uses"), (F.coalesce("tokens", F.lit(0)) / F.col("mix_tokens")).alias("share"))
