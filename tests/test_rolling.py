import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rolling as R

D0 = datetime.date(2024, 1, 1)


def brute(rows, windows=(7, 30)):
    """{(entity, day): (total, n) per window} over all entities and days."""
    dated = [r for r in rows if r[1] is not None]
    days = [r[1] for r in dated]
    out = {}
    for e in {r[0] for r in dated}:
        for k in range((max(days) - min(days)).days + 1):
            day = min(days) + datetime.timedelta(k)
            res = []
            for w in windows:
                inside = [r[2] for r in dated if r[0] == e and 0 <= (day - r[1]).days < w and r[2] is not None]
                res += [sum(inside), len(inside)]
            out[e, day] = tuple(res)
    return out


def run(spark, rows, windows=(7, 30)):
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "e string, d date, u bigint, s string, day int")
    got = R.rolling_totals(df, ["e"], F.col("d"), F.col("u"), windows)
    return {(r["e"], r["day"]): tuple(x for w in windows for x in (r[f"total_{w}"], r[f"n_{w}"])) for r in got.collect()}, got


@pytest.mark.parametrize("windows", [(7, 30), (1, 64, 65, 200)])
def test_against_brute_force(spark, windows):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), D0 + datetime.timedelta(rng.randint(0, 150)), rng.choice([None, 1, -3, 10**12])) for _ in range(300)]
    rows += rows[:20] + [("a", None, 5), ("only undated", None, 5)]
    assert run(spark, rows, windows)[0] == brute(rows, windows)


def test_averages_and_empty_days(spark):
    _, got = run(spark, [("a", D0, 10), ("a", D0, None), ("a", D0 + datetime.timedelta(9), 4)])
    rows = {r["day"]: r for r in got.collect()}
    assert rows[D0]["average_7"] == 10.0
    gap = rows[D0 + datetime.timedelta(8)]
    assert (gap["total_7"], gap["n_7"], gap["average_7"]) == (0.0, 0, None)
    assert (gap["total_30"], gap["n_30"]) == (10.0, 1)


def test_empty(spark):
    assert run(spark, [])[0] == {}
    assert run(spark, [("a", None, 1)])[0] == {}


def test_corrections_touch_ancestors_only(spark):
    schema = "e string, day int, s bigint, n bigint"
    stored = R.tree_nodes(spark.createDataFrame([("a", k, 10, 1) for k in range(200)], schema), ["e"])
    late = spark.createDataFrame([("a", 70, -10, -1), ("a", 70, 3, 1)], schema)
    now = R.apply_corrections(stored, late.groupBy("e", "day").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), ["e"])
    before = {tuple(r)[:4]: tuple(r)[4:] for r in stored.collect()}
    after = {tuple(r)[:4]: tuple(r)[4:] for r in now.collect()}
    changed = {k for k in after if after[k] != before[k]}
    assert changed == {("a", 1, level, 6 >> level) for level in range(R.LEVELS)}
    rebuilt = R.tree_nodes(spark.createDataFrame([("a", k, 3 if k == 70 else 10, 1) for k in range(200)], schema), ["e"])
    assert after == {tuple(r)[:4]: tuple(r)[4:] for r in rebuilt.collect()}


def test_canonical_nodes_cover_exactly():
    for lo in range(R.SHARD_DAYS):
        for hi in range(lo, R.SHARD_DAYS):
            days = [d for level, i in R.canonical_nodes(lo, hi) for d in range(i << level, (i + 1) << level)]
            assert sorted(days) == list(range(lo, hi + 1))
            assert len(R.canonical_nodes(lo, hi)) <= 2 * R.LEVELS
    with pytest.raises(ValueError, match="at least one day"):
        R.query_plan([0])


def test_hot_entity_is_summed_before_shuffle(spark):
    df = spark.range(1000).select(F.lit("hot").alias("e"), F.lit(D0).alias("d"), F.lit(1).cast("bigint").alias("u"))
    plan = R.daily(df, ["e"], F.col("d"), F.col("u"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_days_are_those_of_the_whole_table(spark):
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(k)
    df = spark.createDataFrame([("A", day(3), 2), (None, day(0), 5), (None, day(9), 5)], "e string, d date, u bigint")
    got = R.rolling_totals(df, ["e"], F.col("d"), F.col("u"), (7,), F.col("e").isNotNull()).orderBy("day").collect()
    assert [r["day"] for r in got] == [day(k) for k in range(10)] and {r["e"] for r in got} == {"A"}
    assert [r["total_7"] for r in got] == [0.0] * 3 + [2.0] * 7
