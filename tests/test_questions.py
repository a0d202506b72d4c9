"""The analytical operators on hand-made rows, against brute force and in their plans."""

import datetime
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerloom import session
from ledgerloom.operators import conditional_share, profile, thresholds, variety, window_winner
from ledgerloom.plans import inspect

DAY = lambda k: datetime.date(2022, 4, 1) + datetime.timedelta(k)
SCHEMA = "state string, d date, size string, amount double, n int, m string, window_date string"


def winners(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0, "", "") for r in rows], SCHEMA)
    return {(r["state"], r["window_date"]): (r["size"], r["purchase_count"], r["population_variance"]) for r in window_winner.window_winner(df, "state", "d", "size", "amount", **kw).collect()}


def test_moments_and_buckets(spark):
    got = winners(spark, [("GOA", DAY(4), "M", 500.0), ("GOA", DAY(4), "M", 600.0), ("GOA", DAY(4), "M", None)])
    assert got == {("GOA", DAY(4 + k)): ("M", 3, 2500.0) for k in range(1, 11)}


@pytest.mark.parametrize(
    ("rows", "winner"),
    [
        ([("M", 1.0), ("M", 5.0), ("L", 2.0), ("L", 4.0)], "L"),  # less variance
        ([("M", None), ("L", 9.0)], "L"),  # undefined variance last
        ([("M", 1.0), ("L", 1.0)], "L"),  # name
        ([("S", 1.0), ("3XL", 1.0)], "3XL"),  # text order, not size order
        ([("M", 1.0), ("M", 9.0), ("L", 1.0)], "M"),  # count first
    ],
)
def test_ties(spark, rows, winner):
    assert winners(spark, [("X", DAY(0), s, a) for s, a in rows])["X", DAY(1)][0] == winner


def test_window_length_counts_all_rows(spark):
    rows = [("X", DAY(0), "M", 1.0)] * 3 + [("X", None, "M", 1.0), ("X", DAY(1), None, 1.0), (None, DAY(0), "M", 1.0)]
    assert len(winners(spark, rows, busy_above=5)) == 10
    assert len(winners(spark, rows, busy_above=4)) == 5
    assert winners(spark, []) == {}


def test_winner_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("AB"), DAY(rng.randint(0, 30)), rng.choice(["S", "M", "L"]), rng.choice([None, 1.25, 2.5, 7.75])) for _ in range(400)]
    want = {}
    for s, k in itertools.product("AB", range(60)):
        span = 5 if sum(r[0] == s for r in rows) > 200 else 10
        inside = [r for r in rows if r[0] == s and 1 <= (DAY(k) - r[1]).days <= span]
        best = []
        for size in {r[2] for r in inside}:
            a = [r[3] for r in inside if r[2] == size and r[3] is not None]
            v = statistics.pvariance(a) if a else float("inf")
            best.append((-sum(r[2] == size for r in inside), v, size))
        if best:
            n, v, size = min(best)
            want[s, DAY(k)] = (size, -n, v)
    got = winners(spark, rows, busy_above=200)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:2] == want[k][:2]
        assert abs(got[k][2] - want[k][2]) < 1e-9


def test_variety(spark):
    schema = "state string, month string, style string, sku string, rank int, variety int"
    rows = [("A", "04", "s1", k, r, 0) for k, r in [("A", 6), ("A", 1), ("B", None), ("C", 2), ("C", 2)]]
    rows += [("A", "04", "s2", "X", 1, 0), ("B", "04", "s2", "X", 7, 0), ("A", "04", "s3", "X", 1, 0), ("A", "04", "s4", None, 9, 0), (None, "04", "s3", "X", 9, 0)]
    df = spark.createDataFrame(rows, schema)
    run = lambda scope: {(r["state"], r["month"]): (r["median_variety"], r["eligible_style_count"], r["eligibility_scope"]) for r in variety.median_variety(df, "state", "month", "style", "sku", "rank", scope=scope).collect()}
    assert run("global") == {("A", "04"): (1.0, 3, "global"), ("B", "04"): (1.0, 1, "global")}
    assert run("LOCAL") == {("A", "04"): (3.0, 1, "local"), ("B", "04"): (1.0, 1, "local")}
    with pytest.raises(ValueError, match="scope"):
        run("other")
    assert variety.median_variety(df.limit(0), "state", "month", "style", "sku", "rank").count() == 0


def test_median_of_even_group(spark):
    rows = [("A", "04", f"s{i}", f"k{j}", 6) for i, n in enumerate([1, 2, 4, 7]) for j in range(n)]
    df = spark.createDataFrame(rows, "state string, month string, style string, sku string, rank int")
    assert variety.median_variety(df, "state", "month", "style", "sku", "rank").first()["median_variety"] == 3.0


SHARE = "k bigint, city string, state string, d date, tags array<string>, amount double, kind string, average double"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Rows as a file, whose size Catalyst knows."""

    def f(rows):
        path = str(tmp_path_factory.mktemp("rows") / "rows.parquet")
        spark.createDataFrame([(*r, -1.0) for r in rows], SHARE).write.parquet(path)
        return spark.read.parquet(path)

    return f


def share(df, strategy="auto"):
    return conditional_share.conditional_share(df, "k", "city", "state", "d", "tags", "amount", F.col("kind") == "ref", F.col("kind") == "cand", strategy=strategy)


def share_rows():
    long = ["p1", "p2", "p3"]
    rows = [(1, None, "S", DAY(0), [*long, "short"], 100.0, "ref"), (2, None, "S", DAY(2), long, 100.0, "ref"), (3, None, "S", DAY(1), ["short"], None, "ref")]
    rows += [(4, "C", "S", DAY(1), long, 50.0, "cand"), (5, "C", "S", DAY(1), [], 50.0, "cand"), (6, "C", "T", DAY(1), long, 50.0, "cand"), (7, "C", "S", None, long, 100.0, "cand")]
    rows += [(8, "D", "S", DAY(1), ["p1", "p2", "short"], 50.0, "cand"), (9, None, "S", DAY(1), long, 50.0, "cand"), (None, "C", "S", DAY(1), long, 50.0, "cand"), (10, "E", None, DAY(1), None, None, "cand")]
    return rows


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "merge"])
def test_city_share(stored, strategy):
    f = share(stored(share_rows()), strategy)
    assert {r["tag"]: r["active_days"] for r in f.periods.collect()} == {"p1": 2, "p2": 2, "p3": 2, "short": 1}
    got = {r["city"]: (r["candidate_count"], r["qualifying_count"], r["qualifying_percentage"]) for r in f.result.collect()}
    assert got == {"C": (4, 1, 25.0), "D": (1, 0, 0.0), "E": (1, 0, 0.0)}


def test_strategies_give_one_result_by_different_plans(stored, monkeypatch):
    df = stored(share_rows())
    a, b = share(df, "broadcast").result, share(df, "merge").result
    assert tuple(inspect.equivalent(a, b).first()) == (0, 0)
    plans = [inspect.plan_counts(x) for x in (a, b)]
    assert (plans[0]["broadcast_hash_joins"], plans[0]["sort_merge_joins"]) == (3, 0)
    assert (plans[1]["broadcast_hash_joins"], plans[1]["sort_merge_joins"]) == (0, 3)
    assert plans[0]["shuffle_exchanges"] < plans[1]["shuffle_exchanges"]
    assert "Physical Plan" in inspect.plan_text(a)
    assert share(stored([])).result.count() == 0
    # Beyond the bound nothing is broadcast by hint.
    monkeypatch.setitem(conditional_share.STRATEGIES, "broadcast", lambda d: session.broadcast_if_small(d, limit=1))
    assert "hint" not in share(df, "broadcast").result._jdf.queryExecution().logical().toString().lower()


OBS = "i bigint, sku string, month string, v int, a double, n int"
KEY = ["sku", "month"]


def observed(spark, rows):
    return thresholds.observations(spark.createDataFrame([(*r, 0) for r in rows], OBS), "i", KEY, "v", "a")


def test_thresholds(spark):
    obs = observed(spark, [(i, "x", "04", v, 1.0) for i, v in enumerate([1, 2, 3, 4, 10])] + [(None, "x", "04", 99, 1.0), (9, None, "04", 99, 1.0), (9, "x", None, 99, 1.0)])
    assert {r["percentile"]: r["threshold"] for r in thresholds.exact(obs, KEY).collect()} == {0.8: pytest.approx(5.2, abs=1e-12), 0.9: pytest.approx(7.6, abs=1e-12)}
    assert {r["percentile"]: r["threshold"] for r in thresholds.approximate(obs, KEY).collect()} == {0.8: 4.0, 0.9: 10.0}
    assert thresholds.exact(obs, KEY).first()["total_order_count"] == 5


def test_exact_equals_array_form(spark):
    rng = random.Random(7)
    obs = observed(spark, [(i, f"s{i % 40}", "04", rng.randint(0, 30), 1.0) for i in range(2000)])
    a = {(r["sku"], r["percentile"]): r["threshold"] for r in thresholds.exact(obs, KEY).collect()}
    b = {(r["sku"], r["percentile"]): r["threshold"] for r in thresholds.exact_by_array(obs, KEY).collect()}
    assert a.keys() == b.keys()
    assert max(abs(a[k] - b[k]) for k in a) < 1e-12


def test_statistics_and_guards(spark):
    obs = observed(spark, [(1, "one", "04", 3, 5.0), (2, "two", "04", 4, 7.0), (3, "two", "04", 4, None), (4, "sd", "04", 1, 100.0), (5, "sd", "04", 9, 2.0), (6, "sd", "04", 9, 4.0)])
    got = {(r["sku"], r["percentile"]): r for r in thresholds.exact_result(obs, KEY).collect()}
    assert (got["one", 0.8]["threshold"], got["one", 0.8]["amount_stddev_pop"]) == (3.0, 0.0)
    assert (got["two", 0.9]["qualifying_order_count"], got["two", 0.9]["qualifying_amount_count"], got["two", 0.9]["amount_stddev_pop"]) == (2, 1, 0.0)
    assert (got["sd", 0.8]["qualifying_order_count"], got["sd", 0.8]["amount_stddev_pop"]) == (2, 1.0)
    joined = thresholds.statistics(obs, thresholds.exact(obs, KEY), KEY)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, thresholds.exact_result(obs, KEY).collect()))
    assert "Join" not in thresholds.exact_result(obs, KEY)._jdf.queryExecution().executedPlan().toString()
    result = thresholds.exact_result(obs, KEY).unionByName(thresholds.approximate_result(obs, KEY))
    assert thresholds.invalid_rows(result).count() == 0
    assert thresholds.duplicate_keys(result, [*KEY, "method", "percentile"]).count() == 0
    assert thresholds.duplicate_keys(result, KEY).count() == 3
    assert thresholds.invalid_rows(result.withColumn("threshold", F.lit(None).cast("double"))).count() == result.count()
    assert thresholds.checksum(result).first()["row_count"] == 12


def test_comparison(spark):
    obs = observed(spark, [(i, "x", "04", v, float(v)) for i, v in enumerate([1, 2, 3, 4, 10])] + [(9, "y", "04", 1, 1.0)])
    c = thresholds.comparison(obs, thresholds.approximate_result(obs, KEY), thresholds.exact_result(obs, KEY), KEY)
    once = thresholds.compare(obs, KEY)
    assert sorted(map(tuple, once.select(*c.columns).collect())) == sorted(map(tuple, c.collect()))
    got = {(r["sku"], r["percentile"]): r for r in once.collect()}
    assert got["x", 0.8]["threshold_differs"] and got["x", 0.8]["membership_difference_count"] == 1 and got["x", 0.8]["stddev_differs"]
    assert not got["y", 0.8]["threshold_differs"] and not got["y", 0.8]["qualifying_set_differs"]
    s = {r["percentile"]: r for r in thresholds.summary(c).collect()}
    assert (s[0.8]["group_count"], s[0.8]["threshold_differs_count"]) == (2, 1)
    assert thresholds.strongest(c, KEY).first()["sku"] == "x"
    assert thresholds.exact_result(obs.limit(0), KEY).count() == 0


def test_profile(spark):
    cols = ["order_date", "quantity", "amount", "promotion_ids", "ship_state", "order_id", "source_index", "status", "size"]
    rows = [("04-01-22", "1", "5", "a,,b", " apo", "o1", "1", "X ", "M"), ("bad", "x", "", None, "goa", "o1", "1", "X", None), (None, None, "1e3", "", None, " ", "2", None, "M")]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    r = profile.integrity(raw).first()
    assert (r["row_count"], r["parsed_dates"], r["invalid_dates"], r["invalid_quantities"], r["invalid_amounts"], r["apo_rows"], r["min_promotions"], r["max_promotions"]) == (3, 1, 2, 1, 1, 1, 0, 2)
    assert {x["metric"]: x["value"] for x in profile.distinct_values(raw).collect()} == {"distinct_order_ids": 1, "distinct_states": 2, "duplicate_index_rows": 1}
    assert {x["column_name"]: x["blank_rows"] for x in profile.blanks(raw, cols).collect()}["amount"] == 1
    assert [tuple(x) for x in profile.frequencies(raw, "status").collect()] == [("X", 2), (None, 1)]
    text = profile.report(raw, cols)
    assert "## Missing values" in text and "| APO | 1 |" in text and "| <NULL> | 1 |" in text
    assert profile.integrity(raw.limit(0)).first()["row_count"] == 0
    assert tuple(profile.group_sizes(raw, ["status"], 0).first()) == (3, 3, 1)
    assert profile.largest_group(raw, ["order_id"]).first()["n"] == 2
    assert profile.partition_estimate(1000, 10, 5, 100) == {"largest_bytes": 500.0, "partitions": 5.0, "fits": False}
    assert profile.partition_estimate(0, 0, 0)["fits"]


def test_counters_stages_and_timing(spark):
    df, seen = inspect.counted(spark.range(10), "rows", even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"row_count": 10, "even": 5}
    n, stages = inspect.job_stages(spark, "grouped", lambda: spark.range(10).groupBy((F.col("id") % 2).alias("k")).count().count())
    assert n == 2 and len(stages) >= 2
    took = inspect.interleaved({"a": lambda: None, "b": lambda: None}, runs=2)
    assert took.keys() == {"a", "b"} and took["a"]["mean"] >= 0
    with pytest.raises(ValueError, match="two runs"):
        inspect.interleaved({}, runs=1)


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(RuntimeError), session.settings(spark, spark__sql__autoBroadcastJoinThreshold=-1, spark__ledgerloom__x="y"):
        assert (spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.ledgerloom.x")) == ("-1", "y")
        raise RuntimeError
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before and spark.conf.get("spark.ledgerloom.x", None) is None


def test_invalid_rows_one_by_one(spark):
    good = ("x", "04", "approx", 0.8, 1.0, 3, 2, 2, 0.5)
    bad = [(None, *good[1:]), (good[0], None, *good[2:]), (*good[:2], None, *good[3:]), (*good[:4], None, *good[5:]), (*good[:8], None), (*good[:5], 0, 0, 0, 0.0), (*good[:6], 2, 3, 0.5), (*good[:6], 4, 2, 0.5), (*good[:8], -1.0), (*good[:7], 1, 0.5)]
    df = spark.createDataFrame([good, *bad], "sku string, month string, method string, percentile double, threshold double, total_order_count bigint, qualifying_order_count bigint, qualifying_amount_count bigint, amount_stddev_pop double")
    assert sorted(map(repr, map(tuple, thresholds.invalid_rows(df).collect()))) == sorted(map(repr, bad))


def test_amounts_finer_than_cents(spark):
    values = [1.2345, 2.0, 2.5, 1e15]
    for k in (3, 4):
        got = winners(spark, [("X", DAY(0), "M", v) for v in values[:k]])["X", DAY(1)]
        assert got[2] == pytest.approx(statistics.pvariance(values[:k]), rel=1e-9)
