import math
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import percentiles as P
from ledgerloom.llm.order_bits import NAN_KEY, from_key, with_key

EDGES = [0.0, -0.0, 1.0, -1.0, 0.1, 1e300, -1e300, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, math.inf, -math.inf, 0.9999999999999999, 1.0000000000000002, 2.0**60, 3.5e-310]


def true_key(x):
    bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -bits if x < 0 else bits


def test_keys_of_edges_and_random_bits(spark):
    rng = random.Random(1)
    values = EDGES + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)] + [2.0**e for e in range(-1074, 1024, 7)] + [-(2.0**e) * 0.9999999999999999 for e in range(-1000, 1023, 13)]
    values = [v for v in values if v == v]
    df = with_key(spark.createDataFrame([(v,) for v in values], "v double"), F.col("v"), "k")
    for r in df.withColumn("back", from_key(F.col("k"))).collect():
        assert r["k"] == true_key(r["v"]), r
        assert r["back"] == r["v"]


def test_nan_null(spark):
    df = with_key(spark.createDataFrame([(math.nan,), (None,)], "v double"), F.col("v"), "k")
    assert [r["k"] for r in df.collect()] == [NAN_KEY, None]


def brute(values, p):
    s = sorted(values)
    return s[max(1, math.ceil(p * len(s))) - 1]


PS = [0.0, 0.5, 0.8, 0.9, 0.99, 1.0]


def check(spark, rows):
    df = spark.createDataFrame([(g, part, v, 1, 2) for g, part, v in rows], "g string, part int, v double, bin int, n int")
    merged = P.merge(P.partials(df, "v", ["g"], ["part"]), ["g"])
    got = {(r["g"], r["p"]): (r["value"], r["n_values"]) for r in P.select_ranks(merged, P.keyed(df, "v", ["g"]), ["g"], PS).collect()}
    # Partials need not be merged before.
    assert {(r["g"], r["p"]): (r["value"], r["n_values"]) for r in P.select_ranks(P.partials(df, "v", ["g"], ["part"]), P.keyed(df, "v", ["g"]), ["g"], PS).collect()} == got
    groups = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {(g, p): (brute(vs, p), len(vs)) for g, vs in groups.items() for p in PS}
    bounds = P.bounded(merged, ["g"], PS).collect()
    assert len(bounds) == len(got)
    for r in bounds:
        true = got[r["g"], r["p"]][0]
        assert r["low"] <= true <= r["high"]
        assert abs(r["estimate"] - true) <= r["error_bound"] + 1e-300
        assert r["error_bound"] <= 2.0**-12 * max(abs(true), 1e-300)


def test_selection_against_sorting(spark):
    rng = random.Random(3)
    rows = []
    for g, make in {"ties": lambda: rng.choice([0.0, 1.5, 2.5]), "wide": lambda: rng.gauss(0, 1) * 10.0 ** rng.randint(-20, 20), "close": lambda: 1.0 + rng.randint(0, 400) * 2.0**-52, "hot": lambda: rng.random()}.items():
        rows += [(g, rng.randint(0, 4), make()) for _ in range(3000 if g == "hot" else 400)]
    rows += [("one", 0, -7.25), (None, 0, 3.0), (None, 1, 1.0), ("void", 0, None), ("hot", 0, None), ("-0", 0, -1e-310), ("-0", 0, 1e-310), ("-0", 1, -5.0)]
    check(spark, rows)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 2), st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False, allow_subnormal=True))), min_size=1, max_size=30))
def test_any_values(spark, rows):
    df = spark.createDataFrame(rows, "g string, part int, v double")
    got = {(r["g"], r["p"]): r["value"] for r in P.select_ranks(P.partials(df, "v", ["g"]), P.keyed(df, "v", ["g"]), ["g"], [0.5]).collect()}
    groups = {}
    for g, _, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert got == {(g, 0.5): brute(vs, 0.5) for g, vs in groups.items()}


def test_shuffled_join_path_and_empty(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    rng = random.Random(9)
    check(spark, [(rng.choice("abc"), 0, rng.random()) for _ in range(300)])
    df = spark.createDataFrame([], "g string, v double")
    assert P.select_ranks(P.partials(df, "v", ["g"]), P.keyed(df, "v", ["g"]), ["g"], [0.5]).count() == 0


def test_grouping_sets(spark):
    df = spark.createDataFrame([("x", "m1", 1.0), ("x", "m2", 3.0), ("y", "m1", 5.0), ("y", None, 9.0), ("z", "m9", 1.0 + 2.0**-50), ("z", "m9", 1.0 + 2.0**-51), ("z", "m9", 1.0 + 2.0**-40)], "s string, m string, v double")
    sets = [("s", "m"), ("m",), ("s",)]
    h, rows = P.spread(P.partials(df, "v", ["s", "m"]), sets), P.keyed(df, "v", ["s", "m"])
    got = {tuple(r)[:3]: r["value"] for r in P.select_ranks(h, rows, [P.LEVEL, "s", "m"], [0.5], sets).collect()}
    assert got["m", None, "m1"] == 1.0 and got["m", None, None] == 9.0
    assert got["s", "x", None] == 1.0 and got["s,m", "y", None] == 9.0 and len(got) == 5 + 4 + 3
    assert got["s", "z", None] == got["s,m", "z", "m9"] == 1.0 + 2.0**-50
