import itertools
import random

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import mixing, packing
from ledgerloom.llm.ranks import seeded_ranks


def unfold(placed, containers, capacity, counts):
    """Contents of the containers; checks that every item has one place."""
    inside = [[] for _ in range(containers)]
    for size, runs in placed.items():
        ends = [r[0] for r in runs[1:]] + [counts[size]]
        assert runs[0][0] == 0
        for (first, container, turn), end in zip(runs, ends):
            for k in range(end - first):
                inside[container + k].append((turn, size))
    for c in inside:
        assert c and sum(s for _, s in c) <= capacity
        assert len({t for t, _ in c}) == len(c)
    assert sum(len(c) for c in inside) == sum(counts.values())
    return inside


def best_fit_decreasing(counts, capacity):
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = [g for g in range(len(gaps)) if gaps[g] >= s]
        if fit:
            gaps[min(fit, key=gaps.__getitem__)] -= s
        else:
            gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 40), max_size=12))))
def test_placed_runs_are_a_packing(case):
    capacity, counts = case
    placed, containers = packing.place_runs(counts, capacity)
    unfold(placed, containers, capacity, counts)
    assert containers <= best_fit_decreasing(counts, capacity) * 1.05 + 1


def test_close_to_best_fit_decreasing():
    rng = random.Random(1)
    for capacity in (100, 256, 1024):
        counts = {}
        for _ in range(4000):
            s = min(capacity, max(1, int(rng.lognormvariate(3.6, 0.9))))
            counts[s] = counts.get(s, 0) + 1
        _, containers = packing.place_runs(counts, capacity)
        assert containers <= best_fit_decreasing(counts, capacity) * 1.01 + 1


def test_lengths_outside_raise():
    with pytest.raises(ValueError, match="outside"):
        packing.place_runs({5: 1}, 4)
    assert packing.place_runs({}, 4) == ({}, 0)


def test_pack(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 120) for _ in range(500)] + [64] * 700 + [0, None, 100, 1000, 999]
    df = spark.createDataFrame([(i, s, "clash", 1) for i, s in enumerate(sizes)], "doc_id bigint, n bigint, pack_name string, piece int")
    rows = packing.pack(df, "doc_id", "n", [("small", 100), ("large", 300)]).collect()
    for name, capacity in (("small", 100), ("large", 300)):
        own = [r for r in rows if r["pack_name"] == name]
        by_doc, room = {}, {}
        for r in own:
            by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
            if r["container_id"] is not None:
                room.setdefault(r["container_id"], []).append(r["length"])
        assert max(sum(v) for v in room.values()) <= capacity
        assert sorted(room) == list(range(len(room)))
        assert len({(r["container_id"], r["slot"]) for r in own if r["length"]}) == sum(1 for r in own if r["length"])
        for i, s in enumerate(sizes):
            if s is None:
                assert i not in by_doc
                continue
            parts = sorted(by_doc[i])
            assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
            assert sum(p[1] for p in parts) == s
            assert len(parts) == max(1, -(-s // capacity))
        counts = {}
        for r in own:
            if r["length"]:
                counts[r["length"]] = counts.get(r["length"], 0) + 1
        assert len(room) <= best_fit_decreasing(counts, capacity) * 1.02 + 1
    fill = {r["pack_name"]: r for r in packing.fill(packing.pack(df, "doc_id", "n", [("small", 100)])).collect()}
    assert fill["small"]["tokens"] == sum(s for s in sizes if s) and 0 <= fill["small"]["unused_share"] < 0.3
    assert packing.pack(df.limit(0), "doc_id", "n", [("small", 100)]).count() == 0
    # A capacity of any size: only lengths that occur make runs.
    assert packing.pack(df, "doc_id", "n", [("x", 10**12)]).agg(F.max("container_id")).first()[0] == 0


def test_blocks_of_ranks(spark, monkeypatch):
    """Items of one length over several blocks, in runs that begin and end anywhere in them."""
    monkeypatch.setattr(packing, "BLOCK", 16)
    rows = [(i, 7 if i % 3 else 1 + i % 9) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint")
    packed = packing.pack(df, "doc_id", "n", [("a", 20), ("b", 33)])
    assert [tuple(r)[2:] for r in packing.checked(packed, "doc_id").collect()] == [(1000, 0, 0, 0)] * 2
    counts = {}
    for _, n in rows:
        counts[n] = counts.get(n, 0) + 1
    for r in packing.fill(packed).collect():
        assert r["containers"] == packing.place_runs(counts, r["capacity"])[1]


def test_checked_finds_faults(spark):
    rows = [("a", 10, 0, 1, 0, 0, 6), ("a", 10, 0, 2, 0, 0, 5), ("a", 10, 1, 3, 0, 0, 2), ("a", 10, 2, 3, 1, 10, 2), ("a", 10, 3, 4, 1, 10, 4)]
    df = spark.createDataFrame(rows, "pack_name string, capacity bigint, container_id bigint, doc_id bigint, piece int, start bigint, length bigint")
    assert tuple(packing.checked(df, "doc_id").first()) == ("a", 10, 4, 1, 2, 1)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), min_size=20, max_size=40), st.integers(50, 3000))
def test_knapsack_over_many_kept_states(counts, budget):
    chosen = mixing.knapsack(counts, budget)
    assert all(0 < n <= counts[length] for length, n in chosen.items())
    reach = 1
    for length, n in counts.items():
        for _ in range(n):
            reach |= reach << length
    want = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    assert sum(length * n for length, n in chosen.items()) == want


def test_ranks(spark):
    df = spark.createDataFrame([("hot", i % 50) for i in range(2000)] + [("b", 1), (None, 1), (None, 1)], "g string, k int")
    got = {}
    for r in seeded_ranks(df, ["g"], ["k"], parts=8).collect():
        got.setdefault(r["g"], []).append(r["rank"])
    assert {g: sorted(v) for g, v in got.items()} == {"hot": list(range(2000)), "b": [0], None: [0, 1]}
    one = [tuple(r) for r in seeded_ranks(df.where("g = 'hot'").distinct(), ["g"], ["k"], seed=1).orderBy("k").collect()]
    assert one == [tuple(r) for r in seeded_ranks(df.where("g = 'hot'").distinct(), ["g"], ["k"], seed=1).orderBy("k").collect()]
    assert one != [tuple(r) for r in seeded_ranks(df.where("g = 'hot'").distinct(), ["g"], ["k"], seed=2).orderBy("k").collect()]


def sums(counts):
    reach = {0}
    for length, n in counts.items():
        reach = {a + k * length for a in reach for k in range(n + 1)}
    return reach


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 200), st.integers(0, 3))
def test_knapsack_is_exact(counts, budget, seed):
    chosen = mixing.knapsack(counts, budget, seed)
    assert all(0 < n <= counts[length] for length, n in chosen.items())
    assert sum(length * n for length, n in chosen.items()) == max(s for s in sums(counts) if s <= budget)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 5), min_size=1, max_size=6), st.integers(0, 400))
def test_fit_budget_reaches_what_can_be_reached(counts, budget):
    chosen = mixing.fit_budget(counts, budget)
    assert all(0 < n <= counts[length] for length, n in chosen.items())
    # The last attempt is the exact program over everything.
    assert sum(length * n for length, n in chosen.items()) == max(s for s in sums(counts) if s <= budget)


def test_large_budget_stays_even_and_exact():
    rng = random.Random(3)
    counts = {length: rng.randint(1, 4000) for length in range(5, 900)}
    total = sum(length * n for length, n in counts.items())
    for share in (0.1, 0.5, 0.97):
        chosen = mixing.fit_budget(counts, int(total * share))
        assert sum(length * n for length, n in chosen.items()) == int(total * share)
        docs = sum(chosen.values()) / sum(counts.values())
        assert abs(docs - share) < 0.05


def test_plan_respects_caps():
    counts = {"a": {10: 100}, "b": {7: 3, 5: 2}}
    total, plan = mixing.plan_mix([("a", 0.5, 4), ("b", 0.5, 4), ("c", 0.0, 4)], counts)
    assert total == 248 and plan["b"] == (124, 4, {})
    assert plan["a"][0] == 124 and plan["a"][1] == 0 and sum(k * n for k, n in plan["a"][2].items()) == 120
    assert mixing.plan_mix([("a", 0.5, 1), ("gone", 0.5, 9)], counts)[0] == 0
    _, forced = mixing.plan_mix([("a", 0.5, 1), ("b", 0.5, 2)], counts, total=10_000)
    assert forced["b"][1:] == (2, {}) and forced["a"][1:] == (1, {})


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "tiny", None, "other"]), rng.choice([0, None, 3, 9, 17, 40, 41]), "clash") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint, mix_name string")
    targets = spark.createDataFrame([("m", "big", 0.5, 2), ("m", "mid", 0.3, 2), ("m", "tiny", 0.2, 3), ("solo", "big", 1.0, 1), ("none", "absent", 1.0, 1), ("m", None, 0.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    records, plan = mixing.mix(docs, "doc_id", "source", "n", targets)
    got = records.collect()
    size = {r[0]: r[2] for r in rows}
    source = {r[0]: r[1] for r in rows}
    assert len({(r["mix_name"], r["doc_id"]) for r in got}) == len(got)
    for r in got:
        assert r["n_tokens"] == size[r["doc_id"]] and r["source"] == source[r["doc_id"]]
    assert {(r["mix_name"], r["source"], r["uses"]) for r in got if r["uses"] > {"big": 2, "mid": 2, "tiny": 3}[r["source"]]} == set()
    report = {(r["mix_name"], r["source"]): r for r in mixing.shares(records, plan).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(report["m", s]["share"] - share) < 0.002
        assert report["m", s]["budget"] - report["m", s]["tokens"] < 41
    assert report["solo", "big"]["tokens"] == sum(v for k, v in size.items() if v and source[k] == "big")
    assert report["none", "absent"]["tokens"] == 0 and report["none", "absent"]["share"] is None
    again = mixing.mix(docs.repartition(7), "doc_id", "source", "n", targets)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.mix(docs.limit(0), "doc_id", "source", "n", targets)[0].count() == 0
    assert mixing.mix(docs, "doc_id", "source", "n", targets.limit(0))[0].count() == 0
    assert list(itertools.islice(mixing.mix(docs, "doc_id", "source", "n", targets, seed=9)[0].toLocalIterator(), 1))
