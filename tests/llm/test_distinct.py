import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import distinct as D

RNG = np.random.default_rng(1)


def registers(hashes):
    r = np.full((1, D.M), np.inf, np.float32)
    D.add_hashes(r, np.zeros(len(hashes), np.int64), hashes)
    return r[0]


def some(n):
    return RNG.integers(0, 2**48, n).astype(np.uint64)


def test_unbiased_with_stated_error():
    errors, inside = [], 0
    for _ in range(150):
        n = int(RNG.integers(1100, 40_000))
        count, low, high = D.estimate(registers(some(n)).sum(dtype=float))
        errors.append(count / n - 1)
        inside += low <= n <= high
    assert abs(np.mean(errors)) < 4 / np.sqrt((D.M - 2) * 150)
    assert np.std(errors) < 1.25 / np.sqrt(D.M - 2)
    assert inside / 150 > 0.88


def test_merge_is_minimum_and_repeats_change_nothing():
    a, b = some(5000), some(3000)
    both = registers(np.concatenate([a, b, a]))
    assert (np.minimum(registers(a), registers(b)) == both).all()
    halves = np.full((1, D.M), np.inf, np.float32)
    for part in np.array_split(np.concatenate([b, a]), 7):
        D.add_hashes(halves, np.zeros(len(part), np.int64), part)
    assert (halves[0] == both).all()


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_small_groups_are_unbiased_within_bounds(n):
    groups = 600
    hashes = some(groups * n)
    s = D.Sketches(np.repeat(np.arange(groups), n), hashes)
    names, listed, sums = s.sums()
    assert names.tolist() == list(range(groups)) and set(listed.to_pylist()) == {n}
    found = np.array([D.estimate(x) for x in sums])
    assert abs(found[:, 0].mean() / n - 1) < 4 / np.sqrt((D.M - 2) * groups)
    assert ((found[:, 1] <= n) & (n <= found[:, 2])).mean() > 0.92
    # The sums of listed sketches are those of the registers their hashes fill.
    r = np.full((groups, D.M), np.inf, np.float32)
    D.add_hashes(r, np.repeat(np.arange(groups), n), hashes)
    assert np.allclose(r.sum(1, dtype=float), sums, rtol=5e-4)


def test_rounded_registers_keep_their_order_and_sum():
    a, b = registers(some(3000)), registers(some(3000))
    assert (np.minimum(D.packed(a), D.packed(b)) == D.packed(np.minimum(a, b))).all()
    assert abs(D.unpacked(D.packed(a)).sum(dtype=float) / a.sum(dtype=float) - 1) < 2.0**-13
    assert np.isinf(D.unpacked(D.packed(np.array([np.inf])))).all()


def test_sketches_survive_their_written_form():
    groups = np.concatenate([np.zeros(5, int), np.full(D.LIMIT + 3, 4), np.full(D.LIMIT, 7)])
    s = D.Sketches(groups, some(len(groups)))
    names, lists, registers = s.arrays()
    assert names.tolist() == [0, 7, 4] and [x is None for x in lists.to_pylist()] == [False, False, True]
    hashes, sizes = D._hashes(lists)
    data, lengths = D._bytes(registers)
    again = D.Sketches(np.repeat(names, sizes), hashes, names[lengths > 0], D.unpacked(data.view("<u2")).reshape(-1, D.M))
    assert (again.hashes == s.hashes).all() and (again.registers == s.registers).all()


def test_registers_are_exponential():
    """The mean of N * register is 1 and its variance 1, as for independent exponentials."""
    n = 2000
    x = np.concatenate([registers(some(n)) * n for _ in range(30)])
    assert abs(x.mean() - 1) < 0.05 and abs(x.var() - 1) < 0.1


SCHEMA = "load_id bigint, day string, state string, sku string, hashes string, registers int, grouping string"
SETS = [("day",), ("state",), ("day", "state")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def counted(spark, df, repartition=3, **kw):
    sketches = D.partial_sketches(df.repartition(repartition), ["load_id"], ["day", "state"], {"sku": F.col("sku")}, SETS, **kw)
    return {tuple(r)[:3]: r for r in D.counts(sketches, ["day", "state"]).collect()}


def brute(rows):
    out = {}
    for _, day, state, sku in rows:
        for s in SETS:
            if sku is not None:
                out.setdefault((",".join(s), day if "day" in s else None, state if "state" in s else None), set()).add(sku)
    return {k: len(v) for k, v in out.items()}


def check(got, want):
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert r["listed_count"] == (want[k] if want[k] <= D.LIMIT else None)
        assert abs(r["distinct_count"] / want[k] - 1) < 5 / np.sqrt(D.M - 2)
        assert r["low"] < r["distinct_count"] < r["high"]


def test_groups(spark):
    rng = random.Random(2)
    rows = [(rng.randint(1, 4), rng.choice(["d1", "d1", "d2", None]), rng.choice(["A", "B", None]), rng.choice([None, *(f"s{i}" for i in range(300))])) for _ in range(4000)]
    # One state holds most rows and more identifiers than a list may hold.
    rows += [(rng.randint(1, 4), "d3", "HOT", f"h{rng.randint(0, 20_000)}") for _ in range(12_000)]
    rows += [(1, "d4", "EDGE", f"e{i}") for i in range(D.LIMIT)] * 2 + [(1, "d5", "OVER", f"e{i}") for i in range(D.LIMIT + 1)]
    check(counted(spark, frame(spark, rows)), brute(rows))


def test_small_chunks_and_batches_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, rng.choice(["a", "b"]), "S", f"x{rng.randint(0, 3000)}") for _ in range(6000)]
    df = frame(spark, rows)
    one = counted(spark, df, 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        many = counted(spark, df, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: r["distinct_count"] for k, r in one.items()} == pytest.approx({k: r["distinct_count"] for k, r in many.items()}, rel=1e-5)


def test_loads_may_be_stored_and_merged_later(spark, tmp_path):
    rng = random.Random(4)
    rows = [(load, "d", "S", f"x{rng.randint(0, 2500)}") for load in (1, 2, 3) for _ in range(2500)]
    for load in (1, 2, 3):
        part = D.partial_sketches(frame(spark, [r for r in rows if r[0] == load]), ["load_id"], ["day", "state"], {"sku": F.col("sku")}, SETS)
        part.write.parquet(f"{tmp_path}/{load}")
    stored = spark.read.parquet(*[f"{tmp_path}/{k}" for k in (1, 2, 3)])
    got = {tuple(r)[:3]: r for r in D.counts(stored, ["day", "state"]).collect()}
    check(got, brute(rows))
    whole = counted(spark, frame(spark, rows))
    assert {k: r["distinct_count"] for k, r in got.items()} == pytest.approx({k: r["distinct_count"] for k, r in whole.items()}, rel=1e-5)
    # Merged sketches are sketches: merged once more they count the same.
    merged = D.merge_sketches(stored, ["day", "state"])
    assert {tuple(r)[:3]: r for r in D.counts(merged, ["day", "state"]).collect()} == got


@pytest.mark.parametrize("held", [1, 20_000, 1 << 30])
def test_chunks_of_a_partition_are_folded(spark, held):
    rng = random.Random(6)
    rows = [(1, rng.choice(["a", "b"]), rng.choice(["S", "T"]), f"x{rng.randint(0, 900)}") for _ in range(1500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        check(counted(spark, frame(spark, rows), 2, rows_at_once=50, bytes_held=held), brute(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_null(spark):
    assert counted(spark, frame(spark, [])) == {}
    assert counted(spark, frame(spark, [(1, "d", "S", None)])) == {}
    assert counted(spark, frame(spark, [(1, "d", "S", "x" * 100_000), (1, "d", "S", "")]))["day", "d", None]["listed_count"] == 2


def test_codes_tell_nulls_apart():
    code, _ = D._codes([pa.array(["a", None, "a", ""]), pa.array([1, 1, None, 1])])
    assert len(set(code.tolist())) == 4
