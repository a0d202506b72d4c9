import math
import statistics

from pyspark.sql import functions as F

from ledgerloom.operators import load_profile as P
from ledgerloom.plans import core_problems

SCHEMA = "load_id bigint, status string, oid string, idx string, amount string, n int, value string, measure string"


def rows(load, status, oid, idx, amount="1.00"):
    return (load, status, oid, idx, amount, 0, "v", "m")


def found(df, **kw):
    return {tuple(r)[:3] for r in P.changed_loads(df, "load_id", ["status"], ["oid", "idx"], ["idx"], **kw).collect()}


def table():
    out, k = [], 0
    for load in range(1, 10):
        for i in range(20):
            k += 1
            status = "ok" if i < 14 else "bad"
            oid, idx = f"A-{k}", str(k)
            if load == 3 and i < 2:
                status = None  # exactly ten points more blanks than the median
            if load == 4 and i < 1:
                status = " \t"  # five points only
            if load == 5 and i < 6:
                status = f"odd{i % 2}"
            if load == 6 and i < 5:
                oid = f"a-{k}"
            if load == 7 and i < 4:
                idx = str(i + 1)
            out.append(rows(load, status, oid, idx))
    return out


def test_changes(spark):
    got = found(spark.createDataFrame(table(), SCHEMA))
    assert got == {
        (3, "status", "blank"), (3, "status", "value=ok"), (5, "status", "value=ok"), (5, "status", "value=odd0"), (5, "status", "value=odd1"), (5, "status", "rare"),
        (6, "oid", "off_form"), (7, "idx", "seen_before"),
    }


def test_column_of_both_kinds(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    both = {tuple(r)[:3] for r in P.changed_loads(df, "load_id", ["status"], ["status", "idx"], ["idx"]).collect()}
    assert (3, "status", "blank") in both and (7, "idx", "seen_before") in both
    alone = {tuple(r)[:3] for r in P.changed_loads(df, "load_id", [], [], ["idx"]).collect()}
    assert alone == {(7, "idx", "seen_before")}


def test_null_load_ties_and_empty(spark):
    df = spark.createDataFrame([rows(None, "x", "1", "1")] + [rows(1, "ok", "A1", "1"), rows(1, "ok", "a1", "2")], SCHEMA)
    # Both forms of oid are equally common: the lesser text, a9 after A9, is off.
    got = P.changed_loads(df, "load_id", ["status"], ["oid"], []).collect()
    assert got == []
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_profile(spark):
    df = spark.createDataFrame([rows(1, "ok", "A1", "1"), rows(1, "OK ", "A1", None), rows(1, "", "A22", "x"), rows(2, None, None, None)], SCHEMA)
    got = {(r["load_id"], r["column_name"]): r for r in P.profile(df, "load_id", ["status", "oid", "idx"]).collect()}
    s = got[1, "status"]
    assert (s["row_count"], s["blank_count"], s["distinct_count"], s["min_text"], s["max_text"], s["form_count"], s["off_form_count"]) == (3, 1, 2, "OK", "ok", 2, 1)
    o = got[1, "oid"]
    assert (o["common_form"], o["distinct_count"], o["off_form_count"]) == ("A9", 2, 0)
    e = got[2, "status"]
    assert (e["row_count"], e["blank_count"], e["distinct_count"], e["min_text"], e["common_form"], e["off_form_count"]) == (1, 1, 0, None, None, 0)
    assert P.profile(df.limit(0), "load_id", ["status"]).count() == 0


def test_power_sums_merge_and_shift(spark):
    amounts = {1: [1.0, 2.5, -3.25], 2: [100.0, 101.0, 99.5, None], 3: [2.0], 4: [-98765432109.87, 1e13, 12345678.9012, 1e14, 0.00001]}
    df = spark.createDataFrame([rows(k, "x", "x", "x", None if v is None else f"{v:.5f}") for k, vs in amounts.items() for v in vs], SCHEMA)
    sums = P.power_sums(df, "load_id", ["amount"])
    got = {r["load_id"]: r for r in sums.collect()}
    for k, vs in amounts.items():
        units = [round(v * 10**4) for v in vs if v is not None and v < 1e14 and v != 0.00001]
        assert got[k]["n"] == len(units) and got[k]["valid"] == sum(v is not None for v in vs)
        exact = lambda r, p: sum(int(r["e%d%d%d" % e]) * math.factorial(p) // math.prod(map(math.factorial, e)) * P.LIMB ** (e[1] + 2 * e[2]) for e in P.MONOMIALS if sum(e) == p)
        assert [exact(got[k], p) for p in range(1, 5)] == [sum(u**p for u in units) for p in range(1, 5)]
    assert (got[4]["lo"], got[4]["hi"]) == (-98765432109.87, 1e14)
    assert math.isclose(got[4]["b2"], 1e36 + 0.01, rel_tol=1e-12)
    merged = P.merge_power_sums(sums, ["column_name"]).first()
    whole = P.merge_power_sums(P.power_sums(df.withColumn("load_id", F.lit(1)), "load_id", ["amount"]), ["column_name"]).first()
    assert tuple(merged) == tuple(whole)
    shift = {r["load_id"]: r for r in P.standardised_shift(sums.where("load_id < 4")).collect()}
    rest = [1.0, 2.5, -3.25, 2.0]
    own = [100.0, 101.0, 99.5]
    pooled = ((statistics.pvariance(own) + statistics.pvariance(rest)) / 2) ** 0.5
    assert abs(shift[2]["shift"] - (statistics.mean(own) - statistics.mean(rest)) / pooled) < 1e-9
    assert shift[3]["shift"] is None and shift[3]["skewness"] is None
    sd = statistics.pstdev([1.0, 2.5, -3.25])
    assert abs(shift[1]["stddev"] - sd) < 1e-9
    assert abs(shift[1]["skewness"] - sum((v - 0.25 / 3) ** 3 for v in [1.0, 2.5, -3.25]) / 3 / sd**3) < 1e-6
    assert P.standardised_shift(P.power_sums(df.limit(0), "load_id", ["amount"])).count() == 0


def test_whole_shift_keeps_large_values(spark):
    # One large value, a load wholly beyond the limit, a value beyond a bigint, and a huge one whose square must not swallow the other loads' sums.
    amounts = {1: [1.0, 2.5, 270451.47], 2: [500000.25, 600000.5, 700000.0], 3: [3.0, 4.5, 1e13], 4: [5.0, 1e21], 5: [1.5, 2.0]}
    for loads in ((1, 2, 5), (1, 2, 3, 5), (1, 2, 3, 4, 5)):
        df = spark.createDataFrame([rows(k, "x", "x", "x", f"{v:.2f}") for k in loads for v in amounts[k]], SCHEMA)
        sums = P.power_sums(df, "load_id", ["amount"])
        assert {r["load_id"]: r["valid"] for r in sums.collect()} == {k: len(amounts[k]) for k in loads}
        got = {r["load_id"]: r for r in P.standardised_shift(sums).collect()}
        for k in loads:
            own, rest = amounts[k], [v for j in loads if j != k for v in amounts[j]]
            pooled = ((statistics.pvariance(own) + statistics.pvariance(rest)) / 2) ** 0.5
            want = (statistics.fmean(own), statistics.pstdev(own), (statistics.fmean(own) - statistics.fmean(rest)) / pooled)
            for c, w in zip(("mean", "stddev", "shift"), want):
                assert math.isclose(got[k][c], w, rel_tol=1e-9), (loads, k, c)
        own = amounts[2]
        third = sum((v - statistics.fmean(own)) ** 3 for v in own) / 3
        assert math.isclose(got[2]["skewness"], third / statistics.pstdev(own) ** 3, rel_tol=1e-6)


def test_registered_shift_keeps_large_values(spark, tmp_path):
    df = spark.createDataFrame([(1, "1.00", "1"), (1, "270451.47", "2"), (2, "5.00", "3"), (2, "7.00", "99999999999")], "load_id bigint, amount string, quantity string")
    df.write.parquet(f"{tmp_path}/amazon_sales.parquet")
    got = {(r["load_id"], r["column_name"]): r["mean"] for r in core_problems.p7_numeric_shift(spark, str(tmp_path)).collect()}
    assert got == {(1, "amount"): 135226.235, (2, "amount"): 6.0, (1, "quantity"): 1.5, (2, "quantity"): 50000000001.0}


def test_registered_changes_cover_every_column(spark, tmp_path):
    from ledgerloom.sources.sales import SALES_COLUMNS

    k, table = 0, []
    for load in range(1, 8):
        for i in range(20):
            k += 1
            row = dict.fromkeys(SALES_COLUMNS, "x") | {"order_id": f"A-{k}", "source_index": str(k)}
            changed = {2: ("category", None), 3: ("currency", "usd"), 4: ("ship_state", "X"), 5: ("courier_status", "sent"), 6: ("promotion_ids", ""), 7: ("sku", "hot-1")}
            if load in changed and i < 3:
                row[changed[load][0]] = changed[load][1]
            table.append((load, *row.values()))
    df = spark.createDataFrame(table, "load_id bigint, " + ", ".join(f"{c} string" for c in SALES_COLUMNS))
    df.write.parquet(f"{tmp_path}/amazon_sales.parquet")
    got = {(r["load_id"], r["column_name"], r["measure"]) for r in core_problems.p7_column_changes(spark, str(tmp_path)).collect()}
    lost = {(load, c, "value=x") for load, c in ((2, "category"), (3, "currency"), (4, "ship_state"), (5, "courier_status"), (6, "promotion_ids"), (7, "sku"))}
    new = {(load, c, m) for load, c, v in ((3, "currency", "usd"), (4, "ship_state", "X"), (5, "courier_status", "sent"), (7, "sku", "hot-1")) for m in (f"value={v}", "rare", "off_form")}
    assert got == lost | new | {(2, "category", "blank"), (6, "promotion_ids", "blank")}


def test_registered_ranges_are_numeric(spark, tmp_path):
    table = [(1, "9.50", "1", "7"), (1, "free", " ", "10"), (1, "270451.47", "99999999999", "x"), (1, "-3", "1e3", None), (2, "", "NaN", "100000000000000000000")]
    spark.createDataFrame(table, "load_id bigint, amount string, quantity string, source_index string").write.parquet(f"{tmp_path}/amazon_sales.parquet")
    got = {tuple(r) for r in core_problems.p7_numeric_profile(spark, str(tmp_path)).collect()}
    assert got == {
        (1, "amount", 4, 0, 3, -3.0, 270451.47), (1, "quantity", 4, 1, 2, 1.0, 99999999999.0), (1, "source_index", 4, 1, 2, 7.0, 10.0),
        (2, "amount", 1, 1, 0, None, None), (2, "quantity", 1, 0, 0, None, None), (2, "source_index", 1, 0, 1, 1e20, 1e20),
    }


def test_shift_of_shares(spark):
    df = spark.createDataFrame([rows(k, "ok" if i < (10 if k == 3 else 4) else None, "x", "x") for k in range(1, 5) for i in range(10)], SCHEMA)
    got = {(r["load_id"], r["measure"]): r for r in P.changed_loads(df, "load_id", ["status"], []).collect()}
    pooled = math.sqrt((0 + 0.4 * 0.6) / 2)
    assert math.isclose(got[3, "value=ok"]["shift"], 0.6 / pooled) and math.isclose(got[3, "blank"]["shift"], -0.6 / pooled)
    df = spark.createDataFrame([rows(k, "ok" if k == 2 else None, "x", "x") for k in range(1, 5) for i in range(3)], SCHEMA)
    assert {(r["load_id"], r["measure"], r["shift"]) for r in P.changed_loads(df, "load_id", ["status"], []).collect()} == {(2, "value=ok", math.inf), (2, "blank", -math.inf), (2, "rare", math.inf)}


def test_screen_by_shift_loses_no_case(spark):
    import random

    rng = random.Random(5)
    out = [rows(load, rng.choice(["a", "b"]) if rng.random() < 0.5 + rng.uniform(-0.12, 0.12) else None, "x", "x") for load in range(12) for _ in range(rng.randint(5, 60))]
    share = {m: [sum(1 for r in out if r[0] == k and (r[1] if m is None else r[1] or "") == m) / sum(1 for r in out if r[0] == k) for k in range(12)] for m in ("a", "b", None)}
    want = {(k, "blank" if m is None else f"value={m}") for m, s in share.items() for k, x in enumerate(s) if abs(x - statistics.median(s)) >= 0.1 - 1e-9}
    assert {(r["load_id"], r["measure"]) for r in P.changed_loads(spark.createDataFrame(out, SCHEMA), "load_id", ["status"], []).collect()} == want


def test_pattern_violations(spark):
    df = spark.createDataFrame([rows(1, "x", "A1", "1"), rows(1, "x", "b", "1"), rows(1, "x", " ", "1"), rows(1, "x", None, "1")], SCHEMA)
    r = P.pattern_violations(df, "load_id", {"oid": "^[A-Z][0-9]+$"}).first()
    assert (r["checked"], r["violations"]) == (2, 1)
