import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.packed_values import needs_alternative, parse_packed, unpack

LIST = ["A1", "Fee B2", "Quiet Kite: zone 55, wave 3", "Coupon;F2", "Kite|XZ96", 'Pack "Loom" x48', "XA Market 2024/04/01 18-25", "off_93%"]

CASES = [
    (None, []),
    ("", []),
    (" \t\n", []),
    (",;|", []),
    ("A1", ["A1"]),
    ("A1,Fee B2", ["A1", "Fee B2"]),
    ("A1 ; Fee B2|off_93%\tA1\r\nA1", ["A1", "Fee B2", "off_93%", "A1", "A1"]),
    ("A1 / Fee B2 / A1", ["A1", "Fee B2", "A1"]),
    ("XA Market 2024/04/01 18-25 / A1", ["XA Market 2024/04/01 18-25", "A1"]),
    ("A1,,  ,Fee B2,", ["A1", "Fee B2"]),
    ('"Quiet Kite: zone 55, wave 3",A1', ["Quiet Kite: zone 55, wave 3", "A1"]),
    ('A1, "Pack ""Loom"" x48" ,A1', ["A1", 'Pack "Loom" x48', "A1"]),
    ('["A1", "Pack \\"Loom\\" x48", "Coupon;F2"]', ["A1", 'Pack "Loom" x48', "Coupon;F2"]),
    ("[A1]", ["A1"]),
    ('"",A1," ",\'\'', ["A1"]),
    ('A1,"""",Fee B2', ["A1", '"', "Fee B2"]),
    ("['A1','Kite|XZ96']", ["A1", "Kite|XZ96"]),
    # Unquoted values that hold delimiters are taken whole where they are listed.
    ("A1,Quiet Kite: zone 55, wave 3,Coupon;F2", ["A1", "Quiet Kite: zone 55, wave 3", "Coupon;F2"]),
    # Spelling of the list.
    ("a1,FEE  b2", ["A1", "Fee B2"]),
]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(v,) for v in LIST], "promotion_id string")


def test_cases(spark, listed):
    # `pos`, `value` and `error` of the input are other columns and must not interfere.
    df = spark.createDataFrame([(i, c[0], 7, "x", "y") for i, c in enumerate(CASES)], "row_id int, f string, pos int, value string, error string")
    got = {i: [] for i in range(len(CASES))}
    for r in unpack(df, "f", ["row_id"], listed, "promotion_id").orderBy("row_id", "pos").collect():
        assert r["pos"] == len(got[r["row_id"]]) + 1
        assert r["error"] is None
        got[r["row_id"]].append(r["value"])
    for i, (field, values) in enumerate(CASES):
        assert got[i] == values, field


@pytest.mark.parametrize(("field", "values"), [('"A1,Fee B2', ["A1", "Fee B2"]), ('A1",Fee B2', ["A1", "Fee B2"])])
def test_malformed_quotes_backtrack_and_are_flagged(spark, listed, field, values):
    rows = unpack(spark.createDataFrame([(1, field)], "row_id int, f string"), "f", ["row_id"], listed, "promotion_id").orderBy("pos").collect()
    assert [r["value"] for r in rows] == values
    assert [r["error"] for r in rows] == ["unclosed_quote", None]


@pytest.mark.parametrize(
    ("field", "values", "errors"),
    [
        ("A,[B,C],D", ["A", "B", "C", "D"], []),
        ("[A,B],[C]", ["A", "B", "C"], []),
        ("[['x','y'],z]", ["x", "y", "z"], []),
        ("[A]; [B]", ["A", "B"], []),
        ("[A,B", ["A", "B"], ["unclosed_bracket"] * 2),
        ("A],B", ["A", "B"], ["unopened_bracket"] * 2),
        ('"a" "b"', ['"a" "b"'], ["text_after_quote"]),
        ('"a"b,c', ['"a"b', "c"], ["text_after_quote", None]),
        ("A[1], a[b", ["A[1]", "a[b"], []),  # brackets inside a bare value are part of it
        ("[]", [], []),
    ],
)
def test_brackets_and_errors(spark, field, values, errors):
    got = spark.createDataFrame([(field,)], "f string").select(parse_packed(F.col("f")).alias("p")).first()["p"]
    assert [v["value"] for v in got] == values
    assert [v["error"] for v in got] == (errors or [None] * len(values))


def test_without_list_and_empty(spark):
    df = spark.createDataFrame([(1, 'x;"y;z"')], "row_id int, f string")
    assert [(r["pos"], r["value"], r["is_listed"]) for r in unpack(df, "f", ["row_id"]).orderBy("pos").collect()] == [(1, "x", None), (2, "y;z", None)]
    assert unpack(df.limit(0), "f", ["row_id"]).count() == 0


def test_column_form_is_the_same(spark, listed):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "row_id int, f string")
    rows = unpack(df, "f", ["row_id"]).select("row_id", "pos", "value", "error").collect()
    packed = df.select("row_id", F.explode(parse_packed(F.col("f"))).alias("x")).select("row_id", "x.*").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, packed), key=repr)


def test_very_long_field(spark):
    n = 30_000
    field = ",".join(f'"v{i};"""' for i in range(n)) + "," + "x" * 300_000
    rows = unpack(spark.createDataFrame([(1, field)], "row_id int, f string"), "f", ["row_id"]).orderBy("pos").collect()
    assert len(rows) == n + 1
    assert rows[n - 1]["value"] == f'v{n - 1};"'


def test_round_trip(spark, listed):
    """Random lists written in random styles come back."""
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(300):
        values = [rng.choice(LIST) for _ in range(rng.randint(1, 9))]
        style = rng.randint(0, 2)
        if style == 0:
            field = "[" + ", ".join('"' + v.replace('"', '\\"') + '"' for v in values) + "]"
        else:
            parts = []
            for v in values:
                parts.append('"' + v.replace('"', '""') + '"' if needs_alternative(v) or rng.random() < 0.3 else v)
                parts.append(rng.choice([",", ", ", " ;", "|", " | ", "\t", "\n", "\r\n", " / ", ",,"]))
            field = "".join(parts[: -1 if style == 1 else None])
        rows.append((i, field))
        want[i] = values
    got = {i: [] for i in want}
    for r in unpack(spark.createDataFrame(rows, "row_id int, f string"), "f", ["row_id"], listed, "promotion_id").orderBy("row_id", "pos").collect():
        got[r["row_id"]].append(r["value"])
    assert got == want
