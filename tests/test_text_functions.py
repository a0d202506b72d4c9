import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

CASES = [
    # value, trimmed text, int, double, date, boolean
    (None, None, None, None, None, None),
    ("", None, None, None, None, None),
    (" \t\x00 ", None, None, None, None, None),
    ("\t7 ", "7", 7, 7.0, None, None),
    ("+5", "+5", 5, 5.0, None, None),
    ("1.0", "1.0", None, 1.0, None, None),
    (".5", ".5", None, 0.5, None, None),
    ("5.", "5.", None, 5.0, None, None),
    (".", ".", None, None, None, None),
    ("1e3", "1e3", None, None, None, None),
    ("NaN", "NaN", None, None, None, None),
    ("99999999999", "99999999999", None, 99999999999.0, None, None),
    ("02-29-24", "02-29-24", None, None, datetime.date(2024, 2, 29), None),
    ("02-30-24", "02-30-24", None, None, None, None),
    ("4-3-22", "4-3-22", None, None, None, None),
    ("2022-04-03", "2022-04-03", None, None, None, None),
    ("TRUE", "TRUE", None, None, None, True),
    (" false", "false", None, None, None, False),
    ("yes", "yes", None, None, None, None),
    ("x" * 200_000, "x" * 200_000, None, None, None, None),
]


def test_parsers(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, v string")
    got = df.select("i", X.text("v"), X.parse_int("v"), X.parse_double("v"), X.parse_date("v"), X.parse_boolean("v")).collect()
    for row in got:
        assert tuple(row[1:]) == CASES[row[0]][1:], CASES[row[0]][0]


@pytest.mark.parametrize(("value", "units"), [("289.00", 2890000), ("5.", 50000), (".5", 5000), ("-1.25", -12500), ("1e3", None), ("", None), ("9" * 30, None), ("1.23450", 12345), ("1.23456", None), (".00001", None)])
def test_units(spark, value, units):
    assert spark.createDataFrame([(value,)], "v string").select(X.parse_units("v")).first()[0] == units


@pytest.mark.parametrize(("value", "amount"), [("289.00", "289.00000000"), ("1000000000000000", "1000000000000000.00000000"), ("1.23456", "1.23456000"), ("1e3", None), ("9" * 21, None)])
def test_exact(spark, value, amount):
    got = spark.createDataFrame([(value,)], "v string").select(X.parse_exact("v").cast("string")).first()[0]
    assert got == amount


def test_postal_form_items_lookup(spark):
    df = spark.createDataFrame([("411038.0", "R19-0283-5 ab", "P1, P2,,P1 "), ("411038", "é9É", None), (None, None, "")], "p string, f string, l string")
    rows = df.select(X.postal_code("p"), X.written_form("f"), X.list_items("l")).collect()
    assert [r[0] for r in rows] == ["411038", "411038", None]
    assert [r[1] for r in rows] == ["A9-9-9 aa", "a9A", None]
    assert [r[2] for r in rows] == [["P1", "P2", "P1"], [], []]
    looked = df.select(X.lookup(F.col("p"), {"411038": 1, "x": 2})).collect()
    assert [r[0] for r in looked] == [None, 1, None]


def test_fixed_decimals(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert [r[0] for r in df.select(X.fixed_decimals("v", 6)).collect()] == ["1.000000", None]
