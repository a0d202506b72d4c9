import csv
import datetime
import io
import random

from pyspark.sql import functions as F

from ledgerloom.operators import corrupt_rows as C

KINDS = {"quantity": "integer", "amount": "decimal", "order_date": "date"}


def test_values(spark):
    rows = [
        (1, "1", "5.", "02-29-24"),
        (2, None, "", " \t"),
        (3, "+7 ", "-.5", " 01-01-24"),
        (4, "1.0", "1", "01-01-24"),
        (5, "99999999999", "1", "01-01-24"),
        (6, "2", "NaN", "01-01-24"),
        (7, "2", ".", "02-30-24"),
        (8, "½", "1 000", "1-1-24"),
        (9, "-2147483648", "1", "01-01-24"),
        (10, "2147483648", "1", "01-01-24"),
    ]
    df = spark.createDataFrame([(*r, ["kept"]) for r in rows], "row_id int, quantity string, amount string, order_date string, reasons array<string>")
    classified = C.classify_columns(df, KINDS)
    got = {r["row_id"]: r["reasons"] for r in classified.collect()}
    q, a, d = (f"{c}_invalid" for c in ("quantity", "amount", "order_date"))
    assert got == {1: [], 2: [], 3: [], 4: [q], 5: [q], 6: [a], 7: [a, d], 8: [q, a, d], 9: [], 10: [q]}
    valid, rejected = C.split_rows(classified)
    assert {r["row_id"] for r in valid.collect()} == {1, 2, 3, 9}
    assert rejected.count() == 6
    typed = {r["row_id"]: tuple(r)[1:] for r in C.typed(valid, KINDS).collect()}
    assert typed[1] == (1, 5.0, datetime.date(2024, 2, 29))
    assert typed[2] == (None, None, None)


LINES = [
    ("a,b,c", [], ("a", "b", "c")),
    ("", None, None),
    (" \t", None, None),
    (None, None, None),
    ('"a,1","b ""q""",', [], ("a,1", 'b "q"', None)),
    ('a,"b\nc",d', [], ("a", "b\nc", "d")),
    ("a,b", ["field_count_2"], (None, None, None)),
    ("a,b,c,d", ["field_count_4"], (None, None, None)),
    ('a,"b,c', ["quoting_unsound"], (None, None, None)),
    ('a,b"x"b,c', ["quoting_unsound"], (None, None, None)),
    ('a,"b"x,c', ["quoting_unsound"], (None, None, None)),
    ('a, "b",c', ["quoting_unsound"], (None, None, None)),
    ('"""",b,c', [], ('"', "b", "c")),
    (",,", [], (None, None, None)),
]


def test_lines(spark):
    # a, b, c and reasons of the input clash with the line's own names.
    df = spark.createDataFrame([(i, x[0], "other", 1) for i, x in enumerate(LINES)], "row_id int, raw string, a string, reasons int")
    got = {r["row_id"]: r for r in C.parse_lines(df, "raw", ["a", "b", "c"], {}, ["row_id"]).collect()}
    for i, (line, reasons, values) in enumerate(LINES):
        if reasons is None:
            assert i not in got
            continue
        assert got[i]["reasons"] == reasons, line
        assert (got[i]["a"], got[i]["b"], got[i]["c"]) == values, line
        if reasons:
            assert got[i]["corrupt_text"] == line
    assert C.parse_lines(df.limit(0), "raw", ["a"], {}, ["row_id"]).count() == 0


def sound(line: str) -> int | None:
    """Fields of a line by a small state machine, None if the quoting is not sound."""
    i, n = 0, 1
    while True:
        if i < len(line) and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < len(line) and line[i] != ",":
                return None
        else:
            while i < len(line) and line[i] != ",":
                if line[i] == '"':
                    return None
                i += 1
        if i >= len(line):
            return n
        i += 1
        n += 1


def test_against_state_machine(spark):
    rng = random.Random(3)
    lines = ["".join(rng.choice('ab,," \n') for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lines)), "row_id int, raw string")
    for r in df.select("raw", C.sound_quoting(F.col("raw")).alias("s"), C.field_count(F.col("raw")).alias("n")).collect():
        want = sound(r["raw"])
        assert r["s"] == (want is not None), repr(r["raw"])
        if want is not None:
            assert r["n"] == want


def test_written_records_come_back(spark):
    rng = random.Random(4)
    records = [["".join(rng.choice('xyz ,"') for _ in range(rng.randint(1, 6))) or "x" for _ in range(5)] for _ in range(500)]
    lines = []
    for r in records:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(r)
        lines.append(out.getvalue())
    df = spark.createDataFrame(list(enumerate(lines)), "row_id int, raw string")
    for r in C.parse_lines(df, "raw", list("abcde"), {}, ["row_id"]).collect():
        assert r["reasons"] == []
        assert [r[c] for c in "abcde"] == records[r["row_id"]]


def test_long_line_and_many_quotes(spark):
    line = ",".join(['"' + '""' * 50_000 + '"', "x" * 500_000, "c"])
    r = C.parse_lines(spark.createDataFrame([(1, line)], "row_id int, raw string"), "raw", ["a", "b", "c"], {}, ["row_id"]).first()
    assert r["reasons"] == [] and r["a"] == '"' * 50_000 and len(r["b"]) == 500_000
