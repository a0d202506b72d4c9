import csv

import pytest

from ledgerloom.__main__ import main
from ledgerloom.sources.sales import HEADER, SALES_COLUMNS


@pytest.fixture(scope="module")
def source(spark, data, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "sales.csv"
    rows = spark.read.parquet(f"{data}/amazon_sales.parquet").select(*SALES_COLUMNS).collect()
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(HEADER)
        out.writerows([["" if v is None else " ".join(v.split()) for v in r] for r in rows])
        f.write("one,field,too,few\n")
    return str(path)


def test_outputs(spark, source, tmp_path, capsys):
    assert main(["window-winner", source, f"{tmp_path}/q1.csv"], spark) == 0
    with open(tmp_path / "q1.csv", encoding="utf-8") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == ["state", "window_date", "size", "purchase_count", "population_variance"]
    assert [(r["state"], r["window_date"]) for r in rows] == sorted((r["state"], r["window_date"]) for r in rows)
    out = capsys.readouterr().out
    assert "MALFORMED_ROWS=1" in out and f"OUTPUT_ROWS={len(rows)}" in out
    told = dict(x.split("=") for x in out.split())
    states = [x.split("\t") for x in (tmp_path / "q1.csv.states.tsv").read_text(encoding="utf-8").splitlines()]
    assert sum(int(n) for _, n in states) == int(told["INPUT_BOUGHT_ROWS"]) > int(told["INPUT_INVALID_FIELDS"]) > 0
    assert int(told["BUCKETS_EMITTED"]) == 10 * (int(told["INPUT_BOUGHT_ROWS"]) - int(told["INPUT_INVALID_FIELDS"]))
    for scope in ("global", "local"):
        assert main(["median-variety", source, f"{tmp_path}/q2.csv", scope], spark) == 0
        with open(tmp_path / "q2.csv", encoding="utf-8") as f:
            rows = list(csv.DictReader(f))
        told = dict(x.split("=") for x in capsys.readouterr().out.split())
        assert int(told["ELIGIBLE_STYLES"]) > 0 and int(told["OUTPUT_ROW_COUNT"]) == len(rows) and int(told["INPUT_WHOLE_ROWS"]) + int(told["INPUT_INVALID_ROWS"]) == int(told["INPUT_ROW_COUNT"])
        assert {r["eligibility_scope"] for r in rows} == {scope} and all(r["median_variety"].endswith((".0", ".5")) for r in rows)
    assert main(["city-share", source, f"{tmp_path}/q3.parquet"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/q3.parquet").columns == ["ship_city", "cancelled_standard_order_count", "qualifying_order_count", "qualifying_percentage"]
    assert main(["compare-plans", source], spark) == 0
    assert "BROADCAST_BROADCAST_HASH_JOINS=3" in capsys.readouterr().out
    assert main(["thresholds", source, f"{tmp_path}/q4.parquet"], spark) == 0
    q4 = spark.read.parquet(f"{tmp_path}/q4.parquet")
    assert q4.columns == ["sku", "month", "method", "percentile", "threshold", "total_order_count", "qualifying_order_count", "qualifying_amount_count", "amount_stddev_pop"]
    out = capsys.readouterr().out
    assert "INVALID_ROWS=0" in out and "APPROX_MEAN_SECONDS=" in out and "FITS_PARTITION=True" in out
    assert main(["profile", source, f"{tmp_path}/p.md"], spark) == 0
    text = (tmp_path / "p.md").read_text()
    assert "## Missing values" in text and "## Largest SKU and month" in text
    assert main(["lines", source], spark) == 0
    with open(source, encoding="utf-8") as f:
        assert f"LINES={sum(1 for _ in f)}" in capsys.readouterr().out
    assert main(["round-trip", source, f"{tmp_path}/copies"], spark) == 0


def test_arguments(spark, source, tmp_path):
    assert main([], spark) == main(["nothing"], spark) == main(["lines"], spark) == 2
    assert main(["median-variety", source, f"{tmp_path}/x.csv", "elsewhere"], spark) == 2
    assert main(["thresholds", source, f"{tmp_path}/x.parquet", "4"], spark) == 2


