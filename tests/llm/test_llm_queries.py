"""The subpackage's queries over the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.llm import queries as Q
from ledgerloom.llm import tokens


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_runs(spark, data, name):
    assert entry.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("task_2_2", "amazon_sales", "documents", "pack_sizes", "mix_targets"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    mine = Q.QUERIES[name](spark, data).toPandas()
    want = con.sql(Q.SQL[name]).df()[list(mine.columns)]
    key = lambda d: sorted((tuple(None if v != v else v for v in r) for r in d.astype(object).itertuples(index=False)), key=repr)
    assert key(mine) == key(want)


def test_found_columns(spark, data):
    assert Q.p4_found(spark, data).dtypes == [("row_id", "bigint"), ("field_name", "string"), ("entry_id", "bigint")]
    assert Q.p10_found(spark, data).dtypes == [("doc_id", "bigint"), ("lang", "string")]


def test_distinct_against_exact_counts(spark, data):
    exact = {}
    for r in spark.read.parquet(f"{data}/amazon_sales.parquet").selectExpr("upper(trim(category)) AS c", "nullif(trim(sku), '') AS s").where("s IS NOT NULL").distinct().collect():
        exact[r["c"] or None] = exact.get(r["c"] or None, 0) + 1
    got = {r["category"]: r for r in Q.p6_distinct(spark, data).where("grouping = 'category' AND identifier = 'sku'").collect()}
    assert {k: r["listed_count"] for k, r in got.items()} == exact


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("word " * 50_000,)], "t string")
    got = [r[0] for r in df.select(tokens.token_counter()("t")).collect()]
    assert got[:3] == [2, 0, None] and got[3] > 1 and got[4] >= 50_000
