import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerloom.session import session  # noqa: E402

DATA = os.environ.get("LEDGERLOOM_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session("tests", cores="4", spark__sql__shuffle__partitions="4", spark__driver__memory="3g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")), spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture(scope="session")
def data():
    return DATA


TABLES = ("amazon_sales", "sales_raw", "task_2_2", "city_list", "state_list", "promotion_list", "documents", "mix_targets", "pack_sizes", "orders", "lineitem", "customer", "nation")
#: Names that operators use inside or give to their results.
CLASHES = ("n", "m", "s1", "value", "pos", "error", "reasons", "bin", "digit", "prefix", "rank", "targets", "load_rows", "measure", "share", "units", "day", "level", "idx", "shard", "piece", "start", "length", "uses", "label", "stretches", "hashes", "registers", "grouping", "identifier", "_h", "_e", "_p", "_line", "_value", "_key", "_listed", "_exact", "_name", "tag", "average", "is_listed", "container_id", "budget", "capacity")


@pytest.fixture(scope="session")
def variants(spark, data, tmp_path_factory):
    """Folders of the tables: without rows, with nulls in every column, and with extra columns of clashing names."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("variants")
    for name in TABLES:
        df = spark.read.parquet(f"{data}/{name}.parquet")
        df.limit(0).write.parquet(f"{root}/empty/{name}.parquet")
        key = {"amazon_sales": "row_id", "sales_raw": "row_id", "documents": "doc_id"}.get(name)
        holes = [F.when(F.pmod(F.xxhash64(F.lit(i), *df.columns), F.lit(7)) != 0, F.col(c)).alias(c) if c != key else F.col(c) for i, c in enumerate(df.columns)]
        df.select(*holes).write.parquet(f"{root}/nulls/{name}.parquet")
        extra = [F.lit("clash").alias(c) for c in CLASHES if c not in df.columns]
        df.select(*df.columns, *extra).write.parquet(f"{root}/extra/{name}.parquet")
    return str(root)
