import datetime

from pyspark.sql import functions as F

from ledgerloom.operators import rolling
from ledgerloom.streaming import tree_store

SCHEMA = "state string, d date, u bigint"
D0 = datetime.date(2024, 1, 1)


def test_stream_keeps_trees_up_to_date(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    batches = [[("a", D0, 5), ("b", D0, 1)], [("a", D0 + datetime.timedelta(40), 7)], [("a", D0 + datetime.timedelta(1), -2)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        tree_store.start(stream, store, str(tmp_path / "checkpoint"), ["state"], lambda: F.col("d"), lambda: F.col("u")).awaitTermination()
        seen = [r for b in batches[: k + 1] for r in b]
        want = rolling.rolling_totals(spark.createDataFrame(seen, SCHEMA), ["state"], F.col("d"), F.col("u"))
        got = rolling.answers(tree_store.read_nodes(spark, store, ["state"]), ["state"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # A replayed batch changes nothing.
    tree_store.tree_sink(store, ["state"], lambda: F.col("d"), lambda: F.col("u"))(spark.createDataFrame(batches[2], SCHEMA), 2)
    assert sorted(map(tuple, rolling.answers(tree_store.read_nodes(spark, store, ["state"]), ["state"]).collect())) == sorted(map(tuple, want.collect()))
    tree_store.compact(spark, store, str(tmp_path / "new"), ["state"])
    assert sorted(map(tuple, tree_store.read_nodes(spark, str(tmp_path / "new"), ["state"]).collect())) == sorted(map(tuple, tree_store.read_nodes(spark, store, ["state"]).collect()))


def test_window_counts(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    counts = tree_store.window_counts(stream, "ts", ["event_type"], "1 day", "1 day", "400 days")
    q = counts.writeStream.format("memory").queryName("window_counts").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r["window_start"], r["event_type"]): r["n"] for r in spark.table("window_counts").collect()}
    want = {(r["window"]["start"], r["event_type"]): r["count"] for r in events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day"), "event_type").count().collect()}
    assert got == want


def test_core_does_not_import_the_subpackage():
    import pathlib
    import re

    import ledgerloom

    root = pathlib.Path(ledgerloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", p.read_text()), p
