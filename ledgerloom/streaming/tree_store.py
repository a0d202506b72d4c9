"""A stored set of segment trees kept up to date by a stream: each micro-batch adds its delta nodes, late or not.

The store is a folder of append-only node rows partitioned by batch. A batch writes the ancestors of the days it touches, under its own number, so a
replayed batch overwrites itself and nothing else. Readers sum the nodes; `compact` folds old batches into one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rolling import SUM, daily, tree_nodes


def tree_sink(store: str, entity: Sequence[str], day: Callable[[], Column], amount: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function."""

    def write(batch: DataFrame, number: int) -> None:
        nodes = tree_nodes(daily(batch, entity, day(), amount()), entity)
        nodes.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return write


def start(stream: DataFrame, store: str, checkpoint: str, entity: Sequence[str], day: Callable[[], Column], amount: Callable[[], Column]) -> StreamingQuery:
    """Run `stream` into the store until its present input is used up."""
    return stream.writeStream.foreachBatch(tree_sink(store, entity, day, amount)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_nodes(spark: SparkSession, store: str, entity: Sequence[str]) -> DataFrame:
    """The trees' present nodes."""
    nodes = spark.read.parquet(store)
    return nodes.groupBy(*entity, "shard", "level", "idx").agg(F.sum("s").cast(SUM).alias("s"), F.sum("n").alias("n"))


def compact(spark: SparkSession, store: str, target: str, entity: Sequence[str]) -> None:
    """Write the folded nodes as batch 0 of a new store."""
    read_nodes(spark, store, entity).write.mode("overwrite").parquet(f"{target}/batch=0")


def window_counts(stream: DataFrame, time: str, keys: Sequence[str], length: str, slide: str, lateness: str) -> DataFrame:
    """(window_start, window_end, keys..., n): rows per sliding window of an unbounded stream; rows later than `lateness` are left out."""
    w = F.window(time, length, slide)
    zoned = stream.withColumn(time, F.col(time).cast("timestamp"))
    counts = zoned.withWatermark(time, lateness).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")
