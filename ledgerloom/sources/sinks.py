"""Writers: one physical file published by rename, plain directories, text and SequenceFiles."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("csv", "parquet", "tsv")


class Files:
    """The file system of a path, whichever it is, through Hadoop's API; a path without a scheme is that of the session's default file system."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        # The local one keeps a checksum file beside each file, which would outlive a rename.
        self.fs = fs.getRawFileSystem() if fs.getScheme() == "file" else fs

    def names(self, folder: str) -> list[str]:
        return [str(f.getPath().toString()) for f in self.fs.listStatus(self._path(folder))]

    def size(self, path: str) -> int:
        return int(self.fs.getContentSummary(self._path(path)).getLength())

    def move(self, source: str, target: str) -> None:
        """Rename over `target`; where the file system does not rename onto a file, the old one is deleted first."""
        if not self.fs.rename(self._path(source), self._path(target)):
            self.fs.delete(self._path(target), False)
            if not self.fs.rename(self._path(source), self._path(target)):
                raise OSError(f"{source} could not be renamed to {target}")

    def remove(self, folder: str) -> None:
        """Delete a folder and what is in it; one right under the root is refused, as it is no work folder."""
        if self.fs.makeQualified(self._path(folder)).depth() < 2:
            raise ValueError(f"{folder} is too near the root to be removed")
        self.fs.delete(self._path(folder), True)


def write_single_file(df: DataFrame, target: str, fmt: str = "parquet", order: Sequence[str] = (), **options: object) -> str:
    """One file `target`, sorted by `order`, on the file system of its path. For small results: a single task sorts and writes it, after a shuffle, so
    that the stages before keep their own number of tasks.

    The file is written to a sibling folder and renamed over the target; the folder is removed whatever happens.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format is one of {sorted(FORMATS)}")
    parent, _, name = target.rstrip("/").rpartition("/")
    folder = f"{parent}/.{name}.{uuid.uuid4().hex}" if parent else f".{name}.{uuid.uuid4().hex}"
    files = Files(df.sparkSession, target)
    one = df.repartition(1)
    if order:
        one = one.sortWithinPartitions(*order)
    try:
        if fmt in ("csv", "tsv"):
            options = {"header": fmt == "csv", "sep": "\t" if fmt == "tsv" else ","} | options
        one.write.format("csv" if fmt == "tsv" else fmt).options(**options).save(folder)
        parts = [p for p in files.names(folder) if p.rpartition("/")[2].startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} part files where one was expected")
        files.move(parts[0], target)
    finally:
        files.remove(folder)
    return target


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(key, n) of a tab-separated side file as write_single_file makes it: one text and one count a line. A line of another form fails the query that
    reads it, naming the line."""
    line = spark.read.text(path)
    parts = F.split("value", "\t")
    n = F.get(parts, F.lit(1)).try_cast("bigint")
    bad = F.raise_error(F.concat(F.lit("malformed line of counts: "), F.col("value"))).cast("bigint")
    return line.select(F.get(parts, F.lit(0)).alias("key"), F.when((F.size(parts) == 2) & n.isNotNull(), n).otherwise(bad).alias("n"))


def write_sequence_file(df: DataFrame, key: str, value: str, path: str) -> None:
    """(key, value) pairs as a Hadoop SequenceFile, for readers that want one; both columns are text or whole numbers. A format Spark has as RDDs only."""
    df.select(key, value).rdd.map(tuple).saveAsSequenceFile(path)


def read_sequence_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), schema)


def write_folder(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """A distributed directory write; arrays are joined by commas for CSV."""
    if fmt == "csv":
        df = df.select(*[F.concat_ws(",", F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "array" else F.col(f"`{f.name}`") for f in df.schema.fields])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_text(path: str, content: str) -> str:
    """A report as UTF-8 text, published by rename."""
    path = os.path.abspath(path)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(content)
    os.replace(temporary, path)
    return path


def round_trip(spark: SparkSession, df: DataFrame, folder: str) -> tuple[int, int, int]:
    """Rows of `df` and of its CSV and Parquet copies read back."""
    write_folder(df, f"{folder}/csv", "csv")
    write_folder(df, f"{folder}/parquet")
    return df.count(), spark.read.option("header", True).option("escape", '"').csv(f"{folder}/csv").count(), spark.read.parquet(f"{folder}/parquet").count()


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """(lines): physical lines of text files, blank ones and headers included."""
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


def input_bytes(df: DataFrame) -> DataFrame:
    """(files, bytes) a file-based frame reads, from the scan's metadata column."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"))
