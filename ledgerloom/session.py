"""Session settings that hold at any scale, and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of Catalyst's own estimate, for which a broadcast hint is given.
BROADCAST_BYTES = 32 * 1024 * 1024


def session(name: str = "ledgerloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session. Where it is unset, a local session, whose only executor is the driver,
    gets a folder of its own that is removed when Python ends; a cluster raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not folder:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder once and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: object) -> Iterator[SparkSession]:
    """The session with other settings (a double underscore stands for a point), put back afterwards whatever happens; for actions, as plans made
    inside are only run there under these settings."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield spark
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate, an upper bound for filters and projections over files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate is under `limit`; beyond it the join shuffles (AQE splits skewed keys)."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def bounded_rows(df: DataFrame, limit: int) -> list:
    """Rows of a reference list whose size is checked: more than `limit` rows raise instead of filling the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the list holds more than {limit} rows; use a join instead")
    return rows
