"""Session defaults and lineage cutting."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tenderflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on: UTC, AQE with skew handling, Arrow transfer."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that spark.checkpoint.dir names; where it is unset, one below the warehouse, which all executors share too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize to the shared checkpoint folder, so that a lost executor does not replay earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    release(df.sparkSession)
    return out


#: Seconds between two releases, and when the last one was.
RELEASE_S = 15.0
_released = [time.monotonic()]


def release(spark: SparkSession, every: float = RELEASE_S) -> None:
    """Let Spark delete shuffles, checkpoints and broadcasts of finished steps, and the driver give back memory, if the last time is long ago.

    Spark's cleaner acts when the driver collects its garbage, which a driver with little to do puts off for the length of a job.
    """
    if time.monotonic() - _released[0] < every:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _released[0] = time.monotonic()


def stored(df: DataFrame) -> DataFrame:
    """As `cut_lineage`, but as compressed Parquet in no order, for frames of many rows; `forget` deletes it."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    release(df.sparkSession)
    return back


def forget(*frames: DataFrame) -> None:
    """Delete the files of stored frames that nothing will read any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def case_sensitive(spark: SparkSession) -> SparkSession:
    """A session beside the given one, with its SQL settings, in which names that differ only in case are different names."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.caseSensitive", "true")
    return own
