"""Session helpers.

The library never creates a session on its own inside operators; callers
pass one in.  ``get_session`` is a convenience for tests, scripts and the
benchmark.  ``checkpoint_dir`` honours ``spark.checkpoint.dir`` from the
cluster configuration and only falls back to a scratch folder when the
setting is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "rankforge") -> SparkSession:
    master = master or os.environ.get("RANKFORGE_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # checkpoint files are removed once their DataFrame is unreferenced
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("RANKFORGE_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session.  Only when it is
    unset (a local test run) is a scratch folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="rankforge-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Survives executor loss (unlike local checkpoints, which are never used
    here) and truncates long iterative plans.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_to_table(df: DataFrame, name: str) -> DataFrame:
    """Write to a Parquet table in the shared folder and read it back: like a
    checkpoint, but later readers scan only the columns they use."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a write in here go when it ends, not with some later
    garbage collection on the driver."""
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, was)


class Scratch:
    """Tables of one job that are removed as soon as their successor is written,
    so that the shared folder holds one step of the job and not all of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str, *done: str) -> DataFrame:
        """``df`` like `cut_to_table`; then the tables called ``done``, which
        nothing reads any more, are removed."""
        path = self.paths[name] = scratch_path(self.spark, name)
        with brief_shuffles(self.spark):
            df.write.parquet(path)
        self.drop(*done)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                remove_path(self.spark, self.paths.pop(name))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this job below the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint folder: intermediate tables, round
    trips.  On a cluster that is the shared folder of `spark.checkpoint.dir`;
    only a local run without that setting has a temporary folder there."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/rankforge-scratch/{name}-{uuid.uuid4().hex[:12]}"
