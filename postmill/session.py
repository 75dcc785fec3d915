"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# SQL settings the operators want in any session; all may change at run time
TUNING = {
    # the JVM does not compile methods beyond 8000 bytes of bytecode, so wide
    # feature projections run interpreted unless such stages are split instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in TUNING.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "postmill") -> SparkSession:
    """A local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("POSTMILL_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .getOrCreate()
    )
    return tune(spark)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A path that is free to write and that every executor can reach; its folder is removed when the session's JVM ends.

    The cluster names the parent in ``spark.checkpoint.dir``. Where that is unset, a local
    session, as in tests, uses the warehouse; a cluster is refused, since its executors would write
    to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{root.rstrip('/')}/{purpose}-{os.urandom(6).hex()}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{path}/data"


def remove_dir(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends, not when the driver happens to collect its garbage.

    For writes: what they wrote is read back, so their shuffles serve nothing else.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def materialize(df: DataFrame, purpose: str, codec: str = "snappy") -> DataFrame:
    """Write an intermediate table once to the shared folder and read it back.

    For results that several branches of a plan need: they survive lost
    executors and are not computed again. ``forget`` removes one early.
    """
    path = shared_dir(df.sparkSession, purpose)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once nothing will read it any more."""
    remove_dir(df.sparkSession, df._written_to)
