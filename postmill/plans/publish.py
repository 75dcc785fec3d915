"""Run-scoped tables, the latest pointer and run manifests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import shuffles_removed


class GateFailed(RuntimeError):
    """The run did not pass its gates; the previous run stays the latest one."""

    def __init__(self, failed: list[str]):
        super().__init__("failed gates: " + ", ".join(failed))
        self.failed = failed


def run_path(root: str, table: str, run_id: str) -> str:
    return f"{root}/{table}/run_id={run_id}"


def write_run(tables: Mapping[str, DataFrame], root: str, run_id: str) -> dict[str, DataFrame]:
    """Write each table of the run and return it as read back, so later steps do not recompute it."""
    out = {}
    for name, df in tables.items():
        with shuffles_removed(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").parquet(run_path(root, name, run_id))
        out[name] = df.sparkSession.read.parquet(run_path(root, name, run_id))
    return out


def publish_run(spark: SparkSession, root: str, run_id: str, gates: DataFrame) -> None:
    """Move the pointer last, and only when all gates passed.

    The pointer is a log: a run adds one file and nothing is replaced, so readers
    find the previous run until the file is there. ``gates`` has name and passed;
    only the names of failed gates reach the driver.
    """
    failed = sorted(r["name"] for r in gates.where(~F.col("passed")).select("name").distinct().collect())
    if failed:
        raise GateFailed(failed)
    pointer = spark.range(1).select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/latest")


def latest_run(spark: SparkSession, root: str) -> str:
    """The run that was published last; of two at one moment the greater id."""
    log = spark.read.schema("run_id string, published_at timestamp").parquet(f"{root}/latest")
    newest = log.agg(F.max(F.struct("published_at", "run_id"))["run_id"].alias("run_id")).first()["run_id"]
    if newest is None:
        raise LookupError(f"no run is published in {root}")
    return newest


def read_latest(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(run_path(root, table, latest_run(spark, root)))


def run_manifest(
    current: DataFrame, delta_counts: DataFrame, run_id: str, status: str = "success", error: str | None = None,
    source_kind: str = "unknown",
) -> DataFrame:
    """One summary row of a run: rows, columns, new and removed ids, lineage, error."""
    rows = current.agg(F.count(F.lit(1)).alias("row_count"))
    return rows.join(delta_counts).select(
        F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), "row_count", F.lit(len(current.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in current.columns]).alias("columns"), "new_count", "removed_count",
        F.lit(source_kind).alias("source_kind"), F.lit(error).cast("string").alias("error"), F.lit("1").alias("schema_version"))


def failed_manifest(spark: SparkSession, run_id: str, error: str) -> DataFrame:
    """A12 for a run that raised."""
    return spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit("failed").alias("status"), F.lit(error).alias("error"), F.lit("1").alias("schema_version"))


def append_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("append").json(path)
