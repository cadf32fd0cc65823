"""Report store and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadaspark.operators.history import latest_by_key
from cadaspark.sources.scratch import keep

NO_STATE = "none"


def write_reports(reports: DataFrame, path: str) -> None:
    """Append report versions; ``version`` orders writes of the same report."""
    reports.write.mode("append").partitionBy("state").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Current version of every report (replace by id)."""
    return latest_by_key(spark.read.parquet(path), ["report_id"], ["version"])


def upsert_reports(reports: DataFrame, path: str) -> None:
    """Replace reports by id and rewrite only the states that change.

    These are the states of the new reports and those in which their ids lie already; of these alone the stored rows are read, merged
    with the new ones by ``version`` and written over their partitions. A read takes the store as it is.
    """
    spark = reports.sparkSession
    new = keep(reports.withColumn("state", F.coalesce("state", F.lit(NO_STATE))), "new-reports")
    merged, before = new, set()
    if _exists(spark, path):
        stored = spark.read.schema(new.schema).option("basePath", path).parquet(path)
        moved = stored.select("report_id", "state").join(new.select("report_id").distinct(), "report_id", "left_semi")
        before = _states(moved)
        merged = stored.where(F.col("state").isin(list(before | _states(new)))).unionByName(new)
    latest = keep(latest_by_key(merged, ["report_id"], ["version"]), "merged-reports")
    latest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state").parquet(path)
    # a state that lost its last report has no rows to write over it
    for state in before - _states(latest):
        _remove(spark, f"{path}/state={state}")


def stored_reports(spark: SparkSession, path: str) -> DataFrame:
    """Current reports of a store written by ``upsert_reports``."""
    stored = spark.read.parquet(path)
    return stored.withColumn("state", F.when(F.col("state") != NO_STATE, F.col("state")))


def _states(reports: DataFrame) -> set[str]:
    """Names of the states, of which there are few."""
    return {r["state"] for r in reports.select("state").distinct().collect()}


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, path)
    return files.exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    files, where = _folder(spark, path)
    files.delete(where, True)


def export_reports_json(reports: DataFrame, path: str, audit_path: str) -> None:
    """Reports as JSON lines, and one audit row per exported report."""
    reports.write.mode("append").json(path)
    audit = reports.select(
        "report_id", F.lit("JSON").alias("export_format"), F.lit(path).alias("export_path"), "persona",
        F.current_timestamp().alias("exported_at"),
    )
    audit.write.mode("append").parquet(audit_path)
