"""The fetch log. Canonical storage is Parquet partitioned by snapshot_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.schemas import RESPONSES


def write_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(*RESPONSES.fieldNames()).write.mode(mode).partitionBy("snapshot_id").parquet(path)


def read_responses(spark: SparkSession, path: str, snapshot_id: int | None = None) -> DataFrame:
    """Scan with the explicit schema; a snapshot filter prunes partitions."""
    df = spark.read.schema(RESPONSES).parquet(path)
    if snapshot_id is not None:
        df = df.where(df.snapshot_id == snapshot_id)
    return df


def stream_responses(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file-source stream (new files are new responses)."""
    r = spark.readStream.schema(RESPONSES)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)
