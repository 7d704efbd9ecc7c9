"""File streams of events and log lines, for the streaming forms in ``jobstate`` and ``stored``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EVENT_SCHEMA = "job_id string, id bigint, stage string, progress int, done int, total int, created_at timestamp"


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
