"""Incremental runs (M, D09, L16): prompts that have no shard yet, and a stream that takes what has arrived since the last run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textmill.sources.jsonl import RECORD


def pending(prompts: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Prompts without results; a result counts only if the text it is bound to is the prompt's."""
    return prompts.join(done.select(key, "text_sha256").distinct(), [key, "text_sha256"], "left_anti")


def once_each(spark: SparkSession, source: str, target: str, checkpoint: str, late: str = "30 days") -> StreamingQuery:
    """Takes the record files that have arrived since the last run, drops repeats of a request_id within the watermark, writes Parquet, and ends."""
    rows = spark.readStream.schema(f"{RECORD}, arrived_at TIMESTAMP").json(source)
    kept = rows.withWatermark("arrived_at", late).dropDuplicatesWithinWatermark(["request_id"])
    return kept.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").outputMode("append").start(target)


def counts(rows: DataFrame, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Records and cut-off ones by model and window of arrival, for batch and stream alike."""
    reason = F.lower(F.trim("finish_reason"))
    timed = rows.withWatermark("arrived_at", late) if rows.isStreaming else rows
    return timed.groupBy(F.window("arrived_at", window)["start"].alias("day"), "model").agg(F.count("*").alias("n"), F.count_if(reason == "length").alias("at_limit"))
