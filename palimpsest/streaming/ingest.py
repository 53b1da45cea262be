"""Streaming ingestion: turns arrive as files, jobs leave per conversation; late turns count as long as the watermark keeps them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TURNS = "conv_id bigint, turn bigint, role string, text string, ts timestamp"


def read_turns(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_turns(turns: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (conversation, turn) once within the watermark."""
    return turns.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["conv_id", "turn"])


def session_jobs(turns: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """A job for each conversation and session: its turns in order as one prompt. delay: the watermark, where turns have none."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.trim("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    marked = turns if delay is None else turns.withWatermark("ts", delay)
    s = marked.groupBy(F.session_window("ts", gap).alias("w"), "conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("raw_prompt"), F.count("*").alias("turns"))
    return s.select("conv_id", F.col("w.start").alias("started"), "turns", "raw_prompt")


def type_counts(events: DataFrame, window: str = "1 hour", slide: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by type in sliding windows."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def start(jobs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each micro-batch to `sink`; the checkpoint makes a restart go on where it stopped."""
    w = jobs.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(availableNow=True) if once else w).start()
