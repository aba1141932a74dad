"""Observations as a stream. An extension: the reference reads them in batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factweave.sources.observations import SCHEMA


#: What an observation must have.
_GOOD = "coalesce(r.method, '') <> '' AND coalesce(r.path, '') <> '' AND r.status BETWEEN 100 AND 599"


def _parsed(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select("value", F.from_json("value", SCHEMA).alias("r"), F.current_timestamp().alias("arrived"), F.xxhash64("value").alias("line_hash"))


def malformed_observations(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The lines that are neither blank nor an observation, with their arrival: the side output of the stream."""
    return _parsed(spark, path, max_files).where(f"value RLIKE '[^ \\\\t\\\\r]' AND NOT coalesce({_GOOD}, false)").select(F.col("value").alias("line"), "arrived")


def stream_observations(spark: SparkSession, path: str, lateness: str = "10 minutes", max_files: int = 1000) -> DataFrame:
    """New observations as files arrive, without repetitions of a trace id within the watermark.

    Malformed lines cannot fail a file here; ``malformed_observations`` has them. Rows without a trace id
    or a readable time are kept as they are, with their arrival as event time.
    """
    rows = _parsed(spark, path, max_files).where(_GOOD)
    timed = rows.select("r.*", F.coalesce(F.try_to_timestamp("r.observed_at"), F.col("arrived")).alias("event_time"), F.coalesce("r.trace_id", F.concat(F.lit("line:"), F.col("line_hash").cast("string"))).alias("dedup_key"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["dedup_key"]).drop("dedup_key")


def status_counts(observations: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Counts per window, method, path and status; a window is final when the watermark passes it."""
    return observations.groupBy(F.window("event_time", window), "method", "path", "status").agg(F.count("*").alias("n")).select("window.start", "window.end", "method", "path", "status", "n")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, processing what is there and then stopping; ``checkpoint`` must be shared."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
