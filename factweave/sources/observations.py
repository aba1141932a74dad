"""Runtime observations as JSON lines (A1), in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.functions.keys import normalize_method, normalize_path

SCHEMA = "method string, path string, status int, content_type string, trace_id string, observed_at string"
CONFIDENCE = 0.85


def _read(lines: DataFrame, *extra: str) -> DataFrame:
    """Parsed rows of the non-blank lines in column ``value``; a bad line raises."""
    bad = F.concat(F.lit("malformed observation: "), F.left(F.col("value"), F.lit(200)))
    row = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    rows = lines.where(F.regexp_like("value", F.lit(r"\S"))).withColumn("r", row)
    ok = F.try_parse_json("value").isNotNull() & F.startswith(F.trim("value"), F.lit("{")) & (F.coalesce("r.method", F.lit("")) != "") & (F.coalesce("r.path", F.lit("")) != "") & F.coalesce(F.col("r.status").between(100, 599), F.lit(False))
    checked = rows.withColumn("r", F.when(ok, F.col("r")).otherwise(F.raise_error(bad).cast(f"struct<{', '.join(x.replace(' ', ':', 1) for x in SCHEMA.split(', '))}>")))
    body = F.coalesce("r.content_type", F.lit("")) != ""
    method, path = normalize_method(F.col("r.method")), normalize_path(F.col("r.path"))
    return checked.select(F.concat_ws(" ", method, path).alias("op_key"), method.alias("method"), path.alias("path"), "r.status", "r.content_type", "r.trace_id", "r.observed_at", body.alias("has_body"), body.alias("raw"), F.lit(CONFIDENCE).alias("confidence"), *extra)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, line_no`` of all lines below ``path``, split at ``\\n``; a file may be read by many tasks.

    Rows of one split stand in order in one partition, so a line's number is its place there plus the lines
    of the file's earlier splits; these are counted first, one row per split.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    splits = placed.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("file", "start", "first", before.alias("before"))
    return placed.join(offsets, ["file", "start"]).select("value", "file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line_no"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """All observations of the files at ``path`` with ``file`` and ``line_no``.

    Blank lines are skipped. A line that is no JSON object, lacks method or path, or has a status
    outside 100..599 fails the whole read. ``observed_at`` stays text.
    """
    return _read(numbered_lines(spark, path), "file", "line_no")


def observed_candidates(observations: DataFrame) -> DataFrame:
    """Response candidates of the observations, one per line, in the long form of the merge operators."""
    value = F.to_json(F.struct(F.col("status").cast("string").alias("status"), "content_type", "has_body", "raw"))
    evidence = F.array(F.struct(F.lit("runtime").alias("source"), F.col("file"), F.col("line_no").alias("start_line"), F.col("trace_id")))
    return observations.select("op_key", F.lit("response").alias("slot_kind"), F.col("status").cast("string").alias("slot_key"), F.col("line_no").cast("long").alias("seq"), value.alias("value_json"), "confidence", F.lit("observed").alias("status"), evidence.alias("evidence"))
