"""Source trees, directory statistics, snapshots and run memos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that are read and folders that are skipped.
EXTENSIONS = ["js", "mjs", "cjs", "ts", "jsx", "tsx", "py", "java", "kt", "kts", "rb", "php", "cs", "go", "rs", "scala", "swift", "ex", "exs"]
SKIPPED = [".git", "node_modules", "vendor", "dist", "build", "target", ".venv", "venv", "__pycache__", ".idea", ".next"]


def source_tree(spark: SparkSession, root: str, own: Sequence[str] = ()) -> DataFrame:
    """``file, text, blob_sha, size`` of the source files below ``root``; tests of Go are left out, and
    so are the folders that a tool keeps for itself (``own``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(EXTENSIONS) + "}").load(root)
    skip = "/(" + "|".join(s.replace(".", r"\.") for s in [*SKIPPED, *own]) + ")/"
    kept = files.where(~F.regexp_like("path", F.lit(skip)) & ~F.endswith("path", F.lit("_test.go")))
    return kept.select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("blob_sha"), F.col("length").alias("size"))


def directory_statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row ``files, bytes``; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def save_snapshot(graph: DataFrame, path: str, fingerprint: str, engine_version: str) -> None:
    """The graph of one (fingerprint, engine version); saving it again replaces that one only."""
    tagged = graph.withColumn("fingerprint", F.lit(fingerprint)).withColumn("engine_version", F.lit(engine_version))
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fingerprint", "engine_version").parquet(path)


def load_snapshot(spark: SparkSession, path: str, fingerprint: str, engine_version: str) -> DataFrame | None:
    """The saved graph, or None; another engine version is no hit."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.option("basePath", path).parquet(path).where((F.col("fingerprint").cast("string") == fingerprint) & (F.col("engine_version").cast("string") == engine_version)).drop("fingerprint", "engine_version")
    return None if rows.isEmpty() else rows


def save_memo(result: DataFrame, path: str, key: str) -> None:
    """The result of a run under its key, committed by a rename, so that a reader sees all or nothing."""
    spark = result.sparkSession
    staged, final = f"{path}/_{key}", f"{path}/{key}"
    result.write.mode("overwrite").parquet(staged)
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(P(final), True)
    if not fs.rename(P(staged), P(final)):
        raise RuntimeError(f"the memo {key} could not be committed")


def load_memo(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The memo of a key, or None."""
    final = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}")
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return spark.read.parquet(f"{path}/{key}") if fs.exists(final) else None


def prune_memos(spark: SparkSession, path: str, keep: int = 16) -> list[str]:
    """Removes all memos but the ``keep`` most recent; the keys removed."""
    P = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = P(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(P(path)) if not s.getPath().getName().startswith(("_", "."))), reverse=True)
    gone = [name for _, name in found[keep:]]
    for name in gone:
        fs.delete(P(f"{path}/{name}"), True)
    return gone
