"""Processing only new or changed records (problem 1), run fingerprints and staleness.

``BatchStore`` is the manifest: batches below one shared folder, the output of each written under its id,
each committed by the rename of its manifest, which is made last. Two jobs stand on it, and both follow
one rule, *listing anti-join manifest*:

* ``RecordJob``: the records of an append-only log. The manifest holds the state of each record that a
  committed batch has seen; a run aggregates new rows only and anti-joins them with the manifest.
* ``IncrementalJob``: files. The manifest holds path, size and checksum of the processed files; contents
  are opened for files whose path, size and time are unknown only.

A run that dies anywhere is repeated without losing or doubling a record.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.functions.keys import normalize_file_path, normalize_hash, normalize_operation_key
from factweave.tables import bounded, cut_lineage, hadoop_path, scratch_folder

#: Most rows of a table of snapshots or runs that is broadcast (short rows: keys, a version, a time).
SMALL_ROWS = 100_000


def latest_state(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """One row per key: ``value`` of the row with the greatest ``order``.

    One aggregation with map-side combine, so that a hot key costs one partial row per task. Null
    keys form a group of their own; null ``order`` values sort first; equal rows collapse. An empty
    log gives an empty result. Of rows tied in the whole ``order`` the greatest value is taken.
    """
    best = F.max(F.struct(*order, F.col(value).alias("__v")))
    return log.groupBy(*keys).agg(best.alias("__s")).select(*keys, F.col("__s.__v").alias(value))


def pending(listing: DataFrame, manifest: DataFrame, keys: Sequence[str], state: Sequence[str]) -> DataFrame:
    """Rows of ``listing`` without a row in ``manifest`` of the same keys and the same state.

    Null equals null, in keys and in state. Other columns of either side play no part.
    """
    sides = [*keys, *state]
    m = manifest.select(*[F.col(c).alias(f"__m_{i}") for i, c in enumerate(sides)])
    condition = F.lit(True)
    for i, c in enumerate(sides):
        condition = condition & listing[c].eqNullSafe(m[f"__m_{i}"])
    return listing.join(m, condition, "left_anti")


def normalized_log(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The log with its repo, keys and hashes in normal form.

    A row counts if its (fingerprint, engine_version) has a snapshot. Repeated snapshots are
    collapsed first; up to ``SMALL_ROWS`` of them are broadcast, so that the log isn't shuffled to find
    its repos, more are joined by a shuffle.
    """
    owner = bounded(snapshots.select("fingerprint", "engine_version", "repo").where("repo IS NOT NULL").distinct(), SMALL_ROWS, snapshots)
    rows = log.select("fingerprint", "engine_version", "operation_key", "file_path", "file_hash", "recorded_at", "dep_seq", "ingested_at")
    return rows.join(owner, ["fingerprint", "engine_version"]).select(
        "repo",
        normalize_operation_key(F.col("operation_key")).alias("operation_key"),
        normalize_file_path(F.col("file_path")).alias("file_path"),
        normalize_hash(F.col("file_hash")).alias("file_hash"),
        "recorded_at",
        "dep_seq",
        "ingested_at",
    )


def last_success(runs: DataFrame) -> DataFrame:
    """``repo, started_at`` of the latest-started succeeded run; repos without one are absent."""
    ok = F.lower(F.regexp_replace("outcome", r"^\s+|\s+$", "")) == "succeeded"
    return runs.where(ok & F.col("repo").isNotNull()).groupBy("repo").agg(F.max("started_at").alias("started_at")).where("started_at IS NOT NULL")


class BatchStore:
    """Batches below a folder: ``manifest/<batch>`` and ``output/<batch>``, Parquet folders.

    A batch exists once its manifest has its name; until then it is called ``_<batch>``, and an output
    folder without a manifest is not read. Ids sort in the order of the commits. One writer at a time.
    """

    def __init__(self, spark: SparkSession, work: str):
        self.spark, self.work = spark, work

    def committed(self) -> list[str]:
        """Ids of the committed batches, the oldest first."""
        fs, p = hadoop_path(self.spark, f"{self.work}/manifest")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))) if fs.exists(p) else []

    def named(self, digest: str) -> str:
        """The id of the next batch that processes what ``digest`` stands for; a run repeated after a
        failure gets the same id, for nothing was committed in between."""
        return f"{len(self.committed()):08d}-{digest}"

    def commit(self, batch: str, manifest: DataFrame, output: DataFrame | None = None) -> None:
        """Writes the output, then the manifest, then renames it; repeated, it replaces its own folders."""
        if batch in self.committed():
            return
        if output is not None:
            output.write.mode("overwrite").parquet(f"{self.work}/output/{batch}")
        manifest.write.mode("overwrite").parquet(f"{self.work}/manifest/_{batch}")
        fs, staged = hadoop_path(self.spark, f"{self.work}/manifest/_{batch}")
        if not fs.rename(staged, hadoop_path(self.spark, f"{self.work}/manifest/{batch}")[1]):
            raise RuntimeError(f"batch {batch} could not be committed")

    def _read(self, kind: str, schema: str | None) -> DataFrame | None:
        found = []
        for b in self.committed():
            folder = f"{self.work}/{kind}/{b}"
            fs, p = hadoop_path(self.spark, folder)
            if fs.exists(p):
                found.append(folder)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        if found:
            return reader.parquet(*found).withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return self.spark.createDataFrame([], f"{schema}, batch string") if schema else None

    def manifest(self, schema: str) -> DataFrame:
        """The manifest rows of all committed batches, with ``batch``."""
        return self._read("manifest", schema)  # type: ignore[return-value]

    def output(self) -> DataFrame | None:
        """The output of all committed batches, with ``batch``; None if none has any."""
        return self._read("output", None)


class RecordJob:
    """Records of an append-only log: each run takes the rows that arrived since and gives the records
    whose state is new or changed.

    ``keys`` name a record, ``order`` ranks its rows and ``value`` is its state; ``schema`` is the DDL of
    the three together. The manifest holds one row per record and batch, the latest that the batch has
    seen. Work is in proportion to the new rows and one pass over the manifest, whatever the log's length.
    """

    def __init__(self, spark: SparkSession, work: str, keys: Sequence[str], value: str, order: Sequence[str], schema: str):
        self.store, self.keys, self.value, self.order, self.schema = BatchStore(spark, work), list(keys), value, list(order), schema

    def _states(self, rows: DataFrame) -> DataFrame:
        """Per record the row of the greatest order; of rows tied in all of it the greatest value."""
        return rows.groupBy(*self.keys).agg(F.max(F.struct(*self.order, self.value)).alias("s"))

    def known(self) -> DataFrame:
        """Keys and state ``s`` of every record that a committed batch has seen."""
        rows = self.store.manifest(self.schema)
        if len(self.store.committed()) > 1:
            return self._states(rows)
        return rows.select(*self.keys, F.struct(*self.order, self.value).alias("s"))  # one batch: one row a record

    def adopt(self, rows: DataFrame, digest: str) -> str:
        """Commits what an earlier run, told by ``digest``, has processed, without output."""
        batch = self.store.named(digest)
        self.store.commit(batch, self._states(rows).select(*self.keys, "s.*"))
        return batch

    def run(self, rows: DataFrame) -> str:
        """Processes the new rows: the changed records become the output of the batch, the states of all
        records among the rows its manifest.

        A row that is older than what the manifest knows changes nothing, whenever it arrives.
        """
        fresh = cut_lineage(self._states(rows))
        told = fresh.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*self.keys, "s").cast("decimal(38,0)")).alias("h")).first()
        batch = self.store.named(hashlib.sha256(f"{told['n']}|{told['h']}".encode()).hexdigest()[:16])
        known = self.known().select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], F.col("s").alias("__s"))
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & fresh[k].eqNullSafe(known[f"__k{i}"])
        value = F.col("s")[self.value]
        unchanged = (F.col("__s") >= F.col("s")) | F.col("__s")[self.value].eqNullSafe(value)
        changed = fresh.join(known, same & unchanged, "left_anti")
        self.store.commit(batch, fresh.select(*self.keys, "s.*"), changed.select(*self.keys, value.alias(self.value)))
        return batch


def changed_records(log: DataFrame, snapshots: DataFrame, runs: DataFrame, work: str | None = None) -> DataFrame:
    """``repo, operation_key, file_path, file_hash`` of every record that is new or changed since
    its repo's last successful run.

    What that run had seen, the rows ingested up to its start, is committed to a manifest; the rows that
    arrived since are aggregated apart, anti-joined with it, and written as the next batch, which is
    returned. Failed, cancelled and unfinished runs leave the manifest as it is; late rows count only if
    they are later than what the manifest knows. Hashes that are null on both sides are equal. Empty
    inputs give an empty result. ``work`` (by default a new folder in the shared one) holds the batches;
    called again after a failure with the same ``work`` and inputs, finished batches stay as they are.
    """
    spark = log.sparkSession
    schema = "repo string, operation_key string, file_path string, recorded_at timestamp, dep_seq long, file_hash string"
    job = RecordJob(spark, work or scratch_folder(spark, "records"), ["repo", "operation_key", "file_path"], "file_hash", ["recorded_at", "dep_seq"], schema)
    done = job.store.committed()
    rows = normalized_log(log, snapshots).join(bounded(last_success(runs), SMALL_ROWS, runs), "repo", "left")
    seen = F.coalesce(F.col("ingested_at") <= F.col("started_at"), F.lit(False))
    if not done:
        job.adopt(rows.where(seen), "adopted")
    if len(done) < 2:
        job.run(rows.where(~seen))
    out = job.store.output()
    return out.select("repo", "operation_key", "file_path", "file_hash") if out is not None else spark.createDataFrame([], "repo string, operation_key string, file_path string, file_hash string")


def file_checksums(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows with ``checksum``, the SHA-256 of each file, read in blocks, so that a file of any size is
    hashed in little memory; null for a file that is gone by now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            sums = []
            for p in b.column(b.schema.get_field_index(path)).to_pylist():
                system, where = fs.FileSystem.from_uri(p)
                try:
                    digest = hashlib.sha256()
                    with system.open_input_stream(where) as f:
                        while block := f.read(1 << 20):
                            digest.update(block)
                    sums.append(digest.hexdigest())
                except FileNotFoundError:
                    sums.append(None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums, pa.string())], names=[*b.schema.names, "checksum"])

    return files.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema.fields)}, checksum string")


class IncrementalJob:
    """Files in, batches out, each input file version exactly once.

    A file counts as processed if path, size and checksum are in a committed manifest. Its listing reads
    names, sizes and times; contents are opened, by ``file_checksums``, for files whose path, size and time are
    unknown only. A file that is gone gets a manifest row without a checksum. ``read`` gives, of every file
    that still exists, the output of its newest version. One run at a time.
    """

    SCHEMA = "path string, size long, modified timestamp, checksum string"

    def __init__(self, spark: SparkSession, source: str, work: str, pattern: str = "*"):
        self.spark, self.source, self.pattern, self.store = spark, source, pattern, BatchStore(spark, work)

    def committed(self) -> list[str]:
        """Ids of the committed batches."""
        return self.store.committed()

    def manifest(self) -> DataFrame:
        """``path, size, modified, checksum, batch``: the newest row of every file ever processed."""
        newest = F.max(F.struct("batch", "size", "modified", "checksum")).alias("m")
        return self.store.manifest(self.SCHEMA).groupBy("path").agg(newest).select("path", "m.size", "m.modified", "m.checksum", "m.batch")

    def listing(self) -> DataFrame:
        """``path, size, modified`` of the files there are; no contents are read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", self.pattern).load(self.source)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def pending(self) -> DataFrame:
        """The files to process, with their checksums."""
        known = self.manifest()
        unseen = pending(self.listing(), known, ["path"], ["size", "modified"])
        return pending(file_checksums(unseen).where("checksum IS NOT NULL"), known, ["path"], ["size", "checksum"])

    def gone(self) -> DataFrame:
        """Manifest rows of files that are no longer there."""
        here = self.manifest().where("checksum IS NOT NULL").select("path").join(self.listing().select("path"), "path", "left_anti")
        return here.selectExpr("path", "CAST(NULL AS LONG) AS size", "CAST(NULL AS TIMESTAMP) AS modified", "CAST(NULL AS STRING) AS checksum")

    def run(self, process: Callable[[DataFrame], DataFrame]) -> str | None:
        """Processes what is pending; the batch id, or None if there was nothing.

        ``process`` gets ``path, size, modified, checksum`` rows and returns output rows with their ``path``.
        """
        todo = cut_lineage(self.pending().unionByName(self.gone()))
        line = F.sha2(F.concat_ws("\0", "path", F.coalesce("checksum", F.lit("gone"))), 256)
        digest = todo.agg(F.sum(F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        if not digest["n"]:
            return None
        batch = self.store.named(hashlib.sha256(f"{digest['s']}|{digest['n']}".encode()).hexdigest()[:16])
        output = process(todo.where("checksum IS NOT NULL"))
        if "path" not in output.columns:
            raise ValueError("output rows must have the path of their file")
        self.store.commit(batch, todo, output)
        return batch

    def read(self) -> DataFrame | None:
        """The output of every file's newest version; files that are gone have none."""
        rows = self.store.output()
        return None if rows is None else rows.join(self.manifest().where("checksum IS NOT NULL").select("path", "batch"), ["path", "batch"], "left_semi").drop("batch")


def run_fingerprint(files: DataFrame, group: Sequence[str], path: str, digest: str, version: str = "") -> DataFrame:
    """SHA-256 over the version and the ordered (path, digest) pairs of each group, NUL between.

    Two levels keep a hot group in bounds: each row is hashed first, and a group's sorted row hashes
    (64 characters each) are what one task holds. Null digests count as empty.
    """
    line = F.concat_ws("\0", F.coalesce(F.col(path), F.lit("")), F.coalesce(F.col(digest), F.lit("")))
    return files.groupBy(*group).agg(F.sha2(F.concat_ws("\0", F.lit(version), F.concat_ws("\0", F.array_sort(F.collect_list(line)))), 256).alias("fingerprint"), F.count("*").alias("files"))


def stale_rows(dependencies: DataFrame, current: DataFrame, key: str, path: str = "file_path", digest: str = "file_hash") -> DataFrame:
    """Keys with a dependency that is missing from ``current`` or has another hash there."""
    cur = current.select(F.col(path).alias("__p"), F.col(digest).alias("__h"))
    joined = dependencies.join(cur, F.col(path) == F.col("__p"), "left")
    return joined.where(F.col("__p").isNull() | ~F.col(digest).eqNullSafe(F.col("__h"))).select(key).distinct()
