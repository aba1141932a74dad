"""Reading of the input tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, reduced to ``columns`` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores, for work that costs far more CPU than a shuffle of it.

    Only an input that was read in less than half as many partitions as there are cores is moved;
    a large one has more partitions than that, and is left where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df


def bounded(df: DataFrame, max_rows: int, source: DataFrame | None = None) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``max_rows`` rows; a larger one is joined by a shuffle.

    ``source`` is a table of at least as many rows that is cheaper to count, such as the file that ``df`` comes from.
    """
    return broadcast(df) if (df if source is None else source).limit(max_rows + 1).count() <= max_rows else df


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset and the master is local (as in
    tests) a folder is created; on a cluster an unset folder is an error, never a machine-local path.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("spark.checkpoint.dir must name a shared folder")
            import tempfile

            folder = tempfile.mkdtemp(prefix="factweave-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path of any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one; removed when the driver's Python ends, if Spark still runs then."""
    folder = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended in any way by then
            if spark.sparkContext._jsc is not None:
                fs, p = hadoop_path(spark, folder)
                fs.delete(p, True)

    atexit.register(remove)
    return folder
