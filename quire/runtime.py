"""Shared-storage scratch space, lineage cuts and size checks used by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a fresh temporary folder; on a
    cluster a machine-local folder would be lost with its executor, so it is refused.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "stage", few: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and read it back: a lineage cut that survives lost executors.

    With ``few`` the rows are rebalanced first into as few files as their size asks for, for narrow results of wide
    joins, which else leave a small file for each task. On a local file system every file costs its executor several
    processes (``chmod`` of file, checksum and folder), each of which begins as a copy of the executor's.
    """
    path = scratch_path(df.sparkSession, label)
    (df.hint("rebalance") if few else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Delete the files of ``durable`` results that nothing reads any more: their successors are written already."""
    for df in dfs:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def take_bounded(df: DataFrame, max_rows: int) -> list | None:
    """The rows of ``df`` if there are at most ``max_rows`` of them, else None.

    Never brings more than ``max_rows + 1`` rows to the driver.
    """
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores when its scan has fewer splits than there are cores, else unchanged.

    Costly per-row work (tokenising, models) on a small file would otherwise run in a task or two.
    On large inputs the scan has far more splits than cores and no shuffle is added. ``key`` should
    be unique; hashing it keeps a retried task's rows the same.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
