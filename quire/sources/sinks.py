"""Writers, catalog helpers and incremental loading."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.vectors import valid_vector
from quire.operators.setops import first_per_key
from quire.operators.windows import global_index
from quire.runtime import scratch_path

log = logging.getLogger(__name__)


def write_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Overwrite a catalog table and return it; ``path`` makes it external."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


def export_csv_json(df: DataFrame, path: str, fmt: str) -> None:
    """Distributed CSV (with header) or JSON export: one file per task, no driver round trip."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.csv(path, header=True)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def fixed_size_shards(df: DataFrame, order_by: list, max_rows: int = 500) -> DataFrame:
    """Exact shards: rows in a total order cut every ``max_rows``; adds ``ix`` and ``partition_id``."""
    return global_index(df, order_by).withColumn("partition_id", F.expr(f"ix div {int(max_rows)}"))


def hash_shards(df: DataFrame, key: str | Column, n: int) -> DataFrame:
    """``shard`` = the first 8 hex digits of md5(key), modulo ``n``."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("shard", F.pmod(digest, F.lit(n)).cast("long"))


def skip_existing(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not among the finished ones."""
    return df.join(done.select(*keys), keys, "left_anti")


def partition_checkpoints(df: DataFrame, fn: Callable[[DataFrame], DataFrame], out: str, slice_col: str) -> DataFrame:
    """Apply ``fn`` slice by slice into ``out/<slice_col>=<v>``; a rerun skips the finished slices.

    Only the distinct slice numbers reach the driver. Each slice is one Spark job over one
    partition filter, so a partitioned input is pruned to that slice.
    """
    spark = df.sparkSession
    slices = sorted((r[0] for r in df.select(slice_col).distinct().collect()), key=lambda v: (v is None, v))
    finished = 0.0
    for i, value in enumerate(slices, start=1):
        # as Spark names partition folders, so that reading ``out`` gives the values back
        target = f"{out}/{slice_col}=" + ("__HIVE_DEFAULT_PARTITION__" if value is None else quote(str(value), safe=""))
        if _finished(spark, target):
            continue
        started = time.monotonic()
        fn(df.where(F.col(slice_col).eqNullSafe(F.lit(value)))).drop(slice_col).write.mode("overwrite").parquet(target)
        finished += time.monotonic() - started
        log.info("slice %s: %d/%d, mean %.1fs, left %.0fs", value, i, len(slices), finished / i,
                 finished / i * (len(slices) - i))
    return spark.read.parquet(out)


def _finished(spark: SparkSession, path: str) -> bool:
    """A slice counts as done once the committer has left its success mark."""
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def union_numbered_tables(spark: SparkSession, regex: str) -> DataFrame:
    names = sorted(t.name for t in spark.catalog.listTables() if re.fullmatch(regex, t.name))
    if not names:
        raise ValueError(f"no table matches {regex}")
    return reduce(DataFrame.unionByName, [spark.table(n) for n in names])


def catalog_ops(spark: SparkSession, action: str, name: str | None = None):
    """``show`` (a DataFrame), ``exists`` (a bool), ``drop`` or ``refresh``."""
    if action == "show":
        return spark.sql("SHOW TABLES" if name is None else f"SHOW TABLES LIKE '{name}'")
    if action == "exists":
        return spark.catalog.tableExists(name)
    if action == "drop":
        return spark.sql(f"DROP TABLE IF EXISTS {name}")
    if action == "refresh":
        return spark.catalog.refreshTable(name)
    raise ValueError(f"unknown action {action}")


def upsert_first_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], order_by: list) -> DataFrame:
    """Existing rows plus the first incoming row of every key not yet present."""
    fresh = first_per_key(skip_existing(incoming, existing, keys), keys, order_by)
    return existing.unionByName(fresh)


def index_partition_sink(df: DataFrame, path: str, id_cols=("id", "chunk_index"), text_col: str = "chunk_text",
                         vec_col: str = "embedding", metadata_cols=(), run: str = "0") -> DataFrame:
    """Write search documents (doc id, text, vector, metadata) as Parquet; return the ids written.

    Each ``run`` has a folder of its own, which a rerun overwrites. A failed task is retried by Spark and the output committer keeps only one attempt.
    """
    docs = df.select(
        F.concat_ws("_", *[F.col(c).cast("string") for c in id_cols]).alias("es_doc_id"),
        F.col(text_col).alias("text"), F.col(vec_col).alias("vector"),
        F.struct(*[F.col(c) for c in metadata_cols] or [F.lit(None).cast("string").alias("none")]).alias("metadata"))
    docs.write.mode("overwrite").parquet(f"{path}/run={run}")
    return df.sparkSession.read.parquet(f"{path}/run={run}").select("es_doc_id")


def matrix_index_export(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Valid vectors with a dense ``row_index`` in id order: the row-to-id map of a matrix file."""
    kept = df.where(valid_vector(F.col(vec_col), dim)).select(id_col, F.col(vec_col).cast("array<float>").alias(vec_col))
    return global_index(kept, [id_col], out="row_index")


def fetch_status(df: DataFrame, url: str, code: str, body: str) -> DataFrame:
    """Classify fetched responses: empty_url, success, not_found, status_<code> or error; text kept on success."""
    c, u = F.col(code), F.col(url)
    status = (F.when(u.isNull() | (F.trim(u) == ""), F.lit("empty_url"))
              .when(c.isNull(), F.lit("error"))
              .when(c == 200, F.lit("success"))
              .when(c == 404, F.lit("not_found"))
              .otherwise(F.concat(F.lit("status_"), c.cast("string"))))
    return df.withColumn("download_status", status).withColumn(
        "text", F.when(F.col("download_status") == "success", F.col(body)))


def failed_download_audit(df: DataFrame, body: str, min_bytes: int = 3) -> DataFrame:
    """One row: totals, rows with fewer than ``min_bytes`` bytes, and their share in percent."""
    failed = F.coalesce(F.octet_length(body), F.lit(0)) < min_bytes
    return df.agg(F.count("*").alias("n_total"),
                  F.count_if(failed).alias("n_failed"),
                  F.round(F.try_divide(F.count_if(failed) * F.lit(100.0), F.count("*")), 4).alias("pct_failed"))
