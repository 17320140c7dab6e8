"""Query registry: a key, its Spark query and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quire.runtime import spread


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in CATALOG:
            raise ValueError(f"{key} registered twice")
        CATALOG[key] = Query(key, fn, sql)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Columns of ``documents`` for costly per-row work, over all cores even from one small file."""
    return spread(table(spark, sf_dir, "documents").select(*cols), "doc_id")
