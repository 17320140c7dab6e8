"""Registered queries of this subpackage; the rest of the library does not know them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.plans.registry import Query

LLM_CATALOG: dict[str, Query] = {}


def llm_query(key: str, sql: str | None = None):
    def register(fn):
        if key in LLM_CATALOG:
            raise ValueError(f"{key} registered twice")
        LLM_CATALOG[key] = Query(key, fn, sql)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores before it until no column of ``df`` is called so (names do not differ by case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted
