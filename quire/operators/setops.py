"""Union, distinct and first-per-key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.vectors import valid_vector


def _asc(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def union_all(*tagged: tuple[str, DataFrame], tag_col: str = "source") -> DataFrame:
    """Append frames by column name; each row carries the tag of its frame."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag_col, F.lit(tag)) for tag, df in tagged])


def first_per_key(df: DataFrame, keys: list[str], order_by: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in a stated order (give a total order for a repeatable answer).

    The ``row_number <= n`` filter makes Spark cut every key to ``n`` rows per task before the
    shuffle (WindowGroupLimit), so a key that holds a third of the rows does not pile up in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*[_asc(c) for c in order_by])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def drop_dup_then_group(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Count rows by ``by`` after keeping one row per ``keys`` (``by`` must depend on or extend the keys)."""
    return df.select(*dict.fromkeys([*keys, *by])).distinct().groupBy(*by).agg(F.count("*").alias("n"))


def validity_report(df: DataFrame, id: str, vec: str, dim: int) -> DataFrame:
    """One row: total, null vectors, wrong vectors, duplicate ids among the valid, kept."""
    v = F.col(vec)
    ok = valid_vector(v, dim)
    per_id = df.groupBy(id).agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"),
        F.count_if(v.isNotNull() & ~ok).alias("n_bad"), F.count_if(ok).alias("n_ok"))
    zero = F.lit(0)
    return per_id.agg(
        F.coalesce(F.sum("n"), zero).alias("total_rows"), F.coalesce(F.sum("n_null"), zero).alias("null_vectors"),
        F.coalesce(F.sum("n_bad"), zero).alias("bad_vectors"),
        F.coalesce(F.sum(F.greatest(F.col("n_ok") - 1, zero)), zero).alias("duplicates"),
        F.count_if(F.col("n_ok") > 0).alias("kept"))
