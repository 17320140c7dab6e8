"""Joins. No broadcast hints: AQE broadcasts a side only after measuring it, and splits skewed partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.predicates import null_empty
from quire.operators.windows import global_index
from quire.runtime import take_bounded


def inner_equi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "inner")


def left_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def left_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_semi")


def left_join_missing(left: DataFrame, right: DataFrame, on: list[str], text: str) -> DataFrame:
    """Left rows without any partner, or with a partner whose ``text`` is null or empty."""
    usable = right.select(*on, F.coalesce(null_empty(text), F.lit(False)).alias("_ok"))
    per_key = usable.groupBy(*on).agg(F.bool_and("_ok").alias("_all_ok"))
    return (left.join(per_key, on, "left").where(~F.coalesce(F.col("_all_ok"), F.lit(False)))
            .select(*left.columns).distinct())


def double_lookup(pairs: DataFrame, attrs: DataFrame, left: str, right: str, id: str) -> DataFrame:
    """Attach the attributes of both sides of a pair, with ``_l`` and ``_r`` suffixes."""
    for side, key in (("_l", left), ("_r", right)):
        named = attrs.select(F.col(id).alias(key), *[F.col(c).alias(c + side) for c in attrs.columns if c != id])
        pairs = pairs.join(named, key, "left")
    return pairs


def right_outer_ifnull(left: DataFrame, right: DataFrame, on: str, value: str, default: str | Column,
                       out: str = "canon") -> DataFrame:
    """Every right row, with ``value`` looked up on the left or else ``default`` of the right row."""
    found = left.select(on, F.col(value).alias("_value"))
    fallback = F.col(default) if isinstance(default, str) else default
    return (right.join(found, on, "left").withColumn(out, F.coalesce("_value", fallback)).drop("_value"))


def avg_compare_join(df: DataFrame, keys: list[str], sub_key: str, measure: str, factor: float = 1.0) -> DataFrame:
    """Totals per (keys, sub_key) that exceed ``factor`` times the mean total of their sub_key."""
    totals = df.groupBy(*keys, sub_key).agg(F.sum(measure).alias("total"))
    means = totals.groupBy(sub_key).agg(F.avg("total").alias("mean_total"))
    return totals.join(means, sub_key).where(F.col("total") > F.col("mean_total") * factor)


def all_pairs(df: DataFrame, id: str, max_rows: int = 1000) -> DataFrame:
    """Every pair ``id_l < id_r`` of a small selected set; a set over ``max_rows`` is refused.

    The result is quadratic by definition, so it is only for hand-picked or aggregated sets; use
    ``block_pairs`` or ``similarity_threshold_pairs`` for tables.
    """
    rows = take_bounded(df.orderBy(id), max_rows)
    if rows is None:
        raise ValueError(f"all_pairs is for selections of at most {max_rows} rows")
    selected = df.sparkSession.createDataFrame(rows, df.schema)
    rest = [c for c in df.columns if c != id]
    listed = selected.agg(F.sort_array(F.collect_list(F.struct(id, *rest))).alias("_a"))
    left = listed.select("_a", F.posexplode("_a").alias("_p", "_l"))
    both = left.select("_l", F.explode(F.expr("slice(_a, _p + 2, size(_a))")).alias("_r"))
    return both.select(*[F.col(s)[c].alias(c + s) for c in df.columns for s in ("_l", "_r")])


def dictionary_join(tokens: DataFrame, dictionary: DataFrame, term: str) -> DataFrame:
    """Tokens found in a word list, with its attributes."""
    return tokens.join(dictionary, term)


def rows_by_index(df: DataFrame, order_by: list, wanted: list[int]) -> DataFrame:
    """Rows at given global indexes, in the order asked (``position``); a repeated index gives its row again."""
    asked = df.sparkSession.createDataFrame(list(enumerate(wanted)), "position long, ix long")
    return global_index(df, order_by).join(F.broadcast(asked), "ix").orderBy("position")
