"""Per-key picks, running counts, the distributed row index, sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.setops import _asc, first_per_key
from quire.runtime import durable

_ROW_MASK = (1 << 33) - 1


def latest_per_key(df: DataFrame, key: str, order_desc: list) -> DataFrame:
    """The row with the highest ``order_desc`` per key."""
    return first_per_key(df, [key], [F.desc(c) for c in order_desc])


def count_over(df: DataFrame, key: str, out: str = "group_size") -> DataFrame:
    """Group size on every row.

    Sizes come from an aggregate joined back instead of a window over the group: the rows
    of a very large group are never sorted in one task, and AQE can split its join partition.
    """
    sizes = df.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias(out))
    return df.join(sizes, F.col(key).eqNullSafe(F.col("_k"))).select(*df.columns, out)


def global_index(df: DataFrame, order_by: list, out: str = "ix") -> DataFrame:
    """Dense 0-based index in a total order, without sending the rows through one task.

    Range partitions are sorted and written once (so a rerun cannot move the bounds), the
    rows of each partition counted, and the counts summed up; one small row per partition
    is all that any single task sees.
    """
    order = [_asc(c) for c in order_by]
    placed = durable(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "index")
    part = F.shiftrightunsigned(F.col("_at"), 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    offsets, seen = [], 0
    for row in sorted(counts, key=lambda r: r["_part"]):
        offsets.append((row["_part"], seen))
        seen += row["_n"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _start long")
    indexed = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return indexed.select(*df.columns, (F.col("_start") + F.col("_at").bitwiseAND(F.lit(_ROW_MASK))).alias(out))


def null_surrogate(df: DataFrame, col: str, order_by: list, prefix: str = "null", width: int = 5) -> DataFrame:
    """Replace null ids by ``prefix`` and a zero-padded number in the stated order."""
    filled = global_index(df.where(F.col(col).isNull()), order_by, out="_nth")
    name = F.format_string(f"{prefix}%0{width}d", F.col("_nth"))
    filled = filled.withColumn(col, name).select(*df.columns)
    return df.where(F.col(col).isNotNull()).unionByName(filled)


def trailing_count(df: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Rows of the same key in the ``seconds`` before this one, and whether ``limit`` is reached.

    Works on counts per (key, second): those are joined with the time buckets before and at their own,
    so no task sorts the whole history of a key.
    """
    epoch = F.unix_seconds(F.col(ts).cast("timestamp"))
    per_second = df.groupBy(F.col(key), epoch.alias("_s")).agg(F.count("*").alias("_n"))
    bucket = F.expr(f"_s div {int(seconds)}")
    w = (Window.partitionBy(key, "_b").orderBy("_s").rangeBetween(-seconds, -1))
    # every second is placed in its own bucket and, as history only, in the next one
    own = per_second.select(key, "_s", "_n", bucket.alias("_b"), F.lit(True).alias("_own"))
    next_ = per_second.select(key, "_s", "_n", (bucket + 1).alias("_b"), F.lit(False).alias("_own"))
    counted = (own.unionByName(next_)
               .withColumn("trailing", F.coalesce(F.sum("_n").over(w), F.lit(0)))
               .where("_own").select(F.col(key).alias("_k"), F.col("_s").alias("_t"), "trailing"))
    return (df.join(counted, (F.col(key).eqNullSafe(F.col("_k"))) & (epoch == F.col("_t")))
            .select(*df.columns, "trailing", (F.col("trailing") >= limit).alias("over_limit")))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    """First ``k`` rows of an order; Spark plans this as a per-task top-k and one merge."""
    return df.orderBy(*order).limit(k)


def argmax_row(df: DataFrame, col: str, tie: str | None = None) -> DataFrame:
    """The row with the largest value (smallest ``tie`` among equals), in one aggregate."""
    order: Column = F.col(col) if tie is None else F.struct(F.col(col), -F.col(tie))
    return (df.where(F.col(col).isNotNull()).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
            .where(F.col("_row").isNotNull()).select("_row.*"))
