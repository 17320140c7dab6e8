"""Grouped and whole-table summaries."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.nested import nest_children
from quire.operators.setops import first_per_key
from quire.runtime import durable


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key, largest first (ties in key order)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def count_distinct_cols(df: DataFrame, col_sets: list[list[str]]) -> DataFrame:
    """Distinct rows of each column set; a null counts as a value of its own."""
    counts = df.agg(*[F.countDistinct(F.struct(*cols)).alias("+".join(cols)) for cols in col_sets])
    return _long(counts, counts.columns, "columns", "n_distinct")


def _long(one_row: DataFrame, cols: list[str], name: str, value: str) -> DataFrame:
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in cols])).alias("r")).select("r.*")


def labels_per_record(df: DataFrame, id: str, path: str) -> DataFrame:
    """Labels per record for the records that have any. Counted in the row: no explode, no shuffle."""
    n = F.coalesce(F.size(F.col(path)), F.lit(0))
    return df.where(n > 0).select(id, n.cast("long").alias("n_labels"))


def histogram_of_counts(df: DataFrame, key: str) -> DataFrame:
    """How many keys have 1, 2, 3 ... rows."""
    per_key = df.groupBy(key).agg(F.count("*").alias("count"))
    return per_key.groupBy("count").agg(F.count("*").alias("n_keys"))


def collect_list_sorted(df: DataFrame, key: str, col: str, order: str = "asc", **options) -> DataFrame:
    """Sorted values per key and the first of them (``order`` asc or desc).

    The first value is a plain min / max; lists of very large keys are split into parts, which go on in that order
    (``max_items`` to a part, see ``nest_children``).
    """
    pick = F.min if order == "asc" else F.max
    firsts = df.groupBy(key).agg(pick(col).alias("first_value"), F.count(col).alias("n_values"))
    lists = nest_children(df.where(F.col(col).isNotNull()), [key], [col], [col], descending=order != "asc", **options)
    lists = lists.select(key, "part_no", F.transform("children", lambda x: x[col]).alias("values"))
    return firsts.join(lists, key, "left")


def collect_set_size(df: DataFrame, key: str, col: str, more_than: int) -> DataFrame:
    """Keys with more than ``more_than`` distinct values; sizes only, no set is held in memory."""
    return (df.select(key, col).distinct().groupBy(key).agg(F.count(col).alias("n_distinct"))
            .where(F.col("n_distinct") > more_than))


_STATS = ("count", "mean", "stddev", "min", "max")


def _stat_columns(c: str) -> list[Column]:
    x = F.col(c).cast("double")
    return [F.count(x).cast("double").alias(f"{c}|count"), F.avg(x).alias(f"{c}|mean"),
            F.stddev_samp(x).alias(f"{c}|stddev"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]


def describe_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, stat, value) rows for count, mean, stddev, min, max; one pass over the data."""
    wide = df.agg(*[s for c in cols for s in _stat_columns(c)])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(s).alias("stat"), F.col(f"`{c}|{s}`").alias("value"))
            for c in cols for s in _STATS]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def exact_quantiles(df: DataFrame, cols: list[str], ps: list[float]) -> DataFrame:
    """(column, p, value) with linear interpolation, exact and without a whole column in any task.

    Equal values are counted first, the distinct values range-sorted and written, and the rank of
    each found from running counts within its range partition plus the totals of those before.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])).alias("r")).select("r.*")
    counted = long.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count("*").alias("n"))
    placed = durable(counted.repartitionByRange("column", "v").withColumn("_part", F.spark_partition_id()), "quantiles")
    sums = placed.groupBy("_part", "column").agg(F.sum("n").alias("s"))
    w = Window.partitionBy("column").orderBy("_part")
    # one row per (range partition, column): the only unsplit window, bounded by the partition count
    starts = sums.select("_part", "column", (F.sum("s").over(w) - F.col("s")).alias("start"),
                         F.sum("s").over(Window.partitionBy("column")).alias("total"))
    inner = Window.partitionBy("_part", "column").orderBy("v")
    ranked = (placed.withColumn("upto", F.sum("n").over(inner)).join(starts, ["_part", "column"])
              .withColumn("first_rank", F.col("start") + F.col("upto") - F.col("n"))
              .withColumn("last_rank", F.col("start") + F.col("upto") - 1))
    at = F.col("p") * (F.col("total") - 1)
    hit = (ranked.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
           .withColumn("lo", F.floor(at)).withColumn("hi", F.ceil(at))
           .where("(lo BETWEEN first_rank AND last_rank) OR (hi BETWEEN first_rank AND last_rank)"))
    low = F.max(F.when(F.expr("lo BETWEEN first_rank AND last_rank"), F.col("v")))
    high = F.max(F.when(F.expr("hi BETWEEN first_rank AND last_rank"), F.col("v")))
    return (hit.groupBy("column", "p").agg(low.alias("a"), high.alias("b"), F.max(at - F.col("lo")).alias("w"))
            .select("column", "p", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value")))


def sketch_quantiles(df: DataFrame, cols: list[str], ps: list[float], k: int = 800) -> DataFrame:
    """(column, p, value) from one mergeable quantile sketch (KLL) per column: one pass, a few kilobytes from each task.

    A value is one of the column whose rank is off by a share of about ``2.3 / k ** 0.9`` of all rows at most, with 99 % confidence
    (0.6 % for 800); nulls and NaN take no part; a column without values has null.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    sketches = df.agg(*[F.kll_sketch_agg_double(value[c], F.lit(k)).alias(f"_{i}") for i, c in enumerate(cols)],
                      *[F.count(value[c]).alias(f"_n{i}") for i, c in enumerate(cols)])
    at = F.array(*[F.lit(float(p)) for p in ps])
    rows = [F.struct(F.lit(c).alias("column"), F.when(F.col(f"_n{i}") > 0, F.arrays_zip(at.alias("p"), F.kll_sketch_get_quantile_double(f"_{i}", at).alias("value")))
                     .otherwise(F.transform(at, lambda p: F.struct(p.alias("p"), F.lit(None).cast("double").alias("value")))).alias("q")) for i, c in enumerate(cols)]
    return sketches.select(F.explode(F.array(*rows)).alias("r")).select("r.column", F.explode("r.q").alias("q")).select("column", "q.p", "q.value")


def summary_stats(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """``describe_stats`` plus the quartiles; ``exact=False`` uses approximate ones in the same style."""
    q = percentiles(df, cols, [0.25, 0.5, 0.75], exact)
    named = q.select("column", F.concat(F.round(F.col("p") * 100).cast("int").cast("string"), F.lit("%")).alias("stat"), "value")
    return describe_stats(df, cols).unionByName(named)


def percentiles(df: DataFrame, cols: list[str], ps: list[float], exact: bool = True) -> DataFrame:
    """(column, p, value) rows, interpolated when exact, else from a mergeable sketch in one pass."""
    if exact:
        return exact_quantiles(df, cols, ps)
    wide = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [float(p) for p in ps], 10000).alias(c) for c in cols])
    rows = [F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("p"), F.col(c)[i].alias("value"))
            for c in cols for i, p in enumerate(ps)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mean_median(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, median, max, min, standard deviation."""
    return summary_stats(df, [col]).groupBy().agg(*[
        F.max(F.when(F.col("stat") == stat, F.col("value"))).alias(name)
        for stat, name in (("mean", "mean"), ("50%", "median"), ("max", "max"), ("min", "min"), ("stddev", "std"))])


def _bounds(df: DataFrame, cols: list[str], lo: float, hi: float) -> dict[str, tuple[float, float]]:
    """Two quantiles per column (a few numbers on the driver), so the filter becomes literals on the scan."""
    found = {(r["column"], r["p"]): r["value"] for r in exact_quantiles(df, cols, [lo, hi]).collect()}
    return {c: (found[c, lo], found[c, hi]) for c in cols if (c, lo) in found}


def iqr_outliers(df: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Rows within k interquartile ranges of the quartiles on every column."""
    for c, (q1, q3) in _bounds(df, cols, 0.25, 0.75).items():
        df = df.where(F.col(c).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1)))
    return df


def quantile_trim(df: DataFrame, cols: list[str], lo: float, hi: float) -> DataFrame:
    """Rows between two quantiles on every column."""
    for c, (a, b) in _bounds(df, cols, lo, hi).items():
        df = df.where(F.col(c).between(a, b))
    return df


def top_n_plus_others(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n largest groups and one ``Others`` row for the rest.

    The top n come from a top-k over the counts and are joined back: no window over all groups.
    """
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n"), "_key").limit(n).select(F.col("_key").alias("_top_key"), F.lit(True).alias("_top"))
    merged = counts.join(top, F.col("_key").eqNullSafe(F.col("_top_key")), "left")
    name = F.when(F.col("_top"), F.col("_key").cast("string")).otherwise(F.lit("Others"))
    return merged.groupBy(name.alias(key)).agg(F.sum("_n").alias("n"))


def share_percent(df: DataFrame, pred: Column) -> DataFrame:
    """One row: rows, rows where ``pred`` holds, percentage (null for no rows)."""
    return df.agg(F.count("*").alias("n_total"), F.count_if(pred).alias("n_match"),
                  F.try_divide(F.count_if(pred) * F.lit(100.0), F.count("*")).alias("percent"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """Contingency table with zeros; values are given, so no extra job finds them."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values])


def agreement_rate(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs compared, pairs that agree, rate."""
    same = F.col(a).eqNullSafe(F.col(b))
    return df.agg(F.count("*").alias("n_pairs"), F.count_if(same).alias("n_agree"),
                  F.try_divide(F.count_if(same).cast("double"), F.count("*")).alias("agreement"))


def conditional_counts(df: DataFrame, preds: dict[str, Column], by: str | None = None) -> DataFrame:
    grouped = df.groupBy(*([by] if by else []))
    return grouped.agg(*[F.count_if(p).alias(name) for name, p in preds.items()])


def binned_histogram(df: DataFrame, col: str, width: float | None = None, log: bool = False) -> DataFrame:
    """(bin, n): fixed-width bins from the minimum, integer bins by default, or powers of ten."""
    x = F.col(col)
    if log:
        bin_ = F.floor(F.log10(x))
        df = df.where(x > 0)
    elif width is None:
        bin_ = F.floor(x)
    else:
        low = df.agg(F.min(x)).first()[0]
        bin_ = F.floor((x - F.lit(low)) / F.lit(float(width)))
    return df.where(x.isNotNull()).groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col_a, col_b, corr) for a <= b; all pairs of columns in one pass."""
    pairs = list(combinations_with_replacement(cols, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def group_top_values(df: DataFrame, group: str, value: str, k: int = 5) -> DataFrame:
    """The k most common values of each group, with counts."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    return first_per_key(counts, [group], [F.desc("n"), value], k)


def distinct_totals_by_source(df: DataFrame, source: str, cols: list[str]) -> DataFrame:
    """Rows and distinct counts per source and in total (source ``all``)."""
    counts = [F.count("*").alias("n_rows"), *[F.countDistinct(F.struct(c)).alias(f"distinct_{c}") for c in cols]]
    return df.groupBy(source).agg(*counts).unionByName(df.agg(*counts).withColumn(source, F.lit("all")))


def coverage_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in a, in b, in both, and the covered share of a in percent."""
    flags = (a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
             .unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
             .groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    total = flags.agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("n_a"), F.coalesce(F.sum("_b"), F.lit(0)).alias("n_b"),
                      F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("n_both"))
    return total.withColumn("percent", F.try_divide(F.col("n_both") * F.lit(100.0), F.col("n_a")))


def scale_up_estimate(sample: DataFrame, measure: str, fraction: float) -> DataFrame:
    """Estimated total of a measure from a sample of known fraction."""
    return sample.agg(F.sum(measure).cast("double").alias("sample_total"), F.count("*").alias("sample_rows")).withColumn(
        "estimate", F.col("sample_total") / F.lit(float(fraction)))


def partition_profile(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def group_concat_top(df: DataFrame, key: str, label: str, k: int = 20, sep: str = "; ") -> DataFrame:
    """The k keys with most labels: size and joined labels. Only those k keys are ever collected."""
    top = (df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k))
    members = nest_children(df.select(key, label).join(top.select(key), key, "left_semi"), [key], [label], [label])
    joined = F.array_join(F.transform("children", lambda x: x[label]), sep)
    return top.join(members, key).select(key, "n", "part_no", joined.alias("labels"))


def unpivot_long(df: DataFrame, ids: list[str], cols: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, name, value)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
