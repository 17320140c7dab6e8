"""Repeatable samples and the arithmetic around them."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.setops import first_per_key


def z_score(confidence: float) -> float:
    """The two-sided normal quantile of any confidence level, to six places."""
    return round(NormalDist().inv_cdf((1 + confidence) / 2), 6)


def _draw(key: str, seed) -> Column:
    """A fixed pseudo-random order: md5 of key and seed."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_sample(df: DataFrame, key: str, fraction: float, seed=0) -> DataFrame:
    """About ``fraction`` of the keys; the same keys each time."""
    digest = F.conv(F.substring(_draw(key, seed), 1, 8), 16, 10).cast("long")
    return df.where(digest < F.lit(int(fraction * 2 ** 32)).cast("long"))


def sample_per_group(df: DataFrame, group: str, n: int, key: str, seed=0) -> DataFrame:
    """n pseudo-random rows per group; each task keeps n per group before the shuffle."""
    return first_per_key(df, [group], [_draw(key, seed), key], n)


def fixed_n_sample(df: DataFrame, key: str, n: int, seed=0) -> DataFrame:
    """Exactly n rows (or all, if fewer)."""
    return df.orderBy(_draw(key, seed), key).limit(n)


def sample_size_fpc(df: DataFrame, stratum: str, scenarios: list[dict]) -> DataFrame:
    """Sample size for a proportion per stratum and scenario, with finite population correction.

    A scenario has ``confidence`` and ``margin``, optionally ``p``, ``deff`` and ``min_samples``.
    """
    rows = [F.struct(F.lit(s["confidence"]).cast("double").alias("confidence"), F.lit(s["margin"]).cast("double").alias("margin"),
                     F.lit(s.get("p", 0.5)).cast("double").alias("p"), F.lit(s.get("deff", 1.0)).cast("double").alias("deff"),
                     F.lit(s.get("min_samples", 30)).cast("long").alias("min_samples"),
                     F.lit(z_score(s["confidence"])).alias("z")) for s in scenarios]
    strata = df.groupBy(stratum).agg(F.count("*").alias("population"))
    out = strata.select(stratum, "population", F.explode(F.array(*rows)).alias("s")).select(stratum, "population", "s.*")
    n0 = F.col("z") * F.col("z") * F.col("p") * (1 - F.col("p")) / (F.col("margin") * F.col("margin")) * F.col("deff")
    out = out.withColumn("n0", n0).withColumn("n_fpc", F.col("n0") / (1 + (F.col("n0") - 1) / F.col("population")))
    return out.withColumn("sample_size", F.greatest(F.col("min_samples"), F.ceil("n_fpc"))).drop("min_samples", "z")


def proportion_interval(df: DataFrame, success: Column, by: str | None = None, z: float = 1.959964,
                        target: int | None = None) -> DataFrame:
    """Observed share with its normal margin and Wilson interval.

    With ``target``, also how many rows must be drawn to see that many successes.
    """
    out = df.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), F.count_if(success).alias("k"))
    n, zz = F.col("n"), F.lit(z * z)
    p = F.col("k") / n
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = F.lit(z) / (1 + zz / n) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    out = (out.withColumn("p_hat", p).withColumn("margin", F.lit(z) * F.sqrt(p * (1 - p) / n))
           .withColumn("wilson_low", centre - half).withColumn("wilson_high", centre + half))
    if target is not None:
        out = out.withColumn("samples_needed", F.ceil(F.try_divide(F.lit(float(target)), F.col("p_hat"))))
    return out


def block_shuffle(df: DataFrame, ix: str, block: int, seed: int, epoch: int) -> DataFrame:
    """Rows shuffled inside blocks of ``block`` consecutive indexes, anew per epoch.

    Adds ``block`` and ``draw``; blocks are spread by range, each sorted on its own.
    """
    out = df.withColumn("block", F.expr(f"`{ix}` div {int(block)}")).withColumn(
        "draw", F.xxhash64(F.col(ix), F.lit(seed + epoch)))
    return out.repartitionByRange("block", "draw", ix).sortWithinPartitions("block", "draw", ix)
