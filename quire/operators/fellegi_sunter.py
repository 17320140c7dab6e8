"""Match weights of record pairs without labels: Fellegi-Sunter, fitted by expectation maximisation.

Pairs enter the fit only as counts of agreement patterns, one aggregate over all pairs. There are as many patterns as
the product of the features' levels, whatever the number of pairs, so the rounds run on that small table in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PATTERNS = 100_000
_LEAST = 1e-12  # of a probability, so that a level that is never met has a finite weight


@dataclass(frozen=True)
class MatchModel:
    """Share of matches, and for each feature the chances of its levels among matches (m) and other pairs (u)."""
    cuts: dict[str, tuple[float, ...]]
    share: float
    m: dict[str, np.ndarray]
    u: dict[str, np.ndarray]

    def weights(self) -> dict[str, np.ndarray]:
        """log2(m / u) of each level."""
        return {f: np.log2(self.m[f] / self.u[f]) for f in self.cuts}


def agreement_level(feature: str, cuts: tuple[float, ...]) -> Column:
    """0 below the first cut, 1 from it on, and so on; null counts as 0."""
    value = F.coalesce(F.col(feature), F.lit(float("-inf")))
    return reduce(lambda a, b: a + b, [(value >= c).cast("int") for c in sorted(cuts)])


def fit_match_model(pairs: DataFrame, cuts: dict[str, tuple[float, ...]], share: float = 0.1, rounds: int = 1000, tolerance: float = 1e-10) -> MatchModel:
    """The model of ``pairs``, whose features ``cuts`` names with the lower bounds of their levels above the lowest.

    Rounds go on until no probability moves by more than ``tolerance``. The start takes higher levels as likelier among
    matches; features are independent given match or not. No pairs, or no features, give the start.
    """
    names = list(cuts)
    sizes = [len(cuts[f]) + 1 for f in names]
    if np.prod(sizes) > MAX_PATTERNS:
        raise ValueError("too many agreement patterns: use fewer features or levels")
    counted = pairs.groupBy(*[agreement_level(f, cuts[f]).alias(f) for f in names]).count().collect() if names else []  # one row per pattern
    n = {tuple(r[f] for f in names): r["count"] for r in counted}
    patterns = np.array(list(product(*map(range, sizes))), dtype=np.int64).reshape(-1, len(names))
    count = np.array([n.get(tuple(p), 0) for p in patterns.tolist()], dtype=float)
    rise = [np.arange(1, s + 1, dtype=float) ** 2 for s in sizes]
    m, u = [r / r.sum() for r in rise], [r[::-1] / r.sum() for r in rise]
    for _ in range(rounds if count.sum() else 0):
        like_m = share * np.prod([m[i][patterns[:, i]] for i in range(len(names))], axis=0)
        like_u = (1 - share) * np.prod([u[i][patterns[:, i]] for i in range(len(names))], axis=0)
        match = count * like_m / np.maximum(like_m + like_u, 1e-300)
        other = count - match
        new_share = match.sum() / count.sum()
        level = lambda w, i: np.bincount(patterns[:, i], w, minlength=sizes[i]) / max(w.sum(), 1e-300)
        new_m, new_u = [level(match, i) for i in range(len(names))], [level(other, i) for i in range(len(names))]
        moved = max([abs(new_share - share), *[float(np.abs(a - b).max()) for a, b in zip(new_m + new_u, m + u)]])
        share, m, u = new_share, new_m, new_u
        if moved <= tolerance:
            break
    least = lambda p: np.maximum(p, _LEAST)
    return MatchModel(cuts, float(share), dict(zip(names, map(least, m))), dict(zip(names, map(least, u))))


def match_scores(pairs: DataFrame, model: MatchModel) -> DataFrame:
    """Adds ``weight``, the sum of the levels' log2 weights, and ``score``, the probability of a match."""
    weight = F.lit(0.0)
    for f, w in model.weights().items():
        weight = weight + F.array(*[F.lit(float(x)) for x in w])[agreement_level(f, model.cuts[f])]
    prior = float(np.log2(max(model.share, _LEAST) / max(1 - model.share, _LEAST)))
    return pairs.withColumn("weight", weight).withColumn("score", 1 / (1 + F.pow(F.lit(2.0), -(F.col("weight") + prior))))
