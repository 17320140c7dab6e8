"""The fit from pattern counts against row-wise expectation maximisation, and what it finds on planted matches."""

import numpy as np

from quire.operators import fellegi_sunter as S


def planted(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    match = rng.random(n) < 0.15
    a = np.where(match, rng.choice([0.2, 0.8, 1.0], n, p=[.05, .25, .7]), rng.choice([0.2, 0.8, 1.0], n, p=[.7, .25, .05]))
    b = np.where(match, rng.random(n) < 0.9, rng.random(n) < 0.2).astype(float)
    c = np.where(match, rng.random(n) < 0.8, rng.random(n) < 0.3).astype(float)
    return match, a, b, c


CUTS = {"a": (0.5, 0.9), "b": (1.0,), "c": (1.0,)}


def test_fit_equals_rowwise_em_and_finds_matches(spark):
    match, a, b, c = planted()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(zip(a, b, c))], "id long, a double, b double, c double").repartition(5)
    model = S.fit_match_model(df, CUTS)

    levels = [(a >= 0.5).astype(int) + (a >= 0.9), b.astype(int), c.astype(int)]
    m = [np.array([1, 4, 9]) / 14, np.array([1, 4]) / 5, np.array([1, 4]) / 5]
    u, share = [x[::-1] for x in m], 0.1
    for _ in range(1000):
        pm = share * np.prod([m[i][levels[i]] for i in range(3)], axis=0)
        pu = (1 - share) * np.prod([u[i][levels[i]] for i in range(3)], axis=0)
        w = pm / (pm + pu)
        share = w.mean()
        m = [np.bincount(x, w) / w.sum() for x in levels]
        u = [np.bincount(x, 1 - w) / (1 - w).sum() for x in levels]
    assert abs(model.share - share) < 1e-6
    for i, f in enumerate("abc"):
        assert np.abs(model.m[f] - m[i]).max() < 1e-6 and np.abs(model.u[f] - u[i]).max() < 1e-6
    score = {r["id"]: r["score"] for r in S.match_scores(df, model).collect()}
    assert max(abs(score[i] - w[i]) for i in range(len(w))) < 1e-6
    assert abs(share - match.mean()) < 0.05 and np.mean((np.array([score[i] for i in range(len(w))]) > 0.5) == match) > 0.93


def test_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, None, 1.0, 0.0), (2, 0.95, None, 1.0)], "id long, a double, b double, c double")
    model = S.fit_match_model(df, CUTS)
    assert all(0 <= r["score"] <= 1 for r in S.match_scores(df, model).collect())
    empty = S.fit_match_model(df.limit(0), CUTS)
    assert empty.share == 0.1 and S.match_scores(df.limit(0), empty).count() == 0
