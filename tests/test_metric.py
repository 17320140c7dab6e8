"""The exact similarity join against all pairs, and how many pairs it compares."""

import numpy as np
import pytest

from quire.operators import metric as M


def clustered(n, rng, d=24, k=60, spread=0.05):
    c = rng.standard_normal((k, d))
    return c[rng.integers(0, k, n)] + spread * rng.standard_normal((n, d))


def table(spark, x, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], "x") for i, v in enumerate(x)] + list(extra), "vec_id long, embedding array<double>, cell string")


def pairs_of(x, t):
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    first = {}
    rep = [first.setdefault(tuple(v), i) for i, v in enumerate(x.tolist())]
    s = u @ u.T
    return {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if s[a, b] > t and rep[a] == a and rep[b] == b}


@pytest.mark.parametrize("t", [0.3, 0.65, 0.95])
def test_join_equals_all_pairs(spark, monkeypatch, t):
    monkeypatch.setattr(M, "BLOCK", 70)
    rng = np.random.default_rng(int(100 * t))
    x = clustered(500, rng, spread=0.4)
    x[:170] = x[0] + 0.1 * rng.standard_normal((170, 24))  # a third of the rows in one place
    x[5] = x[6]
    x[300:320] = x[299]
    x[7] = 0
    odd = [(1000, None, "x"), (1001, [1.0, None], "x"), (1002, [float("nan")] * 24, "x"), (1003, [float("inf")] * 24, "x"), (None, [1.0] * 24, "x")]
    got = M.similarity_threshold_pairs(table(spark, x, odd), "vec_id", "embedding", t, pivots=9).collect()
    assert sorted((r["vec_id_l"], r["vec_id_r"]) for r in got) == sorted(pairs_of(x, t))
    u = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)
    assert all(abs(r["score"] - u[r["vec_id_l"]] @ u[r["vec_id_r"]]) < 1e-9 for r in got)


def test_compared_pairs_grow_slower_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 50)
    share = []
    for n in (500, 4000):
        join = M.MetricJoin(table(spark, clustered(n, np.random.default_rng(4))), "vec_id", "embedding", 0.9)
        assert join.own.sum() == n
        share.append(join.compared / (n * (n - 1) / 2))
    assert share[1] < 0.1 and share[1] < 0.5 * share[0]


def test_copies_and_empty(spark):
    df = table(spark, np.array([[1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [0.0, 0.0]]))
    assert sorted(map(tuple, M.equal_vectors(df, "vec_id", "embedding").collect())) == [(0, 0), (1, 1), (2, 0)]
    assert [(r[0], r[1]) for r in M.similarity_threshold_pairs(df, "vec_id", "embedding", 0.9).collect()] == [(0, 1)]
    assert M.similarity_threshold_pairs(df.limit(0), "vec_id", "embedding", 0.9).count() == 0
    with pytest.raises(ValueError):
        M.similarity_threshold_pairs(df, "vec_id", "embedding", 0.0)
