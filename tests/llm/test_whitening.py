"""Whitening: counts and eigenpairs against numpy's solver, rows against a direct computation."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import DATA
from quire.llm import whitening
from quire.llm.queries import load


def test_inertia_of_indefinite_matrices():
    rng = np.random.default_rng(0)
    for t in range(200):
        d = int(rng.integers(1, 40))
        a = rng.standard_normal((d, d))
        a = np.round(a + a.T) if t % 3 == 0 else a + a.T
        if t % 5 == 0:
            np.fill_diagonal(a, 0)  # needs two-by-two pivots
        values = np.linalg.eigvalsh(a)
        if np.abs(values).min() > 1e-9:
            assert whitening.negative_pivots(a) == (values < 0).sum()


@pytest.mark.parametrize("kind", ["sample", "rank", "equal", "triples", "graded", "close"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(len(kind))
    for d in (1, 2, 7, 33, 64):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = rng.standard_normal((200, d)) if kind == "sample" else np.round(20 * rng.standard_normal((d // 2 + 1, d)))
        e = {"equal": np.full(d, 3.0), "triples": np.repeat(np.arange(1.0, d + 1), 3)[:d], "graded": 10.0 ** -np.linspace(0, 14, d), "close": 1 + 1e-13 * np.arange(d)}.get(kind)
        v = x.T @ x if e is None else (q * e) @ q.T
        v = (v + v.T) / 2
        values, vectors = whitening.leading_eigenpairs(v, 32)
        want, k = np.linalg.eigvalsh(v)[::-1], len(values)
        assert k == min(32, d) or want[k] < 1e-11 * want[0]
        assert np.abs(values - want[:k]).max() <= 1e-13 * d * want[0]
        assert np.abs(v @ vectors.T - vectors.T * values).max() <= 1e-13 * d * want[0]
        assert np.abs(vectors @ vectors.T - np.eye(k)).max() <= 1e-13 * d


def expected(rows, components=32):
    """{vec_id: (n, deviation, whitened up to signs, explained)} by numpy, from rows whose vectors are usable."""
    x = np.array([[int(np.floor(64 * float(np.float64(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = np.array((n * x - s) / n, dtype=float)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-10 * values[0]).sum()))
    return n, deviation, z @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, vectors, components=32):
    n, deviation, z, explained = expected(vectors, components)
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], []).append(r)
    assert sorted(got, key=str) == sorted((i for i, _ in vectors), key=str)
    sign = None
    for (i, _), dev, row in zip(vectors, deviation, z):
        mine = sorted(got[i], key=lambda r: r["component"])
        assert [r["component"] for r in mine] == list(range(1, z.shape[1] + 1))
        assert {(r["n"], r["deviation"]) for r in mine} == {(n, int(dev))}
        assert max(r["identity_error"] for r in mine) < 1e-9
        assert np.allclose([r["explained"] for r in mine], explained, rtol=1e-9)
        w = np.array([r["whitened"] for r in mine])
        if sign is None:
            sign = np.sign(w * row)
        assert np.abs(w * sign - row).max() < 1e-6


def test_query_against_numpy(spark):
    sf = f"{DATA}/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    usable = [(r["vec_id"], r["embedding"]) for r in rows if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    check(load()["op12_spectrum_slicing"].run(spark, sf).collect(), usable)


def test_cases(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((200, 6)) * [50, 9, 4, 2, 1, .5])]
    bad = [(1000, None), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1002, [float("nan")] + [1.0] * 5), (1003, [float("inf")] + [1.0] * 5)]
    schema = "vec_id long, embedding array<double>, v int, component int, deviation string"
    table = lambda rows: spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], schema).repartition(7)
    check(whitening.whitened_rows(table(good + bad)).collect(), good)
    check(whitening.whitened_rows(table(good), components=2).collect(), good, 2)
    assert whitening.whitened_rows(table(bad)).count() == 0
    assert whitening.whitened_rows(table(good[:1])).count() == 0  # no variance, no component
    null_ids = whitening.whitened_rows(table([(None, v) for _, v in good] * 2)).collect()
    assert len(null_ids) == 6 * 400 and {r["vec_id"] for r in null_ids} == {None}
    with pytest.raises(Exception, match="one dimension"):
        whitening.whitened_rows(table([*good, (7, [1.0])]))
    large = [(i, [c * 2.0 ** 24 for c in v]) for i, v in good[:9]]  # beyond doubles' whole numbers
    model = whitening.fit_whitening(table(large))
    n, deviation, _, _ = expected(large)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table(large), model).collect()}
    assert got == {i: int(d) for (i, _), d in zip(large, deviation)}
