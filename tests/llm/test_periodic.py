"""Periodic runs against a direct search, and the query against its contract read literally."""

import hashlib
import os
import random
import sys
import zlib
from fractions import Fraction

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute as B
from compare import DATA
from quire.llm import periodic
from quire.llm.queries import load


def runs_of(w, min_length=24, exponent=3):
    """Every maximal stretch of every period, kept if the period is its smallest."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(min_length, exponent * q):
                part = w[s:s + n]
                if all(part[d:] != part[:-d] for d in range(1, q)):
                    out.append((s, n, q))
            i += i == s or i + q < len(w)
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    w = B.words(text)
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_of(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)), n)


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256 n_words".split()


@pytest.mark.parametrize("wanted", [(24, 3), (6, 2), (4, 3), (1, 2), (10, 4)])
def test_runs_against_direct_search(wanted):
    rnd, found = random.Random(str(wanted)), 0
    for _ in range(150):
        docs = []
        for _ in range(rnd.randint(1, 4)):
            w = []
            while len(w) < rnd.randint(0, 150):
                if rnd.random() < 0.5:
                    w += [rnd.randint(0, 3) for _ in range(rnd.randint(1, 12))]
                else:
                    w += ([rnd.randint(0, 3) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 9))[:rnd.randint(1, 60)]
            docs.append(w)
        got = periodic.find_runs(np.array([x for d in docs for x in d], dtype=np.uint64), np.cumsum([0] + [len(d) for d in docs]), *wanted)
        assert got == [runs_of(d, *wanted) for d in docs]
        found += sum(map(len, got))
    assert found > 100


def test_one_word_many_times_and_a_long_period():
    first = np.array([0, 60_000])
    assert periodic.find_runs(np.full(60_000, 7, dtype=np.uint64), first, 24, 3) == [[(0, 60_000, 1)]]
    assert periodic.find_runs(np.tile(np.arange(600, dtype=np.uint64), 100), first, 24, 3) == [[(0, 60_000, 600)]]


def test_query_against_its_contract(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {tuple(r[c] for c in COLUMNS) for r in load()["op13_periodic_runs"].run(spark, sf).collect()}
    assert got == {digest(*r) for r in rows}
    assert sum(r[1] > 0 for r in got) > 10


def test_cases(spark):
    planted = next(i for i in range(100, 999) if zlib.crc32(str(i).encode()) % 10 == 0)
    far = " ".join(f"w{i * i % 7919}" for i in range(1_500))
    texts = [(None, "no id " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "a " * 23), (5, "a " * 24), (6, " b\tc\n" * 12), (7, far), (8, far + " x y z" * 9),
             (9, "same " * 30), (9, "same " * 30), (planted, None), (planted, " "), (planted, "one"), (planted, "été naïve   nbsp " * 40),
             (10, "x" * 50_000), (11, ("p q r s t u v w " * 4) + ("p q r s t u v x " * 4))]
    schema = "doc_id long, text string, runs string, kept string, best int, n_words int, start int"
    docs = spark.createDataFrame([(d, t, "r", "k", 1, 2, 3) for d, t in texts], schema)
    run = lambda df: periodic.run_digests(periodic.collapse_runs(df.withColumn("text", periodic.repeat_tails(df["doc_id"], df["text"]))))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in run(docs).collect()), key=str)
    assert got == sorted((digest(*r) for r in texts), key=str)
    assert run(docs.limit(0)).count() == 0
