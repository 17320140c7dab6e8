"""Keyword lists and hybrid search against full lists fused in plain Python."""

import math
import random
import re

import pytest

from quire.operators import retrieval as R


def terms(text):
    return [t for t in re.split(r"[^a-zA-Z0-9_]+", (text or "").lower()) if len(t) >= 2]


def full_lists(queries, docs):
    """{query: ([doc by BM25], [doc by inner product])}, every ranked document."""
    tokens = {d: terms(t) for d, t, _ in docs}
    df, mean = {}, sum(map(len, tokens.values())) / len(docs)
    for t in tokens.values():
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = {}
    for q, text, v in queries:
        scored = []
        for d, t, _ in docs:
            shared = set(terms(text)) & set(tokens[d])
            s = sum(math.log(1 + (len(docs) - df[x] + 0.5) / (df[x] + 0.5)) * tokens[d].count(x) * 2.2
                    / (tokens[d].count(x) + 1.2 * (0.25 + 0.75 * len(tokens[d]) / mean)) for x in shared)
            if shared:
                scored.append((-round(s, 9), d))
        near = [(-round(sum(a * b for a, b in zip(v, w)), 9), d) for d, _, w in docs if w is not None and v is not None]
        out[q] = ([d for _, d in sorted(scored)], [d for _, d in sorted(near)])
    return out


def made(spark, kind, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    vector = lambda: [float(rnd.randint(-3, 3)) for _ in range(4)]
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    docs = [(name(i), " ".join(rnd.choices(words, k=rnd.randint(0, 12))), vector() if i % 7 else None) for i in range(400)]
    docs += [(name(400 + i), docs[3][1], docs[3][2]) for i in range(130)]  # a third are copies, all tied
    queries = [(name(i), " ".join(rnd.choices(words, k=4)), vector()) for i in range(9)] + [(name(90), "unheard of", vector()), (name(91), "w1 w2", None), (name(92), "", None)]
    schema = f"{{}} {kind}, text string, vector array<double>"
    return queries, docs, spark.createDataFrame(queries, schema.format("query_id")), spark.createDataFrame(docs, schema.format("doc_id")).repartition(6)


@pytest.mark.parametrize("kind,blocks", [("long", False), ("string", True)])
def test_hybrid_is_the_fusion_of_the_full_lists(spark, monkeypatch, kind, blocks):
    if blocks:
        monkeypatch.setattr(R, "MAX_QUERIES", 4)
        monkeypatch.setattr(R, "MAX_ASKED", 15)
    queries, docs, q, d = made(spark, kind, 5)
    lists = full_lists(queries, docs)
    got = {}
    for r in R.hybrid_rrf(q, d, k=5, c=3).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["doc_id"], r["score"])
    for name, both in lists.items():
        score = {}
        for ranked in both:
            for n, doc in enumerate(ranked, 1):
                score[doc] = score.get(doc, 0) + 1 / (3 + n)
        best = sorted((-round(s, 12), doc) for doc, s in score.items())[:5]
        assert [got.get(name, {})[n] for n in range(1, len(best) + 1)] == [(doc, -s) for s, doc in best]
    top = {}
    for r in R.bm25_search(q, d, 7).collect():
        top.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    for name, (ranked, _) in lists.items():
        assert [top.get(name, {}).get(n) for n in range(1, len(ranked[:7]) + 1)] == ranked[:7]


def test_nothing_to_search(spark):
    _, _, q, d = made(spark, "long", 1)
    assert R.hybrid_rrf(q, d.limit(0), 5).count() == 0
    assert R.hybrid_rrf(q.limit(0), d, 5).count() == 0
    assert R.bm25_search(q.limit(0), d, 5).count() == 0
