"""Word vectors trained on blocks: the tree, the text that is used, and what the driver gets."""

import heapq
import random

import numpy as np
import pytest

from quire.operators import text as T
from quire.operators import word2vec as V


@pytest.mark.parametrize("counts", [{2: 1}, {2: 7, 3: 1, 5: 2, 9: 1}, {1: 64}, {2: 300, 3: 150, 4: 70, 11: 9, 500: 1, 501: 1}])
def test_tree_is_a_huffman_tree(counts):
    n = np.array(list(counts.values()))
    words, weight = int(n.sum()), np.repeat(list(counts), n)
    own, node, bit = V.paths(np.arange(words), V.huffman(np.array(list(counts)), n), 2 * words - 2)
    codes = ["".join(map(str, bit[own == i][::-1])) for i in range(words)]
    assert len(set(codes)) == words and all(node[own == i].max(initial=2 * words - 2) == 2 * words - 2 for i in range(words))
    assert abs(sum(0.5 ** len(c) for c in codes) - 1) < 1e-9 and not any(a != b and b.startswith(a) for a, b in zip(sorted(codes), sorted(codes)[1:]))
    heap, least = weight.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        least += pair
        heapq.heappush(heap, pair)
    assert sum(int(w) * len(c) for w, c in zip(weight, codes)) == least


def test_blocks_hold_all_records(spark):
    rows = [(i, None if i % 9 == 0 else ["a", None, f"w{i % 5}"] * (i % 4)) for i in range(200)] + [(7, ["long"] * 500), (7, ["long"] * 500)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>").selectExpr("*", "monotonically_increasing_id() AS r").localCheckpoint()
    blocks = V.token_blocks(df, "r", "tokens", 3, 40).collect()
    assert sorted(r for b in blocks for r in b["rows"]) == sorted(r["r"] for r in df.collect())
    assert all(len(b["numbers"]) // 4 <= 40 or len(b["rows"]) == 1 for b in blocks) and len(blocks) > 30
    for word, n in (("a", sum(i % 4 for i in range(200) if i % 9)), ("long", 1000)):
        assert sum(c for b in blocks for w, c in zip(b["words"], b["counts"]) if w == word) == n


def _two_topics(spark, words):
    draw = random.Random(3)
    rows = [(d, [f"{'ab'[d % 2]}{draw.randrange(words)}" for _ in range(60)]) for d in range(400)]
    return spark.createDataFrame(rows + [(1000, []), (1001, None), (1002, ["never"]), (1003, []), (1003, [])], "id long, tokens array<string>")


def test_columns_of_any_name_and_kind(spark):
    df = _two_topics(spark, 30).selectExpr("*", "map('k', id) AS pairs", "0 AS embedding", "id AS _row")
    got = T.word2vec_doc_vectors(df, "tokens", size=4, partitions=2)
    assert got.columns == ["id", "tokens", "pairs", "_row", "embedding"]
    assert sorted((r["id"], r["pairs"]["k"], r["_row"], len(r["embedding"])) for r in got.collect()) == sorted((r["id"], r["id"], r["id"], 4) for r in df.collect())


def test_records_of_a_topic_lie_together(spark):
    df = _two_topics(spark, 30)
    got = T.word2vec_doc_vectors(df, "tokens", size=20, partitions=2)
    assert got.columns == ["id", "tokens", "embedding"] and dict(got.dtypes)["embedding"] == "array<float>"
    got = got.collect()
    assert len(got) == 405 and all(r["embedding"] == [0.0] * 20 for r in got if r["id"] >= 1000)
    v = np.array([r["embedding"] for r in sorted(got, key=lambda r: r["id"]) if r["id"] < 1000])
    v = v - v.mean(axis=0)
    like = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    even = np.arange(400) % 2 == 0
    assert like[np.ix_(even, even)].mean() > 0.5 > 0 > like[np.ix_(even, ~even)].mean()
    again = {r["id"]: r["embedding"] for r in T.word2vec_doc_vectors(df.repartition(5), "tokens", size=20, partitions=2).collect()}
    assert all(np.allclose(again[r["id"]], r["embedding"], atol=1e-6) for r in got)


def test_vectors_stay_out_of_the_driver(spark):
    """10,000 words of 100 numbers are 4 MB; the driver may get 1 MB in all."""
    conf = spark.sparkContext._jsc.sc().conf()
    before = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        df = _two_topics(spark, 5_000)
        assert T.word2vec_doc_vectors(df, "tokens", min_count=1).where("size(embedding) = 100").count() == 405
    finally:
        conf.set("spark.driver.maxResultSize", before)
