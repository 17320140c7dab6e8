"""Operators with an algorithm of their own against brute force, with hot keys and copies."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.constants import STOP_WORDS
from quire.operators import aggregates as A
from quire.operators import language as LG
from quire.operators import components as C
from quire.operators import linkage as L
from quire.operators import vectors as V
from quire.operators import windows as W
from quire.operators.chunking import split_text
from quire.operators.joins import all_pairs
from quire.operators.similarity import block_pairs
from quire.plans.registry import table

SF = "/root/testdata/sf0.001"


def test_global_index_is_dense_and_ordered(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    got = [(r.ix, r.k, r.id) for r in W.global_index(df.repartition(7), [F.desc("k"), "id"]).collect()]
    want = sorted(((r.k, r.id) for r in df.collect()), key=lambda t: (-t[0], t[1]))
    assert [(k, i) for _, k, i in sorted(got)] == want and sorted(g[0] for g in got) == list(range(2000))


def test_quantiles_match_numpy(spark):
    rng = random.Random(3)
    values = [rng.choice([5.0, rng.gauss(0, 10)]) for _ in range(1001)]
    df = spark.createDataFrame([(v, None if i % 7 else v) for i, v in enumerate(values)], "a double, b double")
    ps = [0.0, 0.1, 0.5, 0.99, 1.0]
    got = {(r.column, r.p): r.value for r in A.exact_quantiles(df, ["a", "b"], ps).collect()}
    for p in ps:
        assert got["a", p] == pytest.approx(np.percentile(values, p * 100))
        assert got["b", p] == pytest.approx(np.percentile(values[::7], p * 100))


def _brute_pairs(records, t):
    units = {}
    for i, keys, toks in sorted(records):
        units.setdefault((frozenset(keys), frozenset(toks)), []).append(i)
    found = {(ids[0], other) for ids in units.values() for other in ids[1:]}
    for (ka, ta), (kb, tb) in combinations(units, 2):
        if ka & kb and len(ta & tb) / len(ta | tb) >= t - 1e-9:
            a, b = units[ka, ta][0], units[kb, tb][0]
            found.add((min(a, b), max(a, b)))
    return found


def test_block_pairs_with_a_hot_block_and_copies(spark):
    rng = random.Random(1)
    records = []
    for i in range(150):
        keys = ["hot"] if i % 3 else [f"k{rng.randrange(8)}", f"k{rng.randrange(8)}"]
        toks = ["x", "y"] if i % 5 == 0 else rng.sample("abcdefgh", rng.randrange(2, 6))
        records.append((i, keys, toks))
    df = spark.createDataFrame(records, "id long, keys array<string>, tokens array<string>")
    rows = block_pairs(df, 0.5).collect()
    assert len(rows) == len({(r.id_l, r.id_r) for r in rows})
    assert {(r.id_l, r.id_r) for r in rows} == _brute_pairs(records, 0.5)


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(100)], "star": [(50, i) for i in range(200)],
             "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]}[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.id: r.canon_id for r in C.connected_components(df, "a", "b").collect()} == _components(edges)


def _average_link(scores, nodes, t):
    groups = [{n} for n in nodes]
    while True:
        best = None
        for a, b in combinations(groups, 2):
            s = sum(scores.get((min(x, y), max(x, y)), 0.0) for x in a for y in b) / (len(a) * len(b))
            if s >= t and (best is None or s > best[0]):
                best = (s, a, b)
        if best is None:
            return {n: min(g) for g in groups for n in g}
        groups = [g for g in groups if g not in best[1:]] + [best[1] | best[2]]


def test_average_link_refinement(spark):
    rng = random.Random(9)
    nodes = list(range(24))
    scores = {(a, b): round(rng.uniform(0.3, 0.99), 6) for a, b in combinations(nodes, 2) if rng.random() < (0.7 if a // 6 == b // 6 else 0.08)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "id_l long, id_r long, score double")
    clusters = C.cluster_pairs(df, 0.4)
    kept = {r.id for r in clusters.collect()}
    got = {r.id: r.canon_id for r in C.cluster_refine(df, clusters, 0.4).collect()}
    assert got == _average_link(scores, sorted(kept), 0.4)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghij") * 3 for _ in range(60)) for _ in range(8)]
    texts = [(i, base[i % 8] if i % 3 else base[i % 8] + f" word{i} extra") for i in range(60)] + [(60, "short text"), (61, "Short, text!")]
    # one template with changes of its own in each copy, and some with changes that copies share
    form = base[0].split()
    for i in range(62, 110):
        cut = rng.randrange(len(form))
        texts.append((i, " ".join(form[:cut] + [f"own{i}" if i % 2 else "shared"] * rng.randrange(1, 4) + form[cut:])))
    shingles = {}
    for i, t in texts:
        w = [x for x in t.lower().replace(",", " ").replace("!", " ").split() if x]
        shingles[i] = {tuple(w[j:j + 5]) for j in range(max(len(w) - 4, 1))}
    close = [(a, b) for a, b in combinations(shingles, 2) if len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.8]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {r.id: r.canon_id for r in L.near_dup_docs(df, "id", "text").collect()}
    assert got == _components(close)


def _vectors(spark, n, d=8, seed=0, name="corpus_id"):
    m = np.random.default_rng(seed).normal(size=(n, d))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(m)], f"{name} long, vector array<double>")


@pytest.mark.parametrize("max_queries", [3, 1000])
def test_knn_in_place_and_in_blocks(spark, max_queries):
    q, queries = _vectors(spark, 10, seed=1, name="query_id")
    c, corpus = _vectors(spark, 300, seed=2)
    got = {}
    for r in V.knn_exact(queries, corpus.repartition(5), 4, max_queries).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.corpus_id
    for i in range(10):
        assert [got[i][n] for n in (1, 2, 3, 4)] == np.argsort(-(c @ q[i]), kind="stable")[:4].tolist()


def test_bad_vectors_are_left_out(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [])], "corpus_id long, vector array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    assert [r.corpus_id for r in V.knn_exact(queries, corpus, 3).collect()] == [1]


def test_mmr_prefers_variety(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.01]), (3, [0.7, 0.7]), (4, [0.0, -1.0])], "corpus_id long, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.1])], "query_id long, vector array<double>")
    picked = [r.corpus_id for r in V.mmr_rerank(queries, corpus, k=2, fetch_k=3).orderBy("rank").collect()]
    assert picked[0] in (1, 2) and picked[1] == 3
    assert [r.corpus_id for r in V.mmr_rerank(queries, corpus, k=2, fetch_k=3, lam=1.0).orderBy("rank").collect()] == [2, 1]


def test_projection_quality_equals_pairs(spark):
    x, df = _vectors(spark, 40, seed=6)
    df = df.withColumn("z", F.slice("vector", 1, 4))
    z = x[:, :4] / np.linalg.norm(x[:, :4], axis=1, keepdims=True)
    row = V.projection_quality(df.repartition(3), "vector", "z").first()
    assert row.cosine_loss is None and row.structure_error == pytest.approx(((x @ x.T - z @ z.T) ** 2).mean())
    assert V.projection_quality(df, "vector", "vector").first().cosine_loss == pytest.approx(0, abs=1e-12)


def test_custom_embedder_gets_batches(spark):
    def factory():
        def encode(texts):
            assert len(texts) <= 2
            return [[float(len(t)), 1.0] for t in texts]
        return encode
    df = spark.createDataFrame([(1, "a"), (2, "bbb"), (3, None), (4, "cc")], "id long, text string")
    out = {r.id: list(r.embedding) for r in V.embed_text(df, "id", "text", factory, batch=2).collect()}
    assert out == {1: [1, 1], 2: [3, 1], 3: [0, 1], 4: [2, 1]}


def test_all_pairs_refuses_tables(spark):
    with pytest.raises(ValueError):
        all_pairs(spark.range(50), "id", max_rows=10)


@pytest.mark.parametrize("seed", range(5))
def test_chunk_properties(seed):
    rng = random.Random(seed)
    # numbered words, so that every chunk has one place in the text
    text = "".join(rng.choice([f"w{i} ", f"w{i}\n", f"w{i}\n\n", f"{i}" + "x" * rng.randrange(1, 60)]) for i in range(900))
    chunks = split_text(text, 100, 20)
    assert all(0 < len(c) <= 100 for c in chunks)
    at, covered = 0, set()
    for c in chunks:                       # chunks come in text order and cover everything but white space
        start = text.find(c, max(0, at - 100))
        assert start >= 0
        covered.update(range(start, start + len(c)))
        at = start + len(c)
    assert all(i in covered or ch.isspace() for i, ch in enumerate(text))


def test_chunk_keeps_short_text_whole():
    assert split_text("one two", 1000, 200) == ["one two"]
    assert split_text("aaa bbb ccc", 7, 3) == ["aaa bbb", "ccc"]


def test_language_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    train = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rest = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    model = LG.fit_language_profiles(train, "text", "lang")
    scored = LG.language_id(rest, "text", model)
    assert scored.where("language = lang").count() / scored.count() >= 0.9
    short = spark.createDataFrame([("ab",), (None,)], "text string")
    assert {r.language for r in LG.language_id(short, "text", model).collect()} == {"unknown"}


def test_stop_words_are_the_published_list(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert sorted(STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_exact_fuzz_ratio(spark):
    rows = [("Godard, Ernest, 1827-1862.", "Godard Ernest, 1827-1862."), ("abc", "abc"), ("abc", "xyz"), ("", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(L.fuzz_ratio("a", "b", exact=True)).collect()] == [98, 100, 0, 100]


def test_reconcile_rules_on_names(spark):
    rows = [("Nightingale, Florence, 1820-1910.", "Nightingale, Florence, 1820-1910."), ("Freud, Sigmund, 1856-1939", "Freud, Sigmund"),
            ("James, Sue, 1952-", "James, Susan, 1951-"), ("Swaine, W. E., 1805-", "Swaine, William Edward, 1805-1868."),
            ("Swaine, W. E.", "Swaine, William Edward"), ("James, Sue, 1952-", "James, Sue, 1951-"), ("James", "James, Sue")]
    df = spark.createDataFrame(rows, "target string, candidate string")
    assert [r.degree for r in L.reconcile_rules(df).collect()] == ["high", "medium", "none", "medium", "low", "none", "none"]


def test_surrogates_and_ledger(spark):
    df = spark.createDataFrame([("b", None, "T"), ("a", None, None), ("c", "x", "T"), ("c", "x", "T")], "label string, id string, type string")
    got = [(r.idx, r.label, r.id, r.type) for r in L.dedupe_input(df).orderBy("idx").collect()]
    assert got == [(0, "c", "x", "T"), (1, "a", "null00000", "missing"), (2, "b", "null00001", "T")]
    log = spark.createDataFrame([(1, 2, "match", 1), (1, 2, "unsure", 2), (3, 4, "match", 1), (3, 4, "remove", 5)], "id_l long, id_r long, label string, at long")
    assert sorted(tuple(r) for r in L.label_ledger(log).collect()) == [(1, 2, "distinct"), (1, 2, "match")]


def test_trailing_count_across_buckets(spark):
    times = [0, 10, 3500, 3600, 3601, 7200, 7200, 10900]
    df = spark.createDataFrame([("u", t) for t in times], "u string, t long").select("u", F.timestamp_seconds("t").alias("ts"))
    got = sorted((r.ts.timestamp(), r.trailing) for r in W.trailing_count(df, "u", "ts", 3600, 3).collect())
    assert [n for _, n in got] == [sum(1 for x in times if t - 3600 <= x <= t - 1) for t in times]


def test_stream_resumes_and_reads_files_once(spark):
    from quire.runtime import scratch_path
    from quire.streaming import ingest
    src, out, ck = (scratch_path(spark, n) for n in ("src", "out", "ck"))
    spark.range(10).write.parquet(src)
    schema = spark.range(1).schema
    assert ingest.stream_file_ingest(spark, src, schema, out, ck).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert ingest.stream_file_ingest(spark, src, schema, out, ck).count() == 15
