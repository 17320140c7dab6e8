"""The ten operators against brute force, and their cases: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import os
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute as B
from compare import DATA, compare, connect
from quire.llm import chat, debruijn, decontaminate, mixing, multi_index, pii, sharding, simhash, token_store, toxicity
from quire.llm.queries import load

SF = f"{DATA}/sf0.001"
CATALOG = load()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, id long, doc string, shard int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def made(spark, rows):
    """A table of (doc_id, text, source) rows with further columns whose names the operators also use."""
    return spark.createDataFrame([(d, t, "en", s, None, 1, 2, 3, "x", 4, "y") for d, t, s in rows], SCHEMA)


LONG = " ".join(f"w{i * i % 7919}" for i in range(30_000))
ODD = [(None, "a null id", "a"), (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (4, "one", "b"), (5, LONG, "b"), (6, LONG + " end", "c"),
       (7, "same text here", "c"), (7, "same text here", "c"), (8, "same text here", None), (9, "word " * 200, "c"),
       (10, "x" * 50_000, "c"), (11, "ünïcödé\u00a0nbsp \u2003em \x0bvt", "c"), (12, "<|endoftext|> a  b\n\n c", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return made(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return made(spark, [])


@pytest.mark.parametrize("key", [k for k, q in CATALOG.items() if q.sql])
def test_sql(spark, key):
    assert compare(CATALOG[key].run(spark, SF), CATALOG[key].sql, connect(SF)) == ""


# 1
def brute_place(node, key):
    import math
    import xxhash
    while node.children:
        draw = [-math.log((((xxhash.xxh64_intdigest(f"{c.name}:{key}".encode(), 42)) >> 11) + 0.5) / 2.0 ** 53) / c.weight for c in node.children]
        node = node.children[draw.index(min(draw))] if len(node.children) > 1 else node.children[0]
    return node.shard


def test_shards(spark, docs, rows):
    tree = sharding.balanced_tree()
    got = sharding.shard_documents(docs, tree, sharding.with_shard(tree)).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, B.crc(raw), "key")
        assert r["shard"] == brute_place(tree, r["doc_id"])
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_of_odd_rows(odd, none):
    got = sharding.shard_documents(odd, sharding.balanced_tree()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in ODD)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert len({(r["shard"], r["slot"]) for r in got}) == len(ODD)
    assert sharding.shard_documents(none, sharding.balanced_tree()).count() == 0


def test_weight_change_stays_in_its_subtree():
    tree = sharding.balanced_tree()
    region = tree.children[0]
    rack = region.children[0]
    heavy = sharding.Node(rack.name, (sharding.Node("shard0", (), 0, 3.0), rack.children[1]))
    changed = sharding.Node("root", (sharding.Node(region.name, (heavy, region.children[1])), tree.children[1]))
    for i in range(3000):
        a, b = brute_place(tree, i), brute_place(changed, i)
        if a != b:
            # into the region that grew; inside it only into its grown rack; inside that only into its grown shard
            assert b < 4 and (a >= 4 or b < 2) and (a >= 2 or b == 0)


# 2
def test_containment_of_odd_rows(spark, none):
    item = " ".join(f"t{i}" for i in range(20))
    broken = " ".join(f"t{i}" if i != 10 else "zz" for i in range(20))
    filler = " ".join(f"f{i}" for i in range(5000))
    rows = [(1, f"{filler} {item} {filler}", "a"), (2, broken, "a"), (3, item.upper(), "a"), (4, None, "a"), (5, "", "a"), (None, item, "a"),
            (6, "t0 t1", "a"), (6, "t0 t1", "a"), (7, LONG, "a"), (8, f"x {item[:40]}", "a")]
    items = [(0, item, "a"), (1, "t0 t1", "a"), (2, None, "a"), (3, "  ", "a"), (None, item, "a"), (4, " ".join(LONG.split()[9000:12000]), "a"), (5, "f7 f8 f9 f10 f11", "a")]
    docs, bench = made(spark, rows), made(spark, items)
    got = [(r["doc_id"], r["item_id"], r["shared"], r["item_shingles"]) for r in decontaminate.contained_items(docs, bench, item_col="doc_id").collect()]
    want = sorted(B.contained([(d, t) for d, t, _ in rows if d not in (None, 6)], [(i, t) for i, t, _ in items if i is not None]))
    assert sorted(x for x in got if x[0] not in (None, 6)) == want and {x[1] for x in want} == {0, 4, 5}
    assert [x for x in got if x[0] == 6] == [(6, 1, 1, 1)] * 2 and [x for x in got if x[0] is None] == [(None, 0, 16, 16)]
    left = decontaminate.drop_contaminated(docs, bench, item_col="doc_id")
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 8]
    assert decontaminate.contained_items(none, bench, item_col="doc_id").count() == 0
    assert decontaminate.contained_items(docs, none, item_col="doc_id").count() == 0
    assert decontaminate.drop_contaminated(docs, none, item_col="doc_id").count() == len(rows)


def test_documents_with_an_item_without_id_are_dropped(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = made(spark, [(1, f"before {item} after", "a"), (2, "t0 t1 t2", "a"), (None, item, "a"), (3, "u0 u1 u2 u3 u4 u5 u6", "a")])
    bench = spark.createDataFrame([(None, item), (None, "u1 u2 u3 u4 u5"), (None, None), (7, "elsewhere")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]
    named = bench.withColumnRenamed("text", "passage")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, named, item_text="passage").collect()] == [2]
    assert decontaminate.contained_items(docs, bench).count() == 0


def test_items_in_blocks(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = sorted(map(tuple, decontaminate.contained_items(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 300)
    assert sorted(map(tuple, decontaminate.contained_items(docs, bench).collect())) == want


# 3
def test_simhash(docs, rows):
    got = {tuple(r) for r in simhash.simhash_components(docs).collect()}
    assert got == B.simhash_rows(rows)


def test_covering_masks_miss_no_pair_within_the_radius():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(list(range(20)), radius)
        for a in range(20):
            for b in range(20):
                for c in range(20) if radius > 2 else (a,):
                    flips = (1 << a) | (1 << b if radius > 1 else 0) | (1 << c)
                    assert any(m & flips == 0 for m in masks)


def test_simhash_of_a_hot_bucket(spark):
    """Fingerprints around two centres, which meet in the same buckets, against all pairs."""
    rng = np.random.default_rng(3)
    fps = {0}
    for _ in range(150):
        fp = 0 if rng.random() < 0.5 else 0b11111
        for b in rng.choice(16, rng.integers(0, 5)):
            fp ^= 1 << int(b)
        fps.add(fp)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f, [f], [], 0, 1, []) for f in fps], "id long, sigs array<long>, wide array<long>, slack int, n int, few array<int>")
    got = {r["id"]: r["canon_id"] for r in simhash.covered_components(nodes, [2]).collect()}
    root = B.components(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {f: got.get(f, f) for f in fps} == {f: fps[root[i]] for i, f in enumerate(fps)}


def test_components_of_paths_stars_and_loops(spark):
    from quire.llm.components import components
    rng = np.random.default_rng(9)
    order = rng.permutation(3000).tolist()
    links = list(zip(order[:1000], order[1:1001])) + [(order[1500], x) for x in order[1501:2200]] + [(7, 7)] + [(-5, -9), (-9, -7), (-7, -5)]
    links += [(int(a), int(b)) for a, b in rng.choice(order[2300:], (300, 2))]
    got = {r["id"]: r["canon_id"] for r in components(spark.createDataFrame(links, "id_l long, id_r long")).collect()}
    least = {}
    for a, b in links:
        least[a], least[b] = a, b
    while True:
        before = dict(least)
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    assert got == {i: least[i] for i in {x for a, b in links if a != b for x in (a, b)}}
    assert components(spark.createDataFrame([], "id_l long, id_r long")).count() == 0


def test_simhash_of_odd_rows(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in ODD)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {1}
    assert {r["component_id"] for r in got if r["doc_id"] in (7, 8)} == {7}
    assert simhash.simhash_components(none).count() == 0


def test_near_duplicates(spark, docs, rows, none):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == B.near_groups(rows)
    base = [f"v{i}" for i in range(400)]
    rng = np.random.default_rng(1)
    near = []
    for d in range(60):  # a group of near copies, far fewer words changed than 0.8 allows for, and two texts apart
        w = list(base)
        for i in rng.choice(400, 4, replace=False):
            w[i] = f"n{d}"
        near.append((d + 10, " ".join(w), "s"))
    rows2 = near + [(1, "alone in the world", "s"), (2, None, "s"), (3, "", "s"), (None, "a null id", "s"), (4, LONG, "s"), (5, LONG, "s"), (5, LONG, "s")]
    got = [r["doc_id"] for r in simhash.drop_near_duplicates(made(spark, rows2)).collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == [1, 2, 4, 10, None]
    assert simhash.drop_near_duplicates(none).count() == 0


def edited_pairs():
    """Pairs of texts with 0.80 to 0.86 of their shingles in common: a block added, cut or replaced at the start, middle or end, or single words replaced."""
    rng, rows = np.random.default_rng(5), []
    for n in (30, 70, 200, 700):
        for kind in ("added", "cut", "replaced", "scattered"):
            for place in (0, n // 2, n):
                for _ in range(3):
                    d = len(rows) // 2
                    w = [f"d{d}w{i}" for i in range(n)]
                    block = [f"d{d}b{i}" for i in range(n)]
                    if kind == "added":
                        size = int(0.22 * (n - 4)) - 4 * (0 < place < n)
                        v = w[:place] + block[:size] + w[place:]
                    elif kind == "cut":
                        size = int(0.17 * (n - 4)) - 3 * (0 < place < n)
                        at = min(place, n - size)
                        v = w[:at] + w[at + size:]
                    elif kind == "replaced":
                        size = max(1, int(0.1 * (n - 4)) - 4 * (0 < place < n))
                        at = min(place, n - size)
                        v = w[:at] + block[:size] + w[at + size:]
                    else:
                        v = list(w)
                        for i in rng.choice(np.arange(2, n - 2), max(1, int(0.019 * n)), replace=False):
                            v[i] = block[i]
                    rows += [(2 * d, " ".join(w)), (2 * d + 1, " ".join(v))]
    return rows


def test_near_duplicates_with_edited_blocks(spark):
    rows = edited_pairs()
    sets = [set(B.shingles(t, 5)) for _, t in rows]
    share = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    wanted = [d for d, s in enumerate(share) if 0.8 <= s < 0.86]
    assert len(wanted) >= 80
    groups = simhash.near_duplicate_groups(made(spark, [(d, t, "s") for d, t in rows])).collect()
    group = {r["doc_id"]: r["group_id"] for r in groups}
    assert [d for d, s in enumerate(share) if (group[2 * d] == group[2 * d + 1]) != (s >= 0.8)] == []
    assert len(set(group.values())) == len(B.near_groups(rows))


def test_minima_of_a_part_agree_with_the_chance_of_the_similarity():
    rng, agreed = np.random.default_rng(3), []
    for n in (25, 60, 200, 800):
        for _ in range(50):
            both, left = simhash.W.mix(rng.integers(0, 1 << 63, n + n // 4).astype(np.uint64)), rng.integers(0, n // 4 + 1)
            a, b = both[:n + left], np.concatenate([both[:n], both[n + left:]])
            x, y = simhash._bands(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agreed.append((x == y).sum())
    expected = simhash.PARTS * 0.8 ** simhash.BAND
    assert min(agreed) >= 3 and abs(np.mean(agreed) - expected) < 0.08 * expected


# 4
def test_pii(spark, docs, rows):
    text = dict(rows)
    for r in pii.pii_digests(docs).collect():
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == B.pii_row(text[r["doc_id"]])


TRICKY = ["a@b.co, a.b+c%d@x-y.z.w@q.r", "x@@y.z a@b a@b.c.", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 1.2.3", "9" * 3000, "1." * 2000, "4111 1111 1111 1111 4111-1111-1111-1112",
          "4111111111111111 1", "+1 (202) 555-0100, +12 +1-2-3-4-5-6-7-8 +49.30.1234567.", "+" * 500 + "1 2 3", "@" * 500, "é@b.co ü+1 555 0100 222", "a" * 5000 + "@b.co",
          "000" * 700 + ".1.1.1", None, "", "٣.1.1.1.1", "1.1.1.1٣"]


def test_pii_of_tricky_texts():
    for t in TRICKY:
        spans = [s for s in pii.find_spans(t) if s.kind in pii.BASE]
        assert [(s.kind, s.start, s.end) for s in spans] == B.base_spans(t)


def test_pii_adds_validated_spans_and_keeps_base(spark, odd, none):
    text = "account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; social security 123-45-6789, part 123-45-6789x"
    assert [(s.kind, text[s.start:s.end]) for s in pii.find_spans(text)] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789"), ("ssn", "123-45-6789")]
    assert not pii.find_spans("order 123-45-6789")
    for t in ("AT61 1904 3002 3457 3201 BIC", "BE68 5390 0754 7034 USD", "to DE89370400440532013000, NO93 8601 1117 947.", "XX GB82 WEST 1234 5698 7654 32"):
        assert [s.kind for s in pii.find_spans(t) if s.kind == "iban"] == ["iban"] * (1 + ("NO93" in t))
    assert t[slice(*[s for s in pii.find_spans(t) if s.kind == "iban"][0][1:3])] == "GB82 WEST 1234 5698 7654 32"
    assert not [s for s in pii.find_spans("AT61 1904 3002 3457 3201BIC AT61 1904 3002 3457 32 AT62 1904 3002 3457 3201") if s.kind == "iban"]
    assert pii.redact(text, pii.find_spans(text)).startswith("account [iban] and GB82 WEST 1234 5698 7654 33; social security [ssn]")
    got = pii.pii_digests(odd).collect()
    assert len(got) == len(ODD) and {r["base_sha256"] for r in got} == {hashlib.sha256(b"").hexdigest()}
    assert pii.pii_digests(none).count() == 0


# 5
def digests(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in df.collect()}


def test_repeats(docs, rows):
    assert digests(debruijn.remove_repeats(docs)) == B.without_repeats(rows, 50)


def test_repeats_in_crossing_and_periodic_texts(spark):
    rng = np.random.default_rng(5)
    source = [f"s{i}" for i in rng.integers(0, 40, 4000)]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.integers(1, 6)):
            a = int(rng.integers(0, 3800))
            parts += source[a:a + int(rng.integers(5, 160))]
            if rng.random() < 0.4:
                parts += ["same"] * int(rng.integers(1, 90))
            if rng.random() < 0.4:
                parts += [f"own{d}-{i}" for i in range(rng.integers(1, 9))]
        rows.append((d, " ".join(parts), "s"))
    for window in (50, 20, 7):
        assert digests(debruijn.remove_repeats(made(spark, rows), window)) == B.without_repeats([r[:2] for r in rows], window)


def test_repeats_of_odd_rows(odd, none):
    got = debruijn.remove_repeats(odd).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_removed"] == 30_000 and by[6]["kept"] == "end" and by[9]["n_removed"] == 0 and by[1]["n_words"] == 0
    assert debruijn.remove_repeats(none).count() == 0


# 6
def test_top_k(spark, none):
    rng = np.random.default_rng(2)
    codes = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63 - 1, 300)] + [5] * 40 + [5 ^ (1 << i) for i in range(30)]
    rows = [(i, c) for i, c in enumerate(codes)] + [(None, 5), (9999, None), (0, codes[0])]
    base = spark.createDataFrame(rows, "id long, code long")
    queries = base.where("id % 50 = 0")
    got = {}
    for r in multi_index.hamming_top_k(base, queries, 7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["distance"], r["id"]))
    real = [(i, c) for i, c in rows if i is not None and c is not None]
    for q in {i for i, _ in real if i % 50 == 0}:
        best = sorted((((codes[q] ^ c) & (2 ** 64 - 1)).bit_count(), i) for i, c in real)[:7]
        want = [(n + 1, *x) for n, x in enumerate(best)]
        assert sorted(got[q]) == (want if q else sorted(want * 2))  # the query row that is there twice is answered twice
    few = spark.createDataFrame([(1, 1), (2, 3)], "id long, code long")
    assert multi_index.hamming_top_k(few, few, 5).count() == 4
    empty = few.where("false")
    assert multi_index.hamming_top_k(empty, few, 5).count() == 0 and multi_index.hamming_top_k(few, empty, 5).count() == 0


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.5],), ([1.0, None, 0.5],), ([1.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(multi_index.sign_code(F.col("v"), 3)).collect()] == [0b101, None, None, None]


# 7
def test_toxicity(spark, none):
    rng = np.random.default_rng(4)
    clean = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for d in range(600):
        w = [clean[i] for i in rng.integers(0, 60, rng.integers(5, 120))]
        if d % 4 == 0:
            w[int(rng.integers(0, len(w)))] = ["nasty", "vile", "rottenly"][d % 3]
        rows.append((d, " ".join(w), "s"))
        labels.append((d, int(d % 4 == 0)))
    docs, marked = made(spark, rows + [(None, None, "s"), (700, "", "s"), (5, LONG, "s")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, marked).collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and B.crc(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.9 * len(held)
    classifier = toxicity.fit(docs, marked)
    left = toxicity.drop_toxic(docs, classifier)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.collect()}
    assert sum(d in kept for d in range(600) if d % 4) >= 430 and sum(d in kept for d in range(0, 600, 4)) <= 15
    assert toxicity.drop_toxic(none, classifier).count() == 0
    assert toxicity.toxicity_scores(docs, marked.where("false")).count() == len(rows) + 3


def test_toxicity_is_fitted_on_all_labelled_rows(spark):
    """Long texts count as a whole, rows of any number are all dealt once, and the blocks do not depend on how rows lie."""
    long = " ".join(f"w{i}" for i in range(6_000))
    block, = toxicity.training_blocks(made(spark, [(1, long, "s"), (2, long + " end", "s")]), spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, toxic int")).collect()
    assert sorted(np.frombuffer(block["lengths"], "<i8").tolist()) == [6_000, 6_001]
    rows = [(d, None if d % 50 == 0 else f"some words {d % 7}", "s") for d in range(9_000)] + [(None, "x", "s"), (3, "again", "s")]
    marked = spark.createDataFrame([(d, d % 2) for d in range(9_000)] + [(4, 1), (None, 1)], "doc_id long, toxic int")
    used = [d for d, *_ in rows if d is not None and B.crc(str(d).encode()) % 5]
    seen = []
    for docs in (made(spark, rows).repartition(2), made(spark, rows).repartition(5)):
        blocks = toxicity.training_blocks(docs, marked, 20_000).orderBy("part").collect()
        assert len(blocks) > 3 and sum(len(b["lengths"]) // 8 for b in blocks) == len(used)
        assert sum(sum(b["toxic"]) for b in blocks) == sum(d % 2 or d == 4 for d in used)
        seen.append(blocks)
    assert seen[0] == seen[1]


def test_workers_hold_little_beside_their_rows():
    """What the encoder keeps of a piece is bounded in bytes, and the binary values of a block's row are not copied."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    from quire.llm import encoding
    letters = np.array(list("abcdefghij"))
    texts = [" ".join("".join(letters[list(map(int, str(1_000_000 + 7 * i + j)))]) for i in range(d * 4_000, d * 4_000 + 1_000) for j in range(7)) for d in range(60)]
    encode = encoding.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    table = pa.table({"draw": pa.array(range(60)), "text": texts, "lang": ["en"] * 60, "toxic": pa.array([0, 1] * 30, pa.int32()), "part": pa.array([0] * 60, pa.int32())})
    block = toxicity._block(table)
    two = pa.concat_tables([block, block]).combine_chunks().to_batches()[0].slice(1)
    row, = toxicity._rows([two])
    for c in ("lengths", "known", "numbers"):
        own = two.column(c).buffers()[2]
        assert own.address <= row[c].address < own.address + own.size and bytes(row[c]) == block.column(c)[0].as_py()
    tracemalloc.start()
    try:
        for text in texts[:20]:
            encode.encode(pa.array([text]))
        assert tracemalloc.get_traced_memory()[0] < 90 * 20 * 7_000
    finally:
        tracemalloc.stop()


def test_scores_do_not_see_labels_lang_or_order(spark):
    import pyarrow as pa
    words, first = toxicity.hashed_words(pa.array(["good Day, good-day", None, "", "x"]))
    assert first.tolist() == [0, 4, 4, 4, 5] and (words[0] == words[2]).all() and (words[1] == words[3]).all()
    net = toxicity.train([words[:4], words[4:]], np.array([1.0, 0.0]), epochs=1)
    together = toxicity.score_texts(net, [words[:4], words[:0], words[4:]])
    apart = [toxicity.score_texts(net, [x])[0] for x in (words[:4], words[:0], words[4:])]
    assert np.allclose(together, apart)


# 8
def test_chat(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    by = {}
    for r in rows.orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    by[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = CATALOG["op8_prefix_targets"].run(spark, SF).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == {c: B.chat_row(t) for c, t in by.items()}


def test_chat_of_odd_turns(spark, tmp_path):
    turns = [(1, 0, "system", "be\\kind <s>"), (1, 1, "user", None), (1, 2, "assistant", "[INST] \\</s>"), (1, 2, "assistant", "[INST] \\</s>"), (1, 3, "tool [/ROLE] ", "x"),
             (1, 4, None, ""), (1, 5, "assistant", ""), (None, 0, "assistant", "\\"), (2, None, "user", "u"), (2, 1, "assistant", "é" * 40_000)]
    df = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn int, role string, text string, start int, example string")
    path = str(tmp_path / "chat")
    chat.write_examples(df, path)
    got = {r["conv_id"]: r for r in chat.read_digests(spark, path).collect()}
    by = {}
    for c, _, role, text in turns:
        by.setdefault(c, []).append((role or "", text))
    for c, t in by.items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == B.chat_row(t)
    context, target = chat.render(spark, path, 1, 1)
    assert chat.unescape(target) == "[INST] \\</s>" and context.count("</s>") == 1 and context.startswith("<s>[SYS] ")
    assert spark.read.parquet(f"{path}/examples").count() == 5
    assert chat.chat_digests(df.where("false")).count() == 0


# 9
def test_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 5000), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    w, limit = {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {"a": 300, "b": 3000, "c": 30, "d": 0, None: 15000}
    open_, want, left = set(w), {}, 6110.0
    while True:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > limit[s]}
        if not over:
            break
        for s in over:
            want[s] = float(limit[s])
            left -= limit[s]
        open_ -= over
    assert got == pytest.approx(want | share)


def check_mix(got, limit=3):
    by = {}
    for r in got:
        x = by.setdefault(r["source"], [0, 0, r["target"], []])
        x[0] += r["size"]
        x[1] += r["taken"]
        x[3].append(r["size"])
        assert r["taken"] <= limit * r["size"] and r["taken"] == r["size"] * r["copies"]
    for source, (size, taken, target, own) in by.items():
        assert abs(taken - target) <= max(own) / 2 + 1e-6, source
    assert sum(x[2] for x in by.values()) == pytest.approx(sum(x[0] for x in by.values()))


def test_mix(spark, docs, odd, none):
    got = mixing.mix_documents(docs).collect()
    check_mix(got)
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs.orderBy(F.desc("n_chars"))).collect()}
    got = mixing.mix_documents(odd).collect()
    check_mix(got)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in ODD)
    assert mixing.mix_documents(none).count() == 0
    taken = Counter()
    for r in mixing.mix_documents(docs).collect():
        taken[r["doc_id"]] += r["copies"]
    repeated = mixing.repeat_documents(docs)
    assert repeated.columns == docs.columns and Counter(r["doc_id"] for r in repeated.collect()) == +taken
    assert mixing.repeat_documents(odd).count() == sum(r["copies"] for r in got)


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "w " * (4 if i % 2 else 40), "s" if i % 3 else "t") for i in range(3000)]
    got = mixing.mix_documents(made(spark, rows), tilt=0.3).collect()
    check_mix(got)
    short = [r["copies"] for r in got if r["source"] == "t" and r["size"] == 4]
    long = [r["copies"] for r in got if r["source"] == "t" and r["size"] == 40]
    assert np.mean(short) > np.mean(long)


# 10
def test_tokens(spark, docs, rows, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)

    def check(table, texts):
        got = token_store.token_digests(table, path).orderBy("start").collect()
        start = 0
        assert [r["doc_id"] for r in got] == [d for d, _ in texts]
        for r, (_, text) in zip(got, texts):
            ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), B.crc(ids.tobytes()))
            start += len(ids)

    check(docs, sorted(rows))
    check(odd, sorted(((d, t) for d, t, _ in ODD), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")))
    assert token_store.token_digests(none, path).count() == 0


def test_rank_codes():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2 ** 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_store.encode_ranks(ranks)
        assert len(control) == -(-n // 4) and (token_store.decode_ranks(control, data, n) == ranks).all()


def test_pieces_give_the_tokenizers_ids(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from quire.llm import encoding
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [" x", "x ", "", "a  b\n c d", "a\nb", "\nb c", "a \nb", "a\n b", "a\n\nb", "a.\nB, c", "x., y.. z", "1. 2, b.", "a\u00a0b c \u2003 d", "don't do 's 't", "a \x1c b", "\t a", "ab, <|endoftext|> c"]
    for kept in (encoding.CACHE_PIECES, 0):
        monkeypatch.setattr(encoding, "CACHE_PIECES", kept)
        enc = encoding.Encoder(path)
        for _ in range(2):
            ids, bounds = enc.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
