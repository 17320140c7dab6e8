"""Pair joins against all pairs: small blocks, large blocks, copies, repeated and null ids; and what they shuffle."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quire.operators import components, similarity
from quire.operators.similarity import block_pairs
from quire.runtime import durable


def _rows():
    rng = random.Random(3)
    rows = []
    for i in range(160):
        keys = ["hot"] * (i % 3 == 0) + [f"k{rng.randrange(40)}", f"k{rng.randrange(40)}"]
        rows.append((i, keys, [f"t{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))] + [f"own{i}"] * (i % 5 == 0)))
    return rows + [(200 + i, *rows[i][1:]) for i in range(0, 40, 2)] + [(None, ["hot"], ["t1"]), (300, [], ["t1"]), (301, ["hot"], []), (200, *rows[0][1:])]


@pytest.mark.parametrize("direct", [0, 5, 1000])
def test_block_pairs_are_those_of_brute_force(spark, direct):
    rows = _rows()
    got = block_pairs(spark.createDataFrame(rows, "id long, keys array<string>, tokens array<string>"), 0.5, direct=direct).collect()
    kept, copies = {}, []
    for i, k, t in sorted((r for r in rows if r[0] is not None and r[1] and r[2]), key=lambda r: r[0]):
        unit = (frozenset(k), frozenset(t))
        if unit not in kept:
            kept[unit] = i
        elif i > kept[unit]:
            copies.append((kept[unit], i, 1.0))
    want = copies
    for ((k, t), i), ((l, u), j) in combinations(sorted(kept.items(), key=lambda x: x[1]), 2):
        if k & l and len(t & u) / len(t | u) >= 0.5 - 1e-9:
            want.append((i, j, len(t & u) / len(t | u)))
    assert sorted(map(tuple, got)) == sorted(want)


def test_block_pairs_are_judged_where_they_meet(spark):
    """Behind the join that pairs come from, nothing is shuffled."""
    out = block_pairs(spark.createDataFrame(_rows(), "id long, keys array<string>, tokens array<string>"), 0.5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Aggregate" not in plan  # the pairs, and the copies with their first


def test_refine_leaves_out_links_that_cannot_merge(spark, monkeypatch):
    written = []

    def counted(df, label="stage"):
        out = durable(df, label)
        written.extend([out.count()] if label == "links" else [])
        return out
    monkeypatch.setattr(components, "durable", counted)
    pairs = [(0, 1, 0.9), (2, 3, 0.9), (0, 2, 0.5), (0, 3, 0.5), (1, 2, 0.5), (1, 3, 0.5), (3, 4, 0.86), (2, 4, 0.1)]
    scored = spark.createDataFrame(pairs, "id_l long, id_r long, score double")
    got = components.cluster_refine(scored, spark.range(5), 0.85).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert written[0] == 8 and written[1] == 4 and written[-1] <= 1  # all, those within components, what is left


def test_carried_columns_are_those_of_both_records(spark):
    rows = [(i, k, t, f"name {i}", None if i == 7 else "x") for i, k, t in {r[0]: r for r in _rows()}.values() if i is not None]
    schema = "id long, keys array<string>, tokens array<string>, name string, type string"
    got = block_pairs(spark.createDataFrame(rows, schema), 0.5, direct=5, carry=("name", "type")).collect()
    plain = block_pairs(spark.createDataFrame(rows, schema), 0.5, direct=5).collect()
    assert sorted(r[:3] for r in map(tuple, got)) == sorted(map(tuple, plain))
    of = {r[0]: r for r in rows}
    assert all((r.name_l, r.type_l, r.name_r, r.type_r) == (*of[r.id_l][3:], *of[r.id_r][3:]) for r in got)


def test_pair_features_look_nothing_up_after_the_pairs(spark):
    from quire.plans.linkage_queries import _features
    plan = _features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Aggregate" not in plan


@pytest.mark.parametrize("pairs_at_once", [1, 50, 500_000])
def test_clusters_are_written_as_stars(spark, monkeypatch, pairs_at_once):
    written = {}

    def counted(df, label="stage"):
        out = durable(df, label)
        written.setdefault(label, out.count())
        return out
    monkeypatch.setattr(components, "durable", counted)
    monkeypatch.setattr(components, "PAIRS", pairs_at_once)
    pairs = [(10 * g + i, 10 * g + j, 0.5 + (i + j) / 100) for g in range(20) for i in range(10) for j in range(i + 1, 10)] + [(5, 15, 0.39), (None, 300, 0.9), (301, None, 0.8), (302, 303, None)]
    got = components.cluster_pairs(spark.createDataFrame(pairs, "id_l long, id_r long, score double").coalesce(1), 0.4).collect()
    want = [(10 * g + i, 10 * g, 0.5 + (i + 9 if i < 9 else 17) / 100) for g in range(20) for i in range(10)] + [(300, 300, 0.9), (301, 301, 0.8)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert pairs_at_once < 500_000 or written == {"stars": 202, "edges": 202}


@pytest.mark.parametrize("direct,page", [(0, 64), (5, 3), (1000, 1)])
def test_every_copy_is_paired_as_any_record_is(spark, monkeypatch, direct, page):
    monkeypatch.setattr(similarity, "PAGE", page)
    rows = {r[0]: r for r in _rows() if r[0] is not None}
    rows = [(i, k, t, f"name {i}") for i, k, t in rows.values()] + [(400 + i, *rows[3][1:], f"copy {i}") for i in range(9)] + [(None, *rows[3][1:], "none")]
    got = block_pairs(spark.createDataFrame(rows, "id long, keys array<string>, tokens array<string>, name string"), 0.5, direct=direct, carry=("name",), every=True).collect()
    want = []
    for (i, k, t, x), (j, l, u, y) in combinations(sorted(r for r in rows if r[0] is not None), 2):
        k, t, l, u = map(set, (k, t, l, u))
        if t | u and k & l and len(t & u) / len(t | u) >= 0.5 - 1e-9:
            want.append((i, j, len(t & u) / len(t | u), x, y))
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_ratios_of_all_copies(spark, tmp_path):
    from quire.plans.linkage_queries import fuzz_ratio_exact
    spark.createDataFrame([("blue gear", f"Brand#{i}") for i in range(2, 6)] + [("Blue gear", "Brand#2"), ("blue gears", "Brand#3"), ("red rod", "Brand#4")], "p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("Customer#01", 1)], "c_name string, c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([("Supplier#01", 1)], "s_name string, s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted(r["ratio"] for r in fuzz_ratio_exact(spark, str(tmp_path)).collect())
    # of six records all 15 pairs: copies, one other capital letter, one letter more, both
    assert got == sorted([100] * 6 + [89] * 4 + [95] * 4 + [84])


def test_scores_are_told_once_and_words_are_cut_per_record(spark, monkeypatch, tmp_path):
    from quire.plans.linkage_queries import _scored
    spark.createDataFrame([("blue gear", "Brand#2"), ("blue gears", "Brand#3")], "p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("Customer#01", 1), ("Customer#02", 2)], "c_name string, c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([("Supplier#01", 1)], "s_name string, s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    scored, plans = _scored(spark, str(tmp_path)), []
    assert not any(f in scored._jdf.queryExecution().optimizedPlan().toString().split("Join")[0] for f in ("split(", "regexp_extract_all("))
    monkeypatch.setattr(components, "durable", lambda df, label="stage": plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or durable(df, label))
    components.cluster_pairs(scored)
    assert plans[0].count("levenshtein(") - plans[0].split("Join")[-1].count("levenshtein(") == 2  # of the pairs and of the copies, which are a union


def test_features_are_those_of_carried_parts(spark):
    from quire.operators.linkage import label_parts, pair_features
    names = ["Smith, John, 1850-1900", "smith john 1850", "", "--", "Grey, Jane, b. 1900", "a a b"]
    one = label_parts(spark.createDataFrame([(n, "x") for n in names], "label string, type string"))
    side = lambda s, *cols: one.select(*[F.col(c).alias(f"{c}_{s}") for c in cols])
    carried = pair_features(side("l", "label", "type", "words", "years").crossJoin(side("r", "label", "type", "words", "years")))
    plain = pair_features(side("l", "label", "type").crossJoin(side("r", "label", "type")))
    assert carried.columns == plain.columns
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, plain.collect()))
    found = {(r["label_l"], r["label_r"]): (r["token_jaccard"], r["shared_year"]) for r in plain.collect()}
    assert found[names[0], names[1]] == (0.75, 1.0) and found["", "--"] == (0.0, 0.0) and found[names[0], names[4]] == (1 / 7, 1.0)
