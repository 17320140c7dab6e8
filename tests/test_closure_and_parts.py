"""Ancestors over any depth and loops, falling lists of several parts, sketched quantiles, language profiles."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.operators.aggregates import collect_list_sorted, sketch_quantiles
from quire.operators.language import fit_language_profiles, language_id
from quire.operators.nested import partof_closure


def ancestors(edges):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for start in up:
        seen, level, depth = {}, up[start], 1
        while level:
            for x in level:
                seen.setdefault(x, depth)
            level = {y for x in level for y in up.get(x, ())} - set(seen)
            depth += 1
        out |= {(start, x, d) for x, d in seen.items()}
    return out


def test_closure_with_loops_and_a_hub(spark):
    rnd = random.Random(4)
    edges = {(f"n{rnd.randint(0, 40)}", f"n{rnd.randint(0, 40)}") for _ in range(50)} | {(f"c{i}", f"c{i + 1}") for i in range(70)} | {(f"leaf{i}", "c60") for i in range(200)} | {("x", "y"), ("y", "x"), ("z", "z")}
    df = spark.createDataFrame(list(edges) * 2 + [(None, "n1"), ("n1", None)], "child string, parent string")
    assert {tuple(r) for r in partof_closure(df).collect()} == ancestors(edges)
    assert partof_closure(df.limit(0)).count() == 0


def test_parts_of_a_list_go_on_in_its_order(spark):
    df = spark.createDataFrame([("k", i) for i in range(8)] + [("k", None), ("m", 3)], "key string, v int")
    for order, want in (("desc", [[7, 6, 5], [4, 3, 2], [1, 0]]), ("asc", [[0, 1, 2], [3, 4, 5], [6, 7]])):
        rows = collect_list_sorted(df, "key", "v", order, max_items=3).where("key = 'k'").orderBy("part_no").collect()
        assert [r["values"] for r in rows] == want and {(r["first_value"], r["n_values"]) for r in rows} == {(want[0][0], 8)}


def test_sketched_quantiles(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(3, 2, 20_000), np.full(10_000, 7.0)])  # a third of the rows are one value
    df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None), (float("nan"), None)], "a double, b double").repartition(9)
    got = {(r["column"], r["p"]): r["value"] for r in sketch_quantiles(df, ["a", "b"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    for p in (0.0, 0.1, 0.5, 0.99, 1.0):
        v = got["a", p]
        assert (x < v).mean() <= p + 0.006 and (x <= v).mean() >= p - 0.006 and got["b", p] is None


def test_language_profiles(spark):
    rnd = random.Random(3)
    words = {"de": ["der", "und", "straße", "größe", "nicht"], "en": ["the", "and", "street", "thing", "not"], "fr": ["été", "les", "façon", "une", "pas"]}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, rnd.randint(5, 30)), lang) for i, lang in enumerate(list(words) * 60)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(4)
    profiles = fit_language_profiles(df.where("id < 90").unionByName(df.limit(1).withColumn("lang", F.lit(None).cast("string"))), "text", "lang")
    assert profiles.languages == ["de", "en", "fr"]
    tested = df.where("id >= 90").unionByName(spark.createDataFrame([(900, None, "unknown"), (901, "", "unknown"), (902, " ab ", "unknown")], df.schema))
    assert all(r["language"] == r["lang"] for r in language_id(tested, "text", profiles).collect())
    nothing = fit_language_profiles(df.limit(0), "text", "lang")
    assert {r["language"] for r in language_id(tested, "text", nothing).collect()} == {"unknown"}
