"""The best candidate of every name against all pairs judged by the rules."""

import random

from quire.operators.linkage import reconcile_names, reconcile_rules


def test_best_candidate_of_a_hot_surname(spark):
    rnd = random.Random(6)
    fore = ["Anna", "A", "Bert", "B. C", "Anna Maria", "A M", ""]
    date = ["", ", 1801-1870.", ", b. 1801", ", 1850-", ", 1801-"]
    names = [(i, f"{rnd.choice(['Hot'] * 8 + ['Rare', 'Lone' + str(i), ''])}, {rnd.choice(fore)}{rnd.choice(date)}") for i in range(120)]
    df = spark.createDataFrame(names + [(500, None), (501, "no comma")], "id long, name string")
    pairs = spark.createDataFrame([(a, x, b, y) for a, x in names for b, y in names if a != b], "id long, target string, candidate_id long, candidate string")
    order = {"high": 0, "medium": 1, "low": 2}
    best = {}
    for r in reconcile_rules(pairs).collect():
        if r["degree"] in order:
            best[r["id"]] = min(best.get(r["id"], (9, 0)), (order[r["degree"]], r["candidate_id"]))
    got = {r["id"]: (r["degree"], r["candidate_id"], r["candidate"], r["reconciled"]) for r in reconcile_names(df, "id", "name").collect()}
    assert len(got) == 122
    for i, name in [*names, (500, None), (501, "no comma")]:
        degree, other, text, good = got[i]
        if i in best:
            assert (order[degree], other) == best[i] and text == dict(names)[other] and good == (degree != "low")
        else:
            assert (degree, other, text, good) == ("none", None, None, False)
    assert {d for d, *_ in got.values()} == {"high", "medium", "low", "none"}
