"""Gazetteer phrases against a direct search, in one block and in several."""

import random
import re

import pytest

from quire.operators.entities import entity_mentions, phrase_matches


@pytest.mark.parametrize("max_chars", [2_000_000, 60])
def test_phrases_of_any_length(spark, max_chars):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice("abcd") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 30))], "kept") for i in range(60)] + [(99, None, "kept")]
    phrases = {" ".join(rnd.choice("abcd") * rnd.randint(1, 2) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 5) for _ in range(4)} | {" ".join(rows[3][1]), " ".join(rows[4][1][2:20])} - {""}
    df = spark.createDataFrame(rows, "id long, t array<string>, phrase string")
    names = spark.createDataFrame([(p,) for p in phrases] * 2 + [("",), (None,)], "phrase string")
    got = sorted((r[0], r[1]) for r in phrase_matches(df.drop("phrase").repartition(3), "t", names, ["id"], max_chars).collect())
    want = sorted((i, p) for i, t, _ in rows for p in phrases for n in [len(p.split())] for at in range(len(t or []) - n + 1) if " ".join(t[at:at + n]) == p)
    assert got == want and len({len(p.split()) for _, p in want}) > 4


def test_mentions_with_labels_and_years(spark):
    docs = spark.createDataFrame([(1, "Anna of the North Sea met Anna. In 1923 the North Sea rose!"), (2, None), (3, "")], "id long, text string")
    names = spark.createDataFrame([("anna", "PERSON"), ("north sea", "PLACE"), ("north sea", "WORK"), ("anna of the north sea", "WORK")], "entity_text string, entity_label string")
    got = sorted(tuple(r) for r in entity_mentions(docs, "id", "text", names).collect())
    assert got == sorted([(1, 0, "anna", "PERSON"), (1, 0, "anna", "PERSON"), (1, 0, "north sea", "PLACE"), (1, 0, "north sea", "WORK"),
                          (1, 0, "anna of the north sea", "WORK"), (1, 1, "1923", "DATE"), (1, 1, "north sea", "PLACE"), (1, 1, "north sea", "WORK")])
    assert entity_mentions(docs, "id", "text", names.limit(0)).count() == 1
