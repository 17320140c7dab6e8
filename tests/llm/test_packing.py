"""Packing: the plan against exhaustive search, the encoder against the library, the query against its contract."""

import functools
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import brute as B
from compare import DATA
from quire.llm import encoding, packing
from quire.llm.queries import load
from quire.runtime import scratch_path


def fewest(items, capacity):
    @functools.lru_cache(None)
    def go(rest):
        if not rest:
            return 0
        best, seen = len(rest), set()

        def fill(i, room, left):
            nonlocal best
            if left not in seen:
                seen.add(left)
                best = min(best, 1 + go(left))
            for k in range(i, len(left)):
                if left[k] <= room and (k == i or left[k] != left[k - 1]):
                    fill(k, room - left[k], left[:k] + left[k + 1:])
        fill(0, capacity - rest[0], rest[1:])
        return best
    return go(tuple(sorted(items, reverse=True)))


def bins_of(plan, counts, capacity):
    """The bins that the steps describe; every piece is placed once, without gaps."""
    fill, seen = {}, set()
    for length, rank, n, first, each, offset in plan.steps.tolist():
        for k in range(n):
            assert (length, rank + k) not in seen
            seen.add((length, rank + k))
            fill.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert seen == {(s, r) for s in range(len(counts)) for r in range(counts[s])} and set(fill) == set(range(plan.bins))
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return fill


def test_reduction_loses_nothing_and_plan_is_near_the_fewest():
    rnd, over, fixed = random.Random(3), 0, 0
    for _ in range(300):
        capacity = rnd.choice([10, 12, 15, 20, 30])
        items = [rnd.randint(1, capacity - 1) for _ in range(rnd.randint(0, 10))]
        counts = np.bincount(items, minlength=capacity + 1).astype(np.int64) if items else np.zeros(capacity + 1, dtype=np.int64)
        rest = counts.copy()
        sets = packing.reduce_counts(rest, capacity)
        best = fewest(items, capacity)
        assert sum(t for _, t in sets) + fewest([s for s in range(capacity + 1) for _ in range(rest[s])], capacity) == best
        assert all(sum(s) <= capacity for s, _ in sets)
        plan = packing.make_plan(counts, capacity)
        bins_of(plan, counts, capacity)
        assert plan.bound <= best <= plan.bins
        over, fixed = over + plan.bins - best, fixed + plan.fixed
    assert over <= 2 and fixed > 300


def test_plan_does_not_grow_with_the_counts():
    counts = np.bincount(np.minimum(np.random.default_rng(0).lognormal(5, 1, 5000).astype(int) + 1, 4095), minlength=4097)
    small, large = packing.make_plan(counts, 4096), packing.make_plan(counts * 1_000_000, 4096)
    bins_of(small, counts, 4096)
    assert len(large.steps) < 4 * len(small.steps) and large.bins <= 1.001 * large.bound and small.bins <= small.bound + 1


ALPHABET = ["a", "B", "word", "Word,", "'s", "'", "don't", "é", "×", " ", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "0", "12", "!", "…", "’",
            "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "Σ", "ς", "̈", "İ", "ß", "漢字", "😀", "​", "\r\n", "﻿"]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "space")])
def test_encoder_gives_the_librarys_ids(name, kind):
    import public_tokenizers
    enc = encoding.Encoder(public_tokenizers.path(name))
    assert enc.kind == kind
    rnd = random.Random(2)
    for _ in range(150):
        texts = ["".join(rnd.choice(ALPHABET) if rnd.random() < 0.9 else chr(rnd.choice([rnd.randint(1, 0x24F), rnd.randint(0x300, 0xD7FF)])) for _ in range(rnd.randint(0, 30)))
                 if rnd.random() < 0.9 else None for _ in range(20)]
        ids, bounds = enc.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == enc.tok.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        config = json.load(f)
    config["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(config), encoding="utf-8")
    enc = encoding.Encoder(str(path))
    assert enc.kind == ""
    texts = ["of the people, of the", None, "", "in the of the"]
    ids, bounds = enc.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [enc.tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_rows(rows, texts, tok, capacity, end_id=1):
    """Pieces as the contract cuts them, sequences without gaps within the capacity; the number of sequences."""
    want = []
    for doc_id, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        want += [(doc_id, k, k * capacity, len(part), B.crc(np.array(part, dtype="<u4").tobytes()))
                 for k, part in enumerate(ids[i:i + capacity] for i in range(0, len(ids), capacity))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(w[3] for w in want)


def test_query_against_its_contract(spark):
    import public_tokenizers
    sf = f"{DATA}/sf0.001"
    tok = encoding.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sequences, tokens = check_rows(load()["op11_dominance_packing"].run(spark, sf).collect(), texts, tok, 4096)
    assert sequences <= -(-tokens // 4096) + 1


def test_cases(spark):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [(None, "no id"), (None, "no id"), (1, None), (2, ""), (3, " \n"), (4, "a " * 63), (5, "a " * 64), (6, "a " * 1000), (7, "same one"), (7, "same one"),
             (8, "x" * 5000), *[(100 + i, "word " * (i % 9)) for i in range(200)]]
    docs = spark.createDataFrame([(d, t, 1, 2, "x", 3) for d, t in texts], "doc_id long, text string, row long, length long, ids string, offset int")
    out = scratch_path(spark, "packed")
    plan = packing.write_packed(docs, path, 1, out, capacity=64)
    sequences, _ = check_rows(packing.read_packed(spark, out).collect(), texts, encoding.tokenizer(path), 64)
    full = sum(r["length"] == 64 for r in packing.read_packed(spark, out).collect())
    assert sequences == plan.bins + full and plan.bins == plan.bound
    assert packing.packed_pieces(docs.limit(0), path).count() == 0
