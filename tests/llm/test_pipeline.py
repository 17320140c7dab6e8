"""The pipeline against brute force, stage by stage, each judged on its own input."""

import os
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import brute as B
import corpus_pipeline
from compare import DATA
from quire.llm import mixing, toxicity
from quire.runtime import scratch_path

SF = f"{DATA}/sf0.001"


def test_every_stage_on_what_the_one_before_kept(spark):
    import public_tokenizers
    from tokenizers import Tokenizer
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, docs)
        assert name == "token-ids" or docs.columns == columns

    before, after = kept["toxicity"]
    classifier = toxicity.fit(before, labels)
    scores = toxicity.score_documents(before, classifier).collect()
    below = {r["doc_id"] for r in scores if r["_score"] < classifier.thresholds.get(r["lang"], classifier.thresholds[None])}
    assert {r["doc_id"] for r in after.collect()} == below

    before, after = kept["near-dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(B.near_groups(rows))

    before, after = kept["decontamination"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    hit = {d for d, *_ in B.contained(rows, items)}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, _ in rows if d not in hit)

    before, after = kept["mixing"]
    copies = Counter({r["doc_id"]: r["copies"] for r in mixing.mix_documents(before).collect()})
    assert Counter(r["doc_id"] for r in after.collect()) == +copies

    before, after = kept["token-ids"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start = 0
    got = after.orderBy("start").collect()
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    for r, (_, text) in zip(got, rows):
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), B.crc(ids.tobytes()))
        start += len(ids)

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, got))

    # columns that the stages' own names could meet come through with their values
    names = ["_score", "score", "_hit", "hit", "_copies", "copies", "_copy", "_text_key", "text_key", "DOC", "draw", "_row", "group_id", "keeper"]
    marked = kept["toxicity"][0].select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in names])
    plain = {r["doc_id"] for r in kept["toxicity"][1].collect()}
    for stage, own in ((lambda d: toxicity.drop_toxic(d, classifier), plain), (lambda d: corpus_pipeline.drop_near_copies(spark, d, SF), None),
                       (lambda d: corpus_pipeline.drop_benchmark(spark, d, SF), None), (lambda d: corpus_pipeline.mix_sources(spark, d, SF), None)):
        out = stage(marked)
        assert out.columns == marked.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names)
        assert own is None or {r["doc_id"] for r in got} == own
