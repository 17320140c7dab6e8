"""Phrases of a gazetteer in sentences, by an Aho-Corasick automaton built once per worker and block of phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.constants import YEAR_PATTERN
from quire.functions import text as X
from quire.operators.text import sentence_split
from quire.runtime import scratch_path

MAX_CHARS = 2_000_000  # of phrases in one block; its automaton takes some 200 MB in a worker

_automata: dict[str, object] = {}  # of this worker: the last block's only


def automaton(key: str, phrases: list[str]):
    """The automaton of the phrases, each between two spaces, that gives the number of a phrase where it ends."""
    if key not in _automata:
        import ahocorasick
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(phrases):
            built.add_word(f" {phrase} ", i)
        built.make_automaton()
        _automata.clear()
        _automata[key] = built
    return _automata[key]


def phrase_matches(df: DataFrame, tokens: str, phrases: DataFrame, carry: list[str], max_chars: int = MAX_CHARS) -> DataFrame:
    """(carry..., phrase): a row for every place where a phrase of ``phrases(phrase)`` stands in the words of ``tokens``.

    Phrases have any number of words, lower case with single spaces; overlapping and nested ones are all found. The
    phrases are cut into blocks of about ``max_chars`` characters by a hash, each goes through the driver to the workers alone;
    the texts are read once per block and not shuffled. Null and empty token arrays and phrases match nothing.
    """
    spark = df.sparkSession
    distinct = phrases.where(F.length("phrase") > 0).select("phrase").distinct()
    blocks = max(1, -(-(distinct.agg(F.sum(F.length("phrase"))).first()[0] or 0) // max_chars))
    lines = df.select(*carry, F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).alias("_line")).where(F.size(tokens) > 0)
    kept = lines.select(*carry).schema
    schema = lines.select(*carry, F.col("_line").alias("phrase")).schema

    def search(block: int) -> DataFrame:
        some = distinct.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block) if blocks > 1 else distinct
        shipped = spark.sparkContext.broadcast(sorted(r["phrase"] for r in some.collect()))
        key = f"{scratch_path(spark, 'automaton')}"  # a name of its own; nothing is written there

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from quire.operators import entities
            phrases = shipped.value
            if not phrases:
                return
            find = entities.automaton(key, phrases).iter
            for batch in batches:
                row, which = [], []
                for i, line in enumerate(batch.column(len(kept)).to_pylist()):
                    for _, n in find(line):
                        row.append(i)
                        which.append(n)
                take = batch.take(pa.array(np.array(row, dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([*take.columns[:len(kept)], pa.array([phrases[n] for n in which], pa.string())], names=schema.names)

        return lines.mapInArrow(run, schema)

    if blocks == 1:
        return search(0)
    path = scratch_path(spark, "phrases")  # one block after the other, so that one is in the driver and the workers at a time
    for block in range(blocks):
        search(block).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def entity_mentions(df: DataFrame, id: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(id, sentence_idx, entity_text, entity_label): gazetteer phrases of any number of words, and years (DATE).

    ``gazetteer`` has ``entity_text`` (lower case, single spaces) and ``entity_label``. One row per occurrence and label.
    """
    sents = sentence_split(df.select(id, text), id, text)
    found = phrase_matches(sents.select(id, "sentence_idx", X.tokens("sentence", 1).alias("_t")), "_t",
                           gazetteer.select(F.col("entity_text").alias("phrase")), [id, "sentence_idx"])
    labels = gazetteer.select(F.col("entity_text").alias("phrase"), "entity_label")
    named = found.join(labels, "phrase").select(id, "sentence_idx", F.col("phrase").alias("entity_text"), "entity_label")
    dates = sents.select(id, "sentence_idx", F.explode(F.regexp_extract_all(
        F.col("sentence"), F.lit(YEAR_PATTERN), F.lit(0))).alias("entity_text"), F.lit("DATE").alias("entity_label"))
    return named.unionByName(dates)
