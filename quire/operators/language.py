"""Language of a text by hashed byte 3-grams: profiles from one aggregate, scores by array look-up."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16  # of a hashed 3-gram
SLICE_BYTES = 1 << 20  # of text counted or scored at once, or one text


@dataclass(frozen=True)
class LanguageProfiles:
    """Log probabilities of the hashed 3-grams, languages x 2 ** BITS."""
    languages: list[str]
    weights: np.ndarray


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashed 3-grams of all texts, where each text's begin and the last one's end); no gram crosses two texts."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1, offset=4 * column.offset).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]].astype(np.uint32) if raw is not None else np.zeros(0, dtype=np.uint32)
    offsets -= offsets[0]
    if len(data) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    whole = np.ones(len(data), dtype=bool)
    ends = offsets[1:][np.diff(offsets) > 0]
    whole[ends - 1] = whole[np.maximum(ends - 2, 0)] = False
    hashed = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    return hashed[whole[:-2]], np.concatenate([[0], np.cumsum(whole)])[offsets]


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int]]:
    """(first row, row behind the last) of stretches with at most ``SLICE_BYTES`` of column ``at``, or one row."""
    offsets = np.frombuffer(batch.column(at).buffers()[1], dtype=np.int32, count=batch.num_rows + 1, offset=4 * batch.column(at).offset).astype(np.int64) if batch.num_rows else np.zeros(1)
    first = 0
    while first < batch.num_rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, end
        first = end


def _padded(text: str) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def fit_language_profiles(labelled: DataFrame, text: str, lang: str) -> LanguageProfiles:
    """Profiles of all rows with a language. Tasks add up their counts, so languages x 2 ** BITS rows at most are shuffled from each."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for first, end in _slices(batch, 1):
                part = batch.slice(first, end - first)
                names, own = np.unique(np.array(part.column(0).to_pylist(), dtype=str), return_inverse=True)
                grams, bounds = _grams(part.column(1))
                owner = np.repeat(own.astype(np.int32), np.diff(bounds))
                for i, name in enumerate(names.tolist()):
                    mine = np.bincount(grams[owner == i], minlength=1 << BITS)
                    total[name] = total[name] + mine if name in total else mine
        for name, counts in total.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(counts[some], pa.int64())], names=["lang", "gram", "n"])

    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _padded(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in counts})
    table = np.full((len(languages), 1 << BITS), 0.5)
    number = {name: i for i, name in enumerate(languages)}
    for r in counts:
        table[number[r["lang"]], r["gram"]] += r["n"]
    return LanguageProfiles(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def language_id(df: DataFrame, text: str, profiles: LanguageProfiles, min_chars: int = 5, out: str = "language") -> DataFrame:
    """Adds ``out``; texts of fewer than ``min_chars`` visible characters, or without any profile, are ``unknown``. One narrow pass."""
    names = df.columns
    shipped = df.sparkSession.sparkContext.broadcast((np.array(profiles.languages + ["unknown"], dtype=object), profiles.weights))  # languages x half a megabyte

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = shipped.value
        for batch in batches:
            for first, end in _slices(batch, len(names)):
                part = batch.slice(first, end - first)
                grams, bounds = _grams(part.column(len(names)))
                best = np.full(part.num_rows, len(languages) - 1)
                if len(weights):
                    sums = np.stack([np.concatenate([[0.0], np.cumsum(w[grams])])[bounds] for w in weights])
                    totals = np.diff(sums, axis=1)
                    best = np.where(np.asarray(part.column(len(names) + 1)) & (np.diff(bounds) > 0), totals.argmax(axis=0), best)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pa.array(languages[best].tolist(), pa.string())], names=[*names, out])

    long_enough = F.length(F.trim(F.coalesce(text, F.lit("")))) >= min_chars
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    return df.select(*[F.col(f"`{c}`") for c in names], _padded(text).alias("_padded"), long_enough.alias("_long")).mapInArrow(score, schema)
