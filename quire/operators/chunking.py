"""Text chunking: the recursive splitter runs inside Arrow batches, the fixed one in plain expressions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: separators from the coarsest to the finest
SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, sep: str) -> list[str]:
    """The text cut before every separator (each separator stays at the head of its piece)."""
    if sep == "":
        return list(text)
    head, *tail = text.split(sep)
    return [p for p in [head, *(sep + t for t in tail)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Neighbouring pieces packed into chunks of at most ``size``, repeating up to ``overlap`` at the seams."""
    window: deque[str] = deque()
    length = 0
    for piece in pieces:
        if window and length + len(piece) > size:
            yield "".join(window)
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.popleft())
        window.append(piece)
        length += len(piece)
    if window:
        yield "".join(window)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that makes them fit."""
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[level + 1:]
    chunks: list[str] = []
    run: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        chunks.extend(_pack(run, size, overlap))
        run = []
        chunks.extend(split_text(piece, size, overlap, finer))
    chunks.extend(_pack(run, size, overlap))
    return [c for c in (chunk.strip() for chunk in chunks) if c]


def chunk_recursive(df: DataFrame, id: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(id, chunk_text, chunk_index, total_chunks); blank texts give no row."""
    schema = T.StructType([T.StructField(id, df.schema[id].dataType), T.StructField("chunk_text", T.StringType()),
                           T.StructField("chunk_index", T.IntegerType()), T.StructField("total_chunks", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch[id], batch[text]):
                parts = split_text(body, size, overlap)
                rows.extend((key, part, i, len(parts)) for i, part in enumerate(parts))
            yield pd.DataFrame(rows, columns=schema.names)

    usable = df.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(id, text)
    return usable.mapInPandas(run, schema)


def chunk_fixed(df: DataFrame, id: str, text: str, size: int, overlap: int) -> DataFrame:
    """Fixed windows of ``size`` characters every ``size - overlap``; all in built-in expressions."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / F.lit(step)).cast("int"))
    parts = df.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(id, text, n.alias("total_chunks"))
    parts = parts.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total_chunks") - 1)))
    chunk = F.substring(F.col(text), F.col("chunk_index") * step + 1, F.lit(size))
    return parts.select(id, chunk.alias("chunk_text"), "chunk_index", "total_chunks")
