"""Repeated passages by compaction of a sparse de Bruijn graph of word k-mers.

Nodes are anchor k-mers, picked by winnowing (the smallest hash of every ``w`` consecutive k-mers), an edge is the
token string from one anchor to the next. Every window of 50 words has at least one whole edge, with the same anchors
wherever the window occurs. Edges found in several documents are kept; consecutive edges that occur equally often,
and as often together, form one non-branching path and are compacted. The source coordinates of a path, and of the
windows that cross its ends, are then read from the texts again and compared by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.runtime import discard, durable

_LAST = (1 << 63) - 1  # stands for a null id: after all others
_LENGTH_BITS = 16  # of an edge's place: an edge has fewer than 65,536 words
_BASE = 0xA0761D6478BD642F
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _split(window: int) -> tuple[int, int]:
    """(k, w) such that a window holds two runs of ``w`` k-mers that share none, hence two anchors."""
    k = max(1, window // 8)
    return k, max(1, (window - k + 1) // 2)


def anchors(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> np.ndarray:
    """Positions of the k-mers that are the leftmost smallest of ``w`` consecutive ones within a document."""
    grams = W.run_hashes(hashes, k)
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    at = at[at + w + k - 1 <= first[doc[:n] + 1]]
    least = np.lib.stride_tricks.sliding_window_view(grams, w).argmin(axis=1)
    mark = np.zeros(len(hashes), dtype=bool)
    mark[at + least[at]] = True
    return np.flatnonzero(mark)


def _edges(window: int):
    k, w = _split(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            data, offsets = W.text_bytes(part.column(1))
            start, end, first = W.word_bounds(data, offsets)
            hashes = W.word_hashes(data, start, end)
            at = anchors(hashes, first, k, w)
            doc = np.searchsorted(first, at, "right") - 1
            same = np.flatnonzero(doc[:-1] == doc[1:])
            if not len(same):
                continue
            a, b, doc = at[same], at[same + 1] + k, doc[same]
            # a running sum names the token string [a, b) by its words and length, wherever it stands
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * W.power(_BASE, len(hashes)))])
            name = W.mix((total[b] - total[a]) * W.power(_BASE_INVERSE, len(hashes))[a] + (b - a).astype(np.uint64))
            place = (a - first[doc]) << _LENGTH_BITS | b - a
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(place), pa.array(name.view(np.int64))], names=["row", "place", "edge"])
    return run


def compacted_paths(docs: DataFrame, window: int) -> DataFrame:
    """(row, a, b, head, tail): maximal non-branching paths of edges that occur more than once.

    ``docs`` is (row, text) with a key per text. A path covers the words [a, b); its first edge ends at ``head``, its
    last one begins at ``tail``.
    """
    k, _ = _split(window)
    # a row is a key, a place (first word and length in one number) and the edge's name: 24 bytes
    edges = durable(docs.mapInArrow(_edges(window), "row long, place long, edge long"), "edges")
    # written, so that the join below deals both sides itself and can split a hot edge
    counts = durable(edges.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1"), "edge-counts")
    order = Window.partitionBy("row").orderBy("a")
    shared = edges.join(counts, "edge").select("row", "edge", "n", F.shiftright("place", _LENGTH_BITS).cast("int").alias("a"),
                                               (F.shiftright("place", _LENGTH_BITS) + F.col("place").bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))).cast("int").alias("b"))
    shared = shared.withColumn("before", F.lag(F.struct("edge", "n", "b")).over(order))
    # only the edge that starts at the last one's second anchor follows it
    follows = F.col("before.b") == F.col("a") + k
    shared = durable(shared.select("row", "a", "b", "edge", "n", F.when(follows, F.col("before.edge")).alias("prior"),
                                   F.when(follows, F.col("before.n")).alias("prior_n")), "shared-edges")
    discard(edges, counts)
    # both edges occur as often as they occur one after the other: a path goes on
    joints = durable(shared.where("prior is not null and prior_n = n").groupBy("prior", "edge").agg(F.count("*").alias("together"))
                     .where("together > 1"), "joints")
    linked = (shared.alias("s").join(joints.alias("j"), [F.col("s.prior") == F.col("j.prior"), F.col("s.edge") == F.col("j.edge")], "left")
              .select("s.row", "s.a", "s.b", F.coalesce((F.col("together") == F.col("n")) & (F.col("prior_n") == F.col("n")), F.lit(False)).alias("joined")))
    paths = linked.withColumn("path", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order))
    paths = durable(paths.groupBy("row", "path").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("b").alias("head"), F.max("a").alias("tail"))
                    .drop("path"), "paths")
    discard(shared, joints)
    return paths


def _claims(window: int):
    """Digests of each path that holds a window, and of the windows that hold an edge but lie in no path."""
    names = ["d1", "d2", "doc", "row", "place"]

    def of(doc, row, tokens: list[bytes], paths: list) -> Iterator[tuple]:
        want = np.zeros(max(len(tokens) - window + 1, 0), dtype=bool)
        for p in paths:
            # a window with an edge of the path holds its first or its last one, or lies within the path
            want[max(0, p["head"] - window):p["a"] + 1] = True
            want[max(0, p["b"] - window):p["tail"] + 1] = True
        long = [(p["a"], p["b"]) for p in paths if p["b"] - p["a"] >= window]
        for a, b in long:
            want[a:b - window + 1] = False
        for a, b in long + [(int(s), int(s) + window) for s in np.flatnonzero(want)]:
            name = hashlib.blake2b(b" ".join(tokens[a:b]), digest_size=16).digest()
            yield int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True), doc, row, a << 32 | b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, text=2):
            rows = []
            for doc, row, text, paths in zip(*(part.column(i).to_pylist() for i in range(4))):
                rows += of(doc, row, text.encode().split(), paths)
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
    return run


def repeated_spans(docs: DataFrame, window: int = 50) -> DataFrame:
    """(row, place): word spans all of whose ``window``-word windows also start in a document with a smaller id.

    ``docs`` is (doc, row, text): an id, a key per id and text, and the text, none of them null. ``place`` is the first
    word in the upper and the end in the lower 32 bits.
    """
    paths = compacted_paths(docs.select("row", "text"), window)
    # a document's paths are bounded by its own text
    own = paths.groupBy("row").agg(F.collect_list(F.struct("a", "b", "head", "tail")).alias("paths"))
    claims = durable(docs.join(own, "row").select("doc", "row", "text", "paths")
                     .mapInArrow(_claims(window), "d1 long, d2 long, doc long, row long, place long"), "claims")
    discard(paths)
    # a path or window starts first in the smallest document that claims the same words
    first = claims.groupBy("d1", "d2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("d1", "d2", "low")
    first = durable(first, "first-claims")
    spans = durable(claims.join(first, ["d1", "d2"]).where("low < doc").select("row", "place"), "repeats")
    discard(claims, first)
    return spans


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, text=1):
        out = []
        for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            tokens = (text or "").encode().split()
            gone = np.zeros(len(tokens), dtype=bool)
            for s in spans or ():
                gone[s >> 32:s & 0xFFFFFFFF] = True
            kept = [t for t, g in zip(tokens, gone.tolist()) if not g] if spans else tokens
            out.append((len(tokens), len(tokens) - len(kept), b" ".join(kept).decode()))
        n, removed, kept = zip(*out)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row: the text without the words of repeated windows.

    A word (run of bytes other than space, 0x09-0x0D, unchanged) goes when a window of ``window`` words that covers it
    also starts in a document with a smaller id; windows are those of the input. ``kept`` joins the other words by one
    space. A null text has no words; a null id comes after all others; rows of equal id never count as earlier, and
    repeated rows are kept and treated alike; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = rows.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text")
    spans = repeated_spans(keyed.select("doc", "row", "text"), window)
    own = spans.groupBy("row").agg(F.collect_set("place").alias("spans"))
    return keyed.join(own, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        _keep, "doc_id long, n_words long, n_removed long, kept string")
