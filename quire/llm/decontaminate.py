"""Benchmark items inside documents: size-partitioned MinHash containment, verified on exact shingles.

Items are partitioned by their number of shingles into classes (u/2, u]. For a class, every document is covered by
windows of 2u shingles that advance by u, so an item lies within one window and the Jaccard similarity of the two
is bounded below by the containment wanted, however long the document is. A window is a candidate for an item when
one of their minima agrees; candidates are counted exactly over the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.runtime import durable

PERMUTATIONS = 48       # an item at containment 0.8 is missed with a chance below 1 in 20,000
SMALL = 200_000         # hit texts, some 10 MB, up to which their list is sent to the tasks; a longer one is joined by shuffle
BLOCK_SHINGLES = 2_000_000  # shingles of benchmark items held by a task at once; more items take more passes

_MULTIPLIERS = W.mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64)) | np.uint64(1)
_FILTER = 18  # bits of a minimum looked up before the exact search


@dataclass(frozen=True)
class ItemBlock:
    """Shingle sets of some benchmark items, and their minima by size class."""

    ids: list[int]
    sets: list[np.ndarray]
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # u: sorted keys, item of each, filter bits


def _minima(values: np.ndarray) -> np.ndarray:
    return np.array([(values * m).min() for m in _MULTIPLIERS], dtype=np.uint64)


def item_block(ids: list[int], sets: list[np.ndarray]) -> ItemBlock:
    classes: dict[int, list] = {}
    for i, own in enumerate(sets):
        u = 1 << max(0, int(len(own) - 1).bit_length())
        # a minimum means something only within its permutation
        classes.setdefault(u, []).append(np.stack([_keyed(_minima(own)), np.full(PERMUTATIONS, i, dtype=np.uint64)]))
    out = {}
    for u, parts in classes.items():
        keys, items = np.concatenate(parts, axis=1)
        order = np.argsort(keys, kind="stable")
        bits = np.zeros(1 << _FILTER, dtype=bool)
        bits[(keys & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True
        out[u] = keys[order], items[order].astype(np.int64), bits
    return ItemBlock(ids, sets, out)


def _keyed(minima: np.ndarray) -> np.ndarray:
    """Minima (last axis: permutations) with the permutation mixed in."""
    return minima ^ _MULTIPLIERS


def _window_minima(values: np.ndarray, bounds: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(u, doc, minima): for each class the minima of all its windows.

    Windows are two neighbouring blocks of ``u`` shingles; block minima of a class come from those of a smaller one.
    """
    counts = np.diff(bounds)
    u = sizes[0]
    blocks = -(-counts // u)
    doc = np.repeat(np.arange(len(counts)), blocks)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    starts = bounds[doc] + u * (np.arange(len(doc)) - begin[doc])
    least = np.empty((len(doc), PERMUTATIONS), dtype=np.uint64)
    for p, m in enumerate(_MULTIPLIERS):
        least[:, p] = np.minimum.reduceat(values * m, starts)
    while True:
        if u in sizes:
            both = least.copy()
            inner = np.flatnonzero(doc[:-1] == doc[1:])
            both[inner] = np.minimum(least[inner], least[inner + 1])
            yield u, doc, both
        if u >= sizes[-1]:
            return
        first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(counts)))])
        head = np.flatnonzero((np.arange(len(doc)) - first[doc]) % 2 == 0)
        merged = least[head]
        two = np.flatnonzero(np.append(doc[:-1] == doc[1:], False)[head])
        merged[two] = np.minimum(merged[two], least[head[two] + 1])
        least, doc, u = merged, doc[head], 2 * u


def _candidates(block: ItemBlock, values: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
    found: set[tuple[int, int]] = set()
    if not len(values):
        return found
    for u, doc, minima in _window_minima(values, bounds, sorted(block.classes)):
        keys, items, bits = block.classes[u]
        minima = _keyed(minima)
        row, perm = np.nonzero(bits[(minima & np.uint64((1 << _FILTER) - 1)).astype(np.int64)])
        wanted = minima[row, perm]
        low, high = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        for r in np.flatnonzero(high > low):
            found.update((int(doc[row[r]]), int(i)) for i in items[low[r]:high[r]])
    return found


def _search(block: ItemBlock, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches, size=W.CHUNK_BYTES // 2):
            data, offsets = W.text_bytes(part.column(1), lower=True)
            start, end, first = W.word_bounds(data, offsets)
            values, bounds = W.shingles(W.word_hashes(data, start, end), first, k)
            rows = []
            for d, i in sorted(_candidates(block, values, bounds)):
                own = block.sets[i]
                shared = int(np.isin(own, values[bounds[d]:bounds[d + 1]]).sum())
                if shared >= threshold * len(own):
                    rows.append((d, block.ids[i], shared, len(own)))
            if rows:
                d, item, shared, size = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(item, pa.int64()), pa.array(shared, pa.int32()),
                                                  pa.array(size, pa.int32())], names=["doc_id", "item_id", "shared", "item_shingles"])
    return run


def _item_sets(items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for part in W.slices(batches):
            data, offsets = W.text_bytes(part.column(1), lower=True)
            start, end, first = W.word_bounds(data, offsets)
            values, bounds = W.shingles(W.word_hashes(data, start, end), first, k)
            sets = [np.unique(values[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()),
                                              pa.array([len(s) for s in sets], pa.int64())], names=["item_id", "grams", "n"])
    return (items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "item_id long, grams binary, n long").where("n > 0"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id",
                    text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment): items of which a document holds ``threshold`` or more.

    Containment is the share of an item's distinct ``shingle_words``-word shingles (A-Z lower-cased, words are runs of
    bytes other than space, 0x09-0x0D) that occur anywhere in the whole document. An item of fewer words is its word
    sequence, and is found in documents that are just that sequence. Items without an id or without words are left out; null or
    empty documents hold nothing; null document ids, repeated rows and repeated items are kept; other columns are
    ignored; an empty table on either side gives no rows.

    Documents are read in one narrow pass per block of items. Blocks are cut at ``BLOCK_SHINGLES``, so what reaches the
    tasks has a size bound whatever the size of the benchmark.
    """
    spark = docs.sparkSession
    sets = durable(_item_sets(items, shingle_words, item_col, item_text), "items")

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    for ids, grams in _blocks(sets):
        block = item_block(ids, grams)
        hits = texts.mapInArrow(_search(block, shingle_words, threshold), "doc_id long, item_id long, shared int, item_shingles int")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, shared int, item_shingles int")
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def _blocks(sets: DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """The items in blocks of at most ``BLOCK_SHINGLES`` shingles (or one item), one block in the driver at a time."""
    ids: list[int] = []
    grams: list[np.ndarray] = []
    held = 0
    for r in sets.select("item_id", "grams", "n").toLocalIterator():
        if held and held + r["n"] > BLOCK_SHINGLES:
            yield ids, grams
            ids, grams, held = [], [], 0
        ids.append(r["item_id"])
        grams.append(np.frombuffer(bytes(r["grams"]), dtype=np.uint64))
        held += r["n"]
    if ids:
        yield ids, grams


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Hits are found per text on both sides: rows with null or repeated ids are judged by their own texts, and an item
    counts whether it has an id or not. Other columns stay as they are, whatever their names.
    """
    item_text = options.get("item_text", "text")
    items = items.select(F.xxhash64(F.col(item_text)).alias("_item"), F.col(item_text).alias("_text"))
    options |= {"item_col": "_item", "item_text": "_text"}
    keyed = docs.select(F.xxhash64(F.col(text_col)).alias("_key"), F.col(text_col).alias("_text"))
    hit = contained_items(keyed, items, threshold, id_col="_key", text_col="_text", **options).select(F.col("doc_id").alias("hit")).distinct()
    hit = durable(hit, "contaminated")
    if hit.count() <= SMALL:
        hit = F.broadcast(hit)
    return docs.alias("d").join(hit.alias("h"), F.xxhash64(F.col(f"d.{text_col}")) == F.col("h.hit"), "left_anti").select("d.*")
