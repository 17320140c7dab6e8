"""Periodic runs of words by descending-LCP Kruskal.

Suffixes of a document that share a prefix of at least ``l`` words form the classes of level ``l``. Going through the
common prefixes of neighbours in the suffix order from long to short, classes are united with union-find, each with the
ordered set of its positions. Where a union makes two positions at distance ``d`` neighbours, their common prefix is
exactly the level ``l``; with ``d <= l`` the text repeats with period ``d`` for ``d + l`` words from the first of them. A
run's start and the place one smallest period later become neighbours when they meet: a position between them would
give the run a smaller period. So every run is seeded once, at its start and with its smallest period.

Only runs of a stated length and exponent are wanted, so unions below the level that such runs need are left out: most
documents have no two places with that many words in common and are done after one look at hashes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string"


def least_level(min_length: int, min_exponent: int) -> int:
    """Words that a run's start and the place one period later have in common, at least, over all periods."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def suffix_ranks(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(rank of every suffix, rank of its first ``m`` entries) by prefix doubling; ``m`` is the largest power of two up to ``level``.

    ``x`` ends with an entry that occurs once; suffixes are told apart at the latest where such an entry is met.
    """
    order = np.argsort(x, kind="stable")
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.empty(len(x), dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    shared, m = rank.copy(), 1
    tied = order[~(new & np.append(new[1:], True))]
    while len(tied):
        after = rank[tied + m]
        by = np.lexsort((after, rank[tied]))
        tied, after = tied[by], after[by]
        old = rank[tied]
        group = np.ones(len(tied), dtype=bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= after[1:] != after[:-1]
        zero = np.flatnonzero(group)[np.cumsum(group) - 1]  # where the old group begins among the tied
        rank[tied] = old + np.flatnonzero(new)[np.cumsum(new) - 1] - zero
        m *= 2
        if m <= level:
            shared = rank.copy()
        tied = tied[~(new & np.append(new[1:], True))]
    return rank, shared


def _common_prefixes(x: list, at: np.ndarray, before: np.ndarray, least: int) -> list[int]:
    """Entries that the suffixes at ``at`` (ascending) and ``before`` share, ``least`` or more; each comparison goes on from the last."""
    out, last, n = [], -2, 0
    for i, j in zip(at.tolist(), before.tolist()):
        n = max(n - 1, least) if i == last + 1 else least
        while x[i + n] == x[j + n]:
            n += 1
        out.append(n)
        last = i
    return out


def _seeds(pairs: list[tuple[int, int, int]], size: int, place: list[int]) -> Iterator[tuple[int, int, int]]:
    """(position, distance, level) for neighbours at a distance within the level, as the classes of ``pairs`` are united in order.

    Within a periodic stretch earlier positions have longer prefixes in common, so most unions append to an ascending set.
    """
    parent = list(range(size))
    held: list[list[int] | None] = [[p] for p in place]

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b, level in pairs:
        a, b = find(a), find(b)
        large, small = held[a], held[b]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        parent[b], held[b] = a, None
        last = None  # the entry of the smaller set that was put in before: it has met this one already
        for n, p in enumerate(small):
            k = bisect_left(large, p)
            if k and large[k - 1] != last and p - large[k - 1] <= level:
                yield large[k - 1], p - large[k - 1], level
            if k < len(large) and large[k] - p <= level and (n + 1 == len(small) or small[n + 1] > large[k]):
                yield p, large[k] - p, level
            large.insert(k, p)
            last = p


def find_runs(hashes: np.ndarray, first: np.ndarray, min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, smallest period) of the maximal runs of each document, by start and period.

    ``hashes`` has a value per word, ``first`` the index of each document's first word and the end.
    """
    n_docs = len(first) - 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_docs)]
    least = least_level(min_length, min_exponent)
    words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), words)
    grams = W.run_hashes(hashes, least)
    at = np.arange(len(grams))
    at = at[at + least <= first[doc[:len(grams)] + 1]]
    grams = W.mix(grams[at] ^ W.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(grams)
    again = grams[order[1:]] == grams[order[:-1]]
    chosen = np.unique(doc[at[order[1:][again]]])
    if not len(chosen):
        return out

    # the chosen documents, each with an entry of its own at its end, smaller than all words
    ends = np.cumsum(words[chosen] + 1)
    begins = ends - words[chosen] - 1
    x = np.empty(ends[-1], dtype=np.int64)
    x[ends - 1] = np.arange(len(chosen))
    inner = np.ones(len(x), dtype=bool)
    inner[ends - 1] = False
    x[inner] = len(chosen) + np.unique(hashes[np.isin(doc, chosen)], return_inverse=True)[1]
    rank, shared = suffix_ranks(x, least)
    order = np.empty(len(x), dtype=np.int64)
    order[rank] = np.arange(len(x))
    linked = shared[order[1:]] == shared[order[:-1]]  # neighbours in the suffix order with that many words in common
    at, before = order[1:][linked], order[:-1][linked]
    by = np.argsort(at)
    at, before = at[by], before[by]
    listed = x.tolist()
    level = np.array(_common_prefixes(listed, at, before, 1 << (least.bit_length() - 1)), dtype=np.int64)
    keep = level >= least
    at, before, level = at[keep], before[keep], level[keep]
    place = np.unique(np.concatenate([at, before]))
    down = np.argsort(-level, kind="stable")
    pairs = list(zip(np.searchsorted(place, at[down]).tolist(), np.searchsorted(place, before[down]).tolist(), level[down].tolist()))
    for p, d, n in _seeds(pairs, len(place), place.tolist()):
        # if the words before agree too, the run begins further left and is seeded there; before a document is an entry of its own
        if d + n >= max(min_length, min_exponent * d) and listed[p - 1] != listed[p + d - 1]:
            k = int(np.searchsorted(begins, p, "right")) - 1
            out[chosen[k]].append((int(p - begins[k]), d + n, d))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def _collapse(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            data, offsets = W.text_bytes(part.column(1))
            start, end, first = W.word_bounds(data, offsets)
            runs = find_runs(W.word_hashes(data, start, end), first, min_length, min_exponent)
            change = np.zeros(len(start) + 1, dtype=np.int64)
            for zero, found in zip(first.tolist(), runs):
                for s, n, q in found:
                    change[zero + s + q] += 1
                    change[zero + s + n] -= 1
            kept = np.flatnonzero(np.cumsum(change)[:-1] == 0)
            # the bytes of the kept words, and the one byte after each of them that is not its document's last
            doc = np.searchsorted(first, kept, "right") - 1
            edge = np.zeros(len(data) + 1, dtype=np.int64)
            edge[start[kept]] += 1
            edge[end[kept]] -= 1
            mask = np.cumsum(edge)[:-1] > 0
            space = end[kept[:-1]][doc[1:] == doc[:-1]]
            mask[space] = True
            data = data.copy()
            data[space] = 0x20
            bounds = np.concatenate([[0], np.cumsum(mask)])[offsets].astype(np.int32)
            text = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[mask].tobytes()))
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in found] for found in runs]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), pa.array(rows, pa.list_(_RUN)), text],
                                             names=["doc_id", "n_words", "runs", "kept"])
    return run


def collapse_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, kept) for every row: the periodic runs of its whole text, and its words without their repeats.

    A run is a longest stretch of words with smallest period ``q`` and at least ``max(min_length, min_exponent * q)``
    words; ``runs`` lists (start, length, period) by start and period. ``kept`` has, joined by single spaces, the words
    that no run holds after its first ``q`` words. A null, empty or blank text has no words, no runs and an empty
    ``kept``; null ids and repeated rows are kept as rows of their own; other columns are ignored; an empty table
    gives no rows. Nothing is shuffled: a row is worked on by itself, in slices of a few megabytes or one text.
    """
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_collapse(min_length, min_exponent), _SCHEMA)


def repeat_tails(doc_id: Column, text: Column) -> Column:
    """The text of a tenth of the ids, chosen by CRC, with its tail replaced by repeats of the tail's beginning.

    With ``h`` the CRC of the id, ``g = h div 10`` and ``n`` words: if ``h % 10 = 0`` and ``n > 0``, word ``i`` from ``a = g % n`` on
    becomes word ``a + (i - a) % p``, ``p = 1 + (n - a) div (3 + g % 8)``. Other texts, and those of null ids, stay.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: w[
            F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")]), " ")).otherwise("")

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), F.transform(F.array(words), tail)[0]).otherwise(text)


def run_digests(collapsed: DataFrame) -> DataFrame:
    """The rows of ``collapse_runs`` as digests: the number of runs, the one of greatest exponent, and SHA-256 of runs and kept words."""
    def order(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        smaller = F.when(x > y, -1).when(x < y, 1)
        for key in ("start", "period"):
            smaller = smaller.when(a[key] < b[key], -1).when(a[key] > b[key], 1)
        return smaller.otherwise(0)

    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return collapsed.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                            F.sha2("kept", 256).alias("collapsed_sha256"), "n_words").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
