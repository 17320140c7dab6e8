"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into ``m`` segments of about log2(n) bits. If two codes differ in at most ``m * (s + 1) - 1`` bits, some
segment differs in at most ``s`` bits. Round ``s`` therefore probes every value at segment distance ``s``; a query is
finished when its k-th verified distance is at most ``m * (s + 1) - 1``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import durable

GROUP_QUERIES = 4_096   # codes asked for by one group, to which all codes are sent
GROUP_CODES = 4_000_000  # codes in one group; more of them are split
PACKED = 65_536         # codes in one row


def sign_code(vector: Column, dim: int) -> Column:
    """A code of one bit per entry, set where the entry is positive, as a signed 64-bit integer; null unless all ``dim`` entries are there."""
    if dim > 64:
        raise ValueError("codes have at most 64 bits")
    bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for i in range(dim)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return F.when((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()), code)


def segment_widths(bits: int, n: int) -> list[int]:
    """Widths of the segments for ``n`` codes: about log2(n) bits each, 20 at most, as equal as they can be."""
    width = min(20, max(4, math.log2(max(n, 2))))
    m = max(1, round(bits / width))
    return [bits // m + (i < bits % m) for i in range(m)]


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """(code, id): the ``k`` smallest ids of every code. Ranks are limited before and after the shuffle, so a hot code is cut early."""
    w = Window.partitionBy("code").orderBy("id")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PACKED):
            code, held = (np.asarray(batch.column(c).slice(at, PACKED)) for c in range(2))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (code.astype("<i8"), held.astype("<i4"))], names=["codes", "held"])


class _Segments:
    """Distinct codes in the order of the values of each segment."""

    def __init__(self, codes: np.ndarray, held: np.ndarray, widths: list[int]):
        self.codes, self.held, self.widths = codes.view(np.uint64), held.astype(np.int64), widths
        self.lows = [sum(widths[:j]) for j in range(len(widths))]
        self.order, self.first, self.masks = [], [], {}
        for j, w in enumerate(widths):
            value = self.part(self.codes, j)
            self.order.append(np.argsort(value, kind="stable").astype(np.int32))
            self.first.append(np.append(0, np.cumsum(np.bincount(value.astype(np.int64), minlength=1 << w))).astype(np.int32))
        self.ones = {w: np.bitwise_count(np.arange(1 << w, dtype=np.uint32)) for w in set(widths)}

    def part(self, codes, j: int):
        return (codes >> np.uint64(self.lows[j])) & np.uint64((1 << self.widths[j]) - 1)

    def flips(self, w: int, s: int) -> np.ndarray:
        """The numbers of ``w`` bits of which ``s`` are set."""
        if (w, s) not in self.masks:
            self.masks[w, s] = np.flatnonzero(self.ones[w] == s)
        return self.masks[w, s]

    def nearest(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, distance) of all codes up to the distance at which ``k`` ids are known, or all ids there are."""
        q, m, wanted = np.uint64(code & ((1 << 64) - 1)), len(self.widths), min(k, int(self.held.sum()))
        rows, distances, bound = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 64
        for s in range(max(self.widths) + 1):
            for j, w in enumerate(self.widths):
                value = self.flips(w, s) ^ int(self.part(q, j))
                begin, end = self.first[j][value], self.first[j][value + 1]
                some = np.flatnonzero(end > begin)
                begin, many = begin[some].astype(np.int64), (end[some] - begin[some]).astype(np.int64)
                row = self.order[j][np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())]
                apart = self.codes[row] ^ q
                distance = np.bitwise_count(apart).astype(np.int64)
                near = distance <= bound
                row, apart, distance = row[near], apart[near], distance[near]
                # seen once: in the first of its nearest segments
                gaps = np.array([np.bitwise_count(self.part(apart, i)) for i in range(m)]).reshape(m, -1)
                new = (gaps[:j] > s).all(axis=0) & (gaps[j + 1:] >= s).all(axis=0)
                rows, distances = np.append(rows, row[new]), np.append(distances, distance[new])
            by = np.argsort(distances, kind="stable")
            known = np.cumsum(self.held[rows[by]])
            if len(known) and known[-1] >= wanted:
                bound = int(distances[by][np.searchsorted(known, wanted)])
                keep = distances <= bound
                rows, distances = rows[keep], distances[keep]
                if bound <= m * (s + 1) - 1:
                    break
        return rows, distances


def hamming_top_k(base: DataFrame, queries: DataFrame, k: int, bits: int = 64) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` ids nearest to each query by Hamming distance, ties by smaller id.

    ``base`` and ``queries`` are (id, code) with ``code`` a signed 64-bit integer; rows with a null id or code are
    left out; repeated rows count as often as they occur; a base of fewer than ``k`` rows gives them all; an empty
    table on either side gives no rows.

    Equal codes are one entry that stands for its ``k`` smallest ids, so copies are met once. All codes, a dozen bytes each, go to
    groups of queries; a group sorts them by the values of each segment and makes all rounds of its queries there, so probes
    are never written or shuffled. Only the codes within a query's k-th distance leave a group.
    """
    base = base.select("id", "code").where("id is not null and code is not null")
    queries = durable(queries.select(F.col("id").alias("query_id"), "code").where("id is not null and code is not null"), "hamming-queries")
    ids = durable(_smallest_ids(base, k), "hamming-ids")
    codes = durable(ids.groupBy("code").agg(F.count("*").alias("held")), "hamming-codes")
    distinct = codes.count()
    if not distinct:
        return queries.where("false").select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0).alias("distance"))
    widths, splits = segment_widths(bits, distinct), -(-distinct // GROUP_CODES)
    # one search per distinct query code
    pending = durable(queries.select(F.col("code").alias("q")).distinct(), "hamming-pending")
    groups = max(-(-pending.count() // GROUP_QUERIES), 2 * base.sparkSession.sparkContext.defaultParallelism)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    packed = durable(codes.select("code", "held").mapInArrow(_pack, "codes binary, held binary"), "hamming-packed")
    left = pending.select("q", F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("a"), every(splits).alias("r"))
    right = packed.select("codes", "held", F.pmod(F.xxhash64("codes"), F.lit(splits)).cast("int").alias("r"), every(groups).alias("a"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [[np.zeros(0, dtype=np.int64)] for _ in range(4)]
        if left.num_rows and right.num_rows:
            index = _Segments(*(np.frombuffer(b"".join(right.column(c).to_pylist()), dtype=kind) for c, kind in (("codes", "<i8"), ("held", "<i4"))), widths)
            for q in left.column("q").to_pylist():
                row, distance = index.nearest(q, k)
                for out, some in zip(found, (np.full(len(row), q), index.codes[row].view(np.int64), index.held[row], distance)):
                    out.append(some)
        return pa.table([pa.array(np.concatenate(c), t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["q", "code", "held", "distance"])

    best = left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(meet, "q long, code long, held long, distance int")
    if splits > 1:
        best = _within_kth(durable(best, "hamming-best"), k)
    hits = best.join(ids, "code").select("q", "id", "distance")
    w = Window.partitionBy("query_id", "_copy").orderBy("distance", "id")
    named = queries.withColumn("_copy", F.monotonically_increasing_id()).join(hits, F.col("code") == F.col("q")).select("query_id", "_copy", "id", "distance")
    return (named.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance"))


def _within_kth(best: DataFrame, k: int) -> DataFrame:
    """The codes of each query up to the distance at which ``k`` ids are known, with all that tie there."""
    by = best.groupBy("q", "distance").agg(F.sum("held").alias("n"))
    w = Window.partitionBy("q").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    keep = by.withColumn("nearer", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("nearer") < k).select("q", "distance")
    return best.join(keep, ["q", "distance"]).select("q", "code", "held", "distance")
