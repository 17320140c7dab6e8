"""Best-fit packing of token pieces after a Martello-Toth dominance reduction.

Only lengths matter to a packing, and there are at most ``capacity`` of them, so the plan is made in the driver from one
count per length, whatever the number of documents. A feasible set that dominates every other feasible set holding its
largest piece can be fixed without loss; sets of one, two or three pieces are tested, and fixed as often as the counts
allow. What is left is packed by best fit, longest first, all bins of equal room at once. The plan numbers the pieces of
a length from 0 and says for ranges of these numbers which bins they fill; Spark ranks the pieces and carries them there.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import encoding
from quire.llm import words as W
from quire.runtime import discard, durable, scratch_path

_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
_SEQUENCES = ("sequence_id long, id_bytes int, ids binary, "
              "pieces array<struct<doc_id:long,piece:int,start:long,length:long,offset:long>>")
_PIECES = "doc_id long, piece int, start long, length long, id_bytes int, ids binary, row long, full boolean"
_RANK_BITS = 48  # of a piece's number among those of its length


# --- the plan, from counts by length

def _room_filler(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, ...] | None:
    """The sizes that, next to a fixed piece, dominate every set of further pieces within ``room``; None if no such set of two or fewer is found.

    ``sizes`` ascend, all at most ``room``; ``counts`` are of the pieces still free. () if none fits.
    """
    if not len(sizes):
        return ()
    large = int(sizes[-1])
    if large == room:
        return (large,)
    # the best pair: for each size the largest partner beside it, one of its own only where there are two
    last = np.searchsorted(sizes, room - sizes, "right") - 1
    own = np.arange(len(sizes))
    last = np.where((last == own) & (counts < 2), last - 1, last)
    last = np.where((last > own) | (last == own) & (counts >= 2), last, np.minimum(last, own - 1))
    pairs = np.where(last >= 0, sizes + sizes[last], 0)
    three = np.repeat(sizes[:3], np.minimum(counts[:3], 3))[:3]
    more = len(three) == 3 and int(three.sum()) <= room
    if pairs.max() <= large and not (more and _reaches(sizes, counts, large + 1, room)):
        return (large,)
    if more:
        return None
    # at most two fit: the largest with its largest partner dominates pairs whose smaller one is no larger than that partner
    b = int(sizes[last[-1]]) if last[-1] >= 0 else 0
    smaller = np.minimum(sizes, sizes[last])
    if b and not np.any((last >= 0) & (smaller > b) & (pairs > large)):
        return (large, b)
    return None


def _reaches(sizes: np.ndarray, counts: np.ndarray, low: int, high: int) -> bool:
    """Whether some of the pieces add up to ``low`` to ``high``: subset sums as bits."""
    mask, window = (1 << high + 1) - 1, (1 << high + 1) - (1 << low)
    sums = 1
    for s, n in zip(sizes.tolist(), counts.tolist()):
        n, k = min(n, high // s), 1
        while n > 0:
            take = min(k, n)
            sums |= sums << s * take & mask
            n, k = n - take, 2 * k
        if sums & window:
            return True
    return False


def reduce_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sets fixed by dominance, with multiplicity, longest piece first; ``counts`` (by length) is left with the rest.

    A set with the piece ``w`` dominates another if the pieces of the other can be dealt to pieces of the set that are
    at least as long as what they get. Dominance stays true while pieces vanish, so a set is fixed as often as it can be.
    """
    fixed, changed = [], True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            if not counts[w]:
                continue
            counts[w] -= 1
            sizes = np.flatnonzero(counts[:capacity - w + 1])
            rest = _room_filler(sizes, counts[sizes], capacity - w)
            counts[w] += 1
            if rest is None:
                continue
            chosen = Counter((w, *rest))
            times = min(int(counts[s]) // k for s, k in chosen.items())
            for s, k in chosen.items():
                counts[s] -= k * times
            fixed.append(((w, *rest), times))
            changed = True
    return fixed


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing of the counted pieces needs, by the best of all dual feasible splits at a length up to half the capacity."""
    sizes = np.arange(len(counts))
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    best = -(-int(weight[-1]) // capacity)
    half = capacity // 2
    for a in range(1, half + 1):
        n1 = number[-1] - number[capacity - a]
        n2 = number[capacity - a] - number[half]
        w2, w3 = weight[capacity - a] - weight[half], weight[half] - weight[a - 1]
        best = max(best, int(n1 + n2 + max(0, -(-(int(w3) - (int(n2) * capacity - int(w2))) // capacity))))
    return best


@dataclass(frozen=True)
class Plan:
    """Steps: pieces ``rank .. rank + n - 1`` of ``length`` fill bins from ``bin`` on, ``each`` to a bin, from ``offset`` in it."""
    steps: np.ndarray  # columns length, rank, n, bin, each, offset
    bins: int
    bound: int  # no packing needs fewer bins
    fixed: int  # bins fixed by dominance


def make_plan(counts: np.ndarray, capacity: int) -> Plan:
    """The packing of ``counts[length]`` pieces. Its steps number a few per length and bin shape, not per piece."""
    counts = counts.astype(np.int64).copy()
    used = np.zeros(len(counts), dtype=np.int64)
    steps, bins = [], 0

    def put(length: int, n: int, first_bin: int, each: int, offset: int) -> None:
        steps.append((length, int(used[length]), n, first_bin, each, offset))
        used[length] += n

    for chosen, times in reduce_counts(counts, capacity):
        offset = 0
        for s in chosen:
            put(s, times, bins, 1, offset)
            offset += s
        bins += times
    fixed, bound = bins, bins + lower_bound(counts, capacity)

    rooms: list[int] = []                      # rooms that open bins have, ascending
    open_: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first bin, bins)

    def hold(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((first, n))

    for w in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[w])
        while n:
            k = bisect_left(rooms, w)
            if k < len(rooms):
                room = rooms[k]
                first, have = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, first, have = capacity, bins, -(-n // (capacity // w))
                bins += have
            each = room // w
            full = min(have, n // each)
            if full:
                put(w, full * each, first, each, capacity - room)
                hold(room - each * w, first, full)
            left = min(n - full * each, each) if full < have else 0
            if left:
                put(w, left, first + full, left, capacity - room)
                hold(room - left * w, first + full, 1)
            hold(room, first + full + (left > 0), have - full - (left > 0))
            n -= full * each + left
    return Plan(np.array(steps, dtype=np.int64).reshape(-1, 6), bins, bound, fixed)


# --- carried out on Spark; ids of a piece or a sequence are one zstd frame in files and shuffles

def _compressed(ids: bytes | np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=6).compress(ids, asbytes=True)


def _plain(frame: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(frame, size, asbytes=True)


def _cut(path: str, end_id: int, capacity: int):
    """Rows (doc_id, piece, start, length, id_bytes, ids): each text's ids with the end id, cut after every ``capacity``, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(path)
        wide = max(enc.tok.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16
        size, kind = (4, "<u4") if wide else (2, "<u2")
        for part in W.slices(batches, size=1 << 20):
            ids, bounds = encoding.with_end(*enc.encode(part.column(1)), end_id)
            pieces = -(-np.diff(bounds) // capacity)
            doc = np.repeat(np.arange(part.num_rows), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            ends = np.minimum(bounds[doc] + start + capacity, bounds[doc + 1])
            ids = ids.astype(kind)
            raw = pa.array([_compressed(ids[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(ends - bounds[doc] - start, pa.int64()),
                 pa.array(np.full(len(doc), size), pa.int32()), raw], names=["doc_id", "piece", "start", "length", "id_bytes", "ids"])
    return run


def _place(plan: Plan):
    steps = plan.steps[np.lexsort((plan.steps[:, 1], plan.steps[:, 0]))]
    keys = steps[:, 0] << _RANK_BITS | steps[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            length_, first, _, bin_, each, offset = steps[np.searchsorted(keys, length << _RANK_BITS | rank, "right") - 1].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bin_ + nth // each), pa.array(offset + nth % each * length_)],
                                             names=["row", "sequence_id", "offset"])
    return run


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sequence_id, offset, doc_id, piece, start, length, id_bytes, ids) in order of sequence and offset, one row per sequence."""
    held: list[tuple] = []
    out: list[tuple] = []

    def row(parts: list[tuple]) -> tuple:
        size = parts[0][6]
        ids = parts[0][7] if len(parts) == 1 else _compressed(b"".join(_plain(p[7], size * p[5]) for p in parts))
        return (parts[0][0], size, ids,
                [{"doc_id": p[2], "piece": p[3], "start": p[4], "length": p[5], "offset": p[1]} for p in parts])

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()),
                                           pa.array(columns[3], pa.list_(_PIECE))], names=["sequence_id", "id_bytes", "ids", "pieces"])

    for part in batches:
        for r in zip(*(c.to_pylist() for c in part.columns)):
            if held and held[0][0] != r[0]:
                out.append(row(held))
                held = []
                if len(out) == 256:
                    yield batch()
            held.append(r)
    if held:
        out.append(row(held))
    if out:
        yield batch()


def write_packed(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, capacity: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> Plan:
    """Write ``docs`` packed into sequences of at most ``capacity`` ids at ``path``; the plan is returned.

    Every whole text is encoded, ``end_id`` appended, and only longer ones are cut, into full pieces and a last shorter
    one. A full piece is a sequence at once and stays as it is written (folder ``pieces``); rows of ``sequences`` have a sequence_id, ids (a zstd
    frame of little-endian numbers, ``id_bytes`` each) and the pieces in them (doc_id, piece, start, length, offset), without gaps. A null or empty text is the end id alone; null ids and
    repeated rows are documents of their own; other columns are ignored; an empty table gives an empty folder of files.
    Texts are encoded once and never shuffled; ids of shorter pieces are, twice. Pieces are ranked within their length by a range sort of
    (length, row), so a length that a third of all pieces have is dealt to many tasks.
    """
    spark = docs.sparkSession
    (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
     .mapInArrow(_cut(tokenizer_path, end_id, capacity), "doc_id long, piece int, start long, length long, id_bytes int, ids binary")
     .withColumn("row", F.monotonically_increasing_id()).withColumn("full", F.col("length") == capacity)
     .write.option("compression", "uncompressed").partitionBy("full").parquet(f"{path}/pieces"))
    short = spark.read.schema(_PIECES).parquet(f"{path}/pieces").where("not full")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in short.groupBy("length").count().collect():  # one row per length
        counts[r["length"]] = r["count"]
    plan = make_plan(counts, capacity)

    ordered = durable(short.select("row", "length").repartitionByRange("length", "row")
                      .sortWithinPartitions("length", "row").withColumn("at", F.monotonically_increasing_id()), "pack-order")
    # a partition holds runs of lengths; "at" is consecutive within it, so a run's first one is its zero
    part = F.shiftrightunsigned("at", 33)
    runs = ordered.groupBy(part.alias("part"), "length").agg(F.min("at").alias("zero"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    ranked = ordered.withColumn("part", part).join(runs, ["part", "length"]).select("row", "length", (F.col("before") + F.col("at") - F.col("zero")).alias("rank"))
    placed = durable(ranked.mapInArrow(_place(plan), "row long, sequence_id long, offset long"), "pack-places")

    packed = short.join(placed, "row").select("sequence_id", "offset", "doc_id", "piece", "start", "length", "id_bytes", "ids") \
        .repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    packed.mapInArrow(_sequences, _SEQUENCES).write.option("compression", "uncompressed").parquet(f"{path}/sequences")
    discard(ordered, placed)
    short.scratch = f"{path}/pieces/full=false"
    discard(short)
    return plan


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_id, id_bytes, ids, pieces) of all sequences at ``path``; a full piece has a negative number."""
    piece = F.struct("doc_id", "piece", "start", "length", F.lit(0).cast("long").alias("offset"))
    full = spark.read.schema(_PIECES).parquet(f"{path}/pieces").where("full")
    return spark.read.schema(_SEQUENCES).parquet(f"{path}/sequences").unionByName(
        full.select((-1 - F.col("row")).alias("sequence_id"), "id_bytes", "ids", F.array(piece).alias("pieces")))


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece, from the sequences' ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for i in range(part.num_rows):
                size, rows = part.column(1)[i].as_py(), part.column(3)[i].values
                offset, length = np.asarray(rows.field("offset")), np.asarray(rows.field("length"))
                ids = np.frombuffer(_plain(part.column(2)[i].as_py(), size * int(length.sum())), dtype=f"<u{size}").astype("<u4")
                crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(offset.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [rows.field("doc_id"), rows.field("piece"), rows.field("start"), rows.field("length"), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(crc), part.column(0)[i].as_py()), pa.int64()), rows.field("offset")],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return read_sequences(spark, path).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Pack ``docs`` into a table in the shared folder and describe its pieces as read back."""
    path = scratch_path(docs.sparkSession, "packed")
    write_packed(docs, tokenizer_path, end_id, path, capacity)
    return read_packed(docs.sparkSession, path)
