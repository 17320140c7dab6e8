"""Token ids on disk: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Every id is replaced by its rank in the corpus (0 = most frequent), so that frequent ids take one byte. A block
holds whole documents: ``data`` has the ranks as 1 to 4 little-endian bytes each, ``control`` two bits per rank
(length - 1), four ranks a byte, lowest bits first. A reader finds lengths by a 256 x 4 table look-up over the
control bytes and gathers the data bytes with numpy.

A store is a folder with ``blocks`` (Parquet files of block rows: shard, block, start_in_shard, doc_ids,
counts, control, data; shards ascend with doc_id) and ``ranks`` (rank, token_id, count).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import encoding
from quire.llm import words as W
from quire.runtime import scratch_path

BLOCK_TOKENS = 1 << 18

_ID_BLOCKS = "shard int, block int, start_in_shard long, doc_ids array<long>, counts array<int>, ids binary"
_CODED = "shard int, block int, start_in_shard long, doc_ids array<long>, counts array<int>, control binary, data binary"

def _id_blocks(path: str, end_id: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(path)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        held = 0

        def flush():
            nonlocal block, start, ids, docs, held
            counts = [len(x) for x in ids]
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "start_in_shard": pa.array([start], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())),
                "counts": pa.array([counts], pa.list_(pa.int32())),
                "ids": pa.array([np.concatenate(ids).astype("<u4").tobytes()], pa.binary())})
            block, start, ids, docs, held = block + 1, start + held, [], [], 0
            return row

        for part in W.slices(batches, size=1 << 19):
            found, bounds = encoding.with_end(*enc.encode(part.column(1)), end_id)
            for doc, a, b in zip(part.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                ids.append(found[a:b])
                docs.append(doc)
                held += b - a
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()
    return run


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of a rank array."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[:len(ranks)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a block: lengths by table look-up, bytes by gathering."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    raw = np.frombuffer(data, dtype=np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_token_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id",
                      text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, and write the store at ``path`` in ascending id order.

    Null ids come first, a null or empty text is the end id alone, repeated ids and rows are kept one after another
    (in no particular order, and dealt to several tasks where they are many), other columns are ignored, an empty table gives an empty store. Texts are range-partitioned and
    tokenized once; the ids are counted over the whole corpus; the rank table has one entry per vocabulary entry
    at most, which bounds what goes through the driver and to the tasks. A task that is run again writes the same blocks.
    """
    spark = docs.sparkSession
    staged = scratch_path(spark, "token-ids")
    order = ["doc_id", "digest", "row"]
    placed = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"), F.monotonically_increasing_id().alias("row"))
              .repartitionByRange(*order).sortWithinPartitions(*order))
    placed.mapInArrow(_id_blocks(tokenizer_path, end_id, block_tokens), _ID_BLOCKS) \
        .write.option("compression", "zstd").parquet(staged)
    blocks = spark.read.schema(_ID_BLOCKS).parquet(staged)

    def count(batches):
        seen = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n = np.bincount(np.frombuffer(raw.as_buffer(), dtype="<u4"), minlength=len(seen))
                n[:len(seen)] += seen
                seen = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"token_id": pa.array(at, pa.int64()), "n": pa.array(seen[at], pa.int64())})

    counts = blocks.select("ids").mapInArrow(count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r["token_id"], r["n"]) for r in counts.collect()), key=lambda x: (-x[1], x[0]))
    spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(ranked)], "rank long, token_id long, count long") \
        .coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(1 + max((t for t, _ in ranked), default=0), dtype=np.uint32)
    for i, (t, _) in enumerate(ranked):
        rank_of[t] = i

    def encode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                control, data = encode_ranks(rank_of[np.frombuffer(row.column(5)[0].as_buffer(), dtype="<u4")])
                yield pa.RecordBatch.from_arrays([*row.columns[:5], pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                                                 names=["shard", "block", "start_in_shard", "doc_ids", "counts", "control", "data"])

    blocks.mapInArrow(encode, _CODED).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) per document, decoded from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is over the ids as little-endian unsigned 32-bit.
    """
    blocks = spark.read.schema(_CODED).parquet(f"{path}/blocks")
    # one number per shard and one per vocabulary entry reach the driver
    sizes = blocks.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before, seen = {}, 0
    for r in sorted(sizes.collect()):
        before[r["shard"]], seen = seen, seen + r["n"]
    ids = np.zeros(0, dtype=np.uint32)
    ranked = spark.read.parquet(f"{path}/ranks").select("rank", "token_id").collect()
    if ranked:
        ids = np.zeros(len(ranked), dtype=np.uint32)
        for r in ranked:
            ids[r["rank"]] = r["token_id"]

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard, start = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                counts = np.asarray(batch.column(4)[i].values, dtype=np.int64)
                raw = ids[decode_ranks(batch.column(5)[i].as_py(), batch.column(6)[i].as_py(), int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(3)[i].values, "start": pa.array(before[shard] + start + begins, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                    "shard": pa.array(np.full(len(counts), shard), pa.int32())})

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as a token store in the shared folder and describe what its files hold."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_token_store(docs, tokenizer_path, end_id, path)
    return read_token_store(docs.sparkSession, path)
