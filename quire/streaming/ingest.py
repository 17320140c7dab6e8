"""Incremental loading with Structured Streaming.

Every sink writes a micro-batch to a folder of its own batch number and overwrites it, so a batch
that is replayed after a failure gives the same result once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.operators.chunking import chunk_recursive
from quire.operators.vectors import embed_text


def open_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_file_ingest(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str,
                       files_per_batch: int | None = None) -> DataFrame:
    """Load the files not seen before into ``out`` and return the table; a rerun goes on where the last one stopped."""
    run = (open_stream(spark, path, schema, files_per_batch).writeStream.format("parquet")
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
    run.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _each_batch(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    run = (stream.writeStream.outputMode(mode).foreachBatch(write)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    run.awaitTermination()


def stream_first_wins(stream: DataFrame, keys: list[str], order_by: list[str], out: str, checkpoint: str) -> DataFrame:
    """The first record of every key over all batches: that of its first batch which is least by ``order_by``, then by its other columns.

    The state store keeps the record of each key with the time of its batch, which the offset log keeps for replays, so a
    batch looks up its own keys only and reads none of the earlier output. What a batch finds with its own time is new and is written to
    the folder of its number. The stream goes on from ``checkpoint``; the keys' partitions are those of its first start.
    Null keys are one key. The clock must not be set back between batches.
    """
    schema = stream.schema
    rest = [c for c in schema.names if c not in order_by]
    record = F.struct(F.current_timestamp().alias("_at"), *[F.col(c) for c in [*order_by, *rest]])
    firsts = (stream.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], record.alias("_r"))
              .groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_r").alias("_first"), F.max("_r._at").alias("_now")))

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col("_first._at") == F.col("_now")).select([F.col(f"_first.{c}").alias(c) for c in schema.names])
        fresh.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _each_batch(firsts, checkpoint, write, "update")
    return stream.sparkSession.read.schema(_with_batch(schema)).parquet(out).drop("batch")


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch", LongType())])


def stream_label_counts(stream: DataFrame, key: str) -> DataFrame:
    """Running counts per key, a streaming DataFrame for update or complete mode."""
    return stream.groupBy(key).agg(F.count("*").alias("n"))


def run_counts(counts: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a counting stream to the end of its input; ``out`` holds the latest complete counts."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _each_batch(counts, checkpoint, write, "complete")
    # a rerun without new input runs no batch: the latest is the highest number written by any run
    written = counts.sparkSession.read.schema(_with_batch(counts.schema)).parquet(out)
    latest = written.agg(F.max("batch")).first()[0]
    return written.where(F.col("batch") == F.lit(latest)).drop("batch")


def stream_index_sink(stream: DataFrame, out: str, checkpoint: str, id: str = "id", text: str = "text",
                      embedder: Callable | None = None) -> DataFrame:
    """Chunk, embed and index each micro-batch: (es_doc_id, text, vector, error).

    A record without text is indexed with an error and no vector. The default embedder does not
    depend on other records, so a vector is the same in whatever batch its record arrives.
    """
    def write(batch: DataFrame, number: int) -> None:
        vectors = embed_text(chunk_recursive(batch, id, text), id, "chunk_text", embedder, idf=False, out="vector")
        good = vectors.select(F.concat_ws("_", F.col(id).cast("string"), F.col("chunk_index").cast("string")).alias("es_doc_id"),
                              F.col("chunk_text").alias("text"), "vector", F.lit(None).cast("string").alias("error"))
        empty = batch.where(F.trim(F.coalesce(text, F.lit(""))) == "").select(
            F.concat_ws("_", F.col(id).cast("string"), F.lit("0")).alias("es_doc_id"), F.col(text).alias("text"),
            F.lit(None).cast("array<float>").alias("vector"), F.lit("empty_text").alias("error"))
        good.unionByName(empty).write.mode("overwrite").parquet(f"{out}/batch_{number}")

    _each_batch(stream, checkpoint, write)
    return stream.sparkSession.read.parquet(f"{out}/batch_*")
