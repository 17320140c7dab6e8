"""First-wins streaming: restarts, state instead of earlier output, replays."""

import glob
import os
import shutil

from pyspark.sql import functions as F

from quire.runtime import scratch_path
from quire.streaming import ingest as S

SCHEMA = "k long, n long, v string"


def append(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_state_carries_over_restarts_and_replays(spark):
    source, out, checkpoint = (scratch_path(spark, x) for x in ("in", "out", "checkpoint"))
    run = lambda: sorted(map(tuple, S.stream_first_wins(S.open_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, 1), ["k"], ["n"], out, checkpoint).collect()), key=str)
    append(spark, source, [(1, 5, "a"), (1, 4, "b"), (2, 9, "c"), (None, 3, "n"), (None, 2, "m"), *[(7, 1, "hot") for _ in range(500)]])
    first = [(1, 4, "b"), (2, 9, "c"), (7, 1, "hot"), (None, 2, "m")]
    assert run() == sorted(first, key=str)
    assert run() == sorted(first, key=str)  # nothing new

    # earlier output is not read again: a later batch still knows its keys
    (folder,) = glob.glob(f"{out}/batch=0")
    shutil.move(folder, f"{out}-aside")
    append(spark, source, [(1, 0, "late"), (3, 8, "d"), (3, 7, "e"), (None, 0, "late")])
    assert run() == [(3, 7, "e")]
    shutil.move(f"{out}-aside", folder)
    append(spark, source, [(4, 1, "f"), (2, 1, "late")])
    want = sorted(first + [(3, 7, "e"), (4, 1, "f")], key=str)
    assert run() == want

    # a batch whose commit is lost is replayed with the same result
    last = max(int(os.path.basename(p)) for p in glob.glob(f"{checkpoint}/commits/*"))
    os.rename(f"{checkpoint}/commits/{last}", f"{checkpoint}-commit")
    if os.path.exists(f"{checkpoint}/commits/.{last}.crc"):
        os.rename(f"{checkpoint}/commits/.{last}.crc", f"{checkpoint}-commit-crc")
    assert run() == want


def test_equals_the_batch_result(spark):
    source, out, checkpoint = (scratch_path(spark, x) for x in ("in", "out", "checkpoint"))
    events = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(400)).alias("k"), F.col("id").alias("n"), F.concat(F.lit("v"), "id").alias("v"))
    for a in range(0, 3000, 1000):
        events.where((F.col("n") >= a) & (F.col("n") < a + 1000)).coalesce(1).write.mode("append").parquet(source)
    got = S.stream_first_wins(S.open_stream(spark, source, events.schema, 1), ["k"], ["n"], out, checkpoint)
    want = events.groupBy("k").agg(F.min("n").alias("n")).select("k", "n", F.concat(F.lit("v"), "n").alias("v"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
