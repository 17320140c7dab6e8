"""What near-dedup leaves in the executors: idle memory of its workers, and files, each of which costs an executor processes."""

import glob
import subprocess
import sys
from collections import Counter

import numpy as np

from quire.llm import simhash
from quire.runtime import durable

_WORKER = """
import re
import numpy as np, pyarrow as pa
from quire.llm import simhash, words

def anonymous():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches():
    rng, vocabulary = np.random.default_rng(1), [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(vocabulary, 700)) for _ in range(3000)]
    yield pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(map(str, range(3000))), pa.array(texts)], names=["doc_id", "text_key", "text"])

before = anonymous()
rows = sum(b.num_rows for b in getattr(words, "tidied", lambda x: x)(simhash._signatures(batches(), 5)))
assert rows == 3000
print(anonymous() - before)
"""


def test_a_worker_gives_back_what_signatures_took():
    run = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, cwd=simhash.__file__.rsplit("/quire/", 1)[0])
    assert float(run.stdout) < 60  # 120 MB and more stayed before


def test_narrow_results_of_wide_joins_are_few_files(spark, monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 60)) for _ in range(1200)]
    rows = [(i, t + end) for i, t in enumerate(texts) for end in ("", " more")]
    docs = spark.createDataFrame([(10 * i + j, t) for j, (i, t) in enumerate(rows)], "doc_id long, text string").repartition(8, "doc_id")
    files, tables = Counter(), Counter()

    def counted(df, label="stage", **how):
        out = durable(df, label, **how)
        files[label] += len(glob.glob(f"{out.scratch.removeprefix('file:')}/part-*"))
        tables[label] += 1
        return out

    monkeypatch.setattr(simhash, "durable", counted)
    # small partitions stand for the large ones of a large table: AQE leaves one for each core where there is this much for each
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    try:
        kept = simhash.drop_near_duplicates(docs).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert kept == 1200
    narrow = ["covering-near", "covering-links"]
    assert {x: files[x] / tables[x] for x in narrow} == dict.fromkeys(narrow, 1)
    assert "dedup-rows" not in files and "dedup-unit-rows" not in files  # units are written once
