"""What a task or the driver holds at once follows stated sizes, not how much comes in one batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import ann, language, metric, similarity
from quire.operators import text as T


def test_language_slices_follow_bytes():
    column = pa.array(["x" * 700_000, None, "y" * 700_000, "", "z" * 3_000_000, "w"])
    batch = pa.RecordBatch.from_arrays([column], names=["text"]).slice(1)
    parts = list(language._slices(batch, 0))
    assert [a for a, _ in parts] == [0] + [b for _, b in parts[:-1]] and parts[-1][1] == 5
    assert all(b == a + 1 or sum(len(t or "") for t in batch.column(0).to_pylist()[a:b]) <= language.SLICE_BYTES for a, b in parts)
    assert len(parts) == 3


def test_ghosts_leave_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(metric, "GHOSTS", 50)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(120, 16)).tolist())], "id long, v array<double>")
    join = metric.MetricJoin(df, "id", "v", 0.1, pivots=12)
    rows = join.homes.toArrow().to_batches()
    sizes = [b.num_rows for b in join._ghost()(iter(rows))]
    assert max(sizes) <= 50 and sum(sizes) == join.met.sum() > 50


def test_ann_sample_is_the_sorted_limit(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(rng.normal(size=(90, 7)).tolist())], "corpus_id string, vector array<float>").repartition(5)
    want = [r["vector"] for r in df.orderBy(F.xxhash64("corpus_id")).limit(40).collect()]
    assert (ann._sample(df, "corpus_id", 40, True) == np.array(want)).all()
    assert len(ann._sample(df.where("false"), "corpus_id", 40, True)) == 0
    x, centres = rng.normal(size=(2 * ann.SLICE + 5, 3)), rng.normal(size=(9, 3))
    own, gap = ann.nearest(x, centres)
    full = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert (own == full.argmin(axis=1)).all() and np.allclose(gap, full.min(axis=1))


def test_only_shared_runs_are_ordered(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "own1"]), (2, ["b", "c"]), (3, ["a", "b", "own3"]), (4, ["own4"])], "id long, s array<string>")
    got = {r["id"]: r["ordered"] for r in similarity.rare_first(sets, "id", "s").collect()}
    assert got == {1: ["a", "b"], 2: ["b"], 3: ["a", "b"]}


def test_spell_ratio_shuffles_texts_only_by_record(spark):
    docs = spark.createDataFrame([(1, "good bad bad wurst"), (2, None), (3, ""), (1, "wurst"), (None, "good x")], "id long, text string")
    words = spark.createDataFrame([("good",), ("good",)], "word string")
    out = T.spell_ratio(docs, "id", "text", words)
    assert {tuple(r) for r in out.collect()} == {(1, 0.8, "bad,wurst"), (2, 0.0, ""), (3, 0.0, ""), (None, 0.5, "")}
    assert ", word" not in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x)
