"""Embedding, vector search and projections. Matrix products run in NumPy on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import text as X
from quire.functions.vectors import dot_product, l2_normalize, valid_vector
from quire.operators.ann import knn_ann
from quire.runtime import durable, take_bounded

MAX_QUERIES = 4096     # vectors sent to every task at most
BLOCK_ROWS = 20_000    # corpus vectors per block beyond that
MAX_HITS = 200_000     # found passages sent to the tasks at once, some 30 MB
DECIMALS = 12          # scores are compared at this precision, so summation order cannot change a rank


def embed_text(df: DataFrame, id: str, text: str, embedder: Callable[[], Callable[[list[str]], list]] | None = None,
               batch: int = 32, dim: int = 256, idf: bool = True, out: str = "embedding") -> DataFrame:
    """Adds a vector per text.

    ``embedder`` is a factory called once per task; what it returns maps a list of at most ``batch``
    texts to as many vectors. Without one: hashed term counts, weighted by IDF (unless ``idf`` is
    off, which makes a vector independent of the other rows), unit length.
    """
    if embedder is None:
        toks = df.withColumn("_tokens", X.tokens(F.coalesce(text, F.lit("")), 1))
        weigh = [IDF(inputCol="_tf", outputCol="_idf")] if idf else []
        stages = Pipeline(stages=[HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim), *weigh,
                                  Normalizer(inputCol="_idf" if idf else "_tf", outputCol="_v")])
        return stages.fit(toks).transform(toks).select(*df.columns, vector_to_array("_v", "float32").alias(out))

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = embedder()
        for frame in batches:
            texts = frame[text].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i:i + batch])]
            yield frame.assign(**{out: vectors})

    return df.mapInPandas(run, schema)


def validate_vectors(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Rows with a complete vector of ``dim`` entries, as float."""
    return df.where(valid_vector(vec, dim)).withColumn(vec, F.col(vec).cast("array<float>"))


def centroids(df: DataFrame, group: str, vec: str, out: str = "vector") -> DataFrame:
    """(group, vector): the mean vector per group, summed per task before the shuffle."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(group).agg(mean.alias("_m")).select(group, vector_to_array("_m").alias(out))


def centroid_stats(df: DataFrame, group: str, vec: str, id: str) -> DataFrame:
    """(id, group, distance): Euclidean distance of each vector to the mean of its group."""
    far = df.select(id, group, vec).join(centroids(df, group, vec, "_c"), group)
    gaps = F.zip_with(F.col(vec), F.col("_c"), lambda x, c: (x.cast("double") - c) * (x.cast("double") - c))
    return far.select(id, group, F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x)).alias("distance"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _usable(df: DataFrame, id: str) -> DataFrame:
    """(id, vector) without null or incomplete vectors."""
    v = F.col("vector")
    return df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())).select(id, v.cast("array<double>").alias("vector"))


def _tile(n_queries: int) -> int:
    """Corpus rows scored at once, so that a tile of scores takes 16 MB."""
    return max(1, 2_000_000 // max(1, n_queries))


def _score_blocks(queries: DataFrame, corpus: DataFrame, keep, columns: list[str], max_queries: int) -> DataFrame:
    """Run ``keep(query_ids, corpus_batches)`` over all (query, corpus row) scores without shuffling the scores.

    At most ``max_queries`` query vectors go to every task and the corpus is read in place. More
    queries than that are cut into blocks and met with corpus blocks of a bounded size, each pair of
    blocks in a task of its own.
    """
    spark = corpus.sparkSession
    queries, corpus = _usable(queries, "query_id"), _usable(corpus, "corpus_id")
    kinds = {"query_id": queries.schema["query_id"].dataType, "corpus_id": corpus.schema["corpus_id"].dataType, "score": T.DoubleType()}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in columns])
    arrow_schema = to_arrow_schema(schema)
    rows = take_bounded(queries, max_queries)
    if rows is not None:
        ids = [r["query_id"] for r in rows]
        if not ids:
            return spark.createDataFrame([], schema)
        shipped = spark.sparkContext.broadcast(np.array([r["vector"] for r in rows], dtype=np.float64))

        def in_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tile = _tile(len(ids))
            cut = (b.slice(at, tile) for b in batches for at in range(0, b.num_rows, tile))
            parts = ((b.column("corpus_id").to_pylist(), _matrix(b.column("vector"))) for b in cut)
            for frame in keep(ids, shipped.value, parts):
                yield pa.RecordBatch.from_pandas(frame, arrow_schema, preserve_index=False)

        return corpus.mapInArrow(in_place, schema)

    queries = durable(queries, "queries")
    n_q = queries.count() // max_queries + 1
    n_c = corpus.count() // BLOCK_ROWS + 1
    q = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(n_q))).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    c = corpus.withColumn("_c", F.pmod(F.xxhash64("corpus_id"), F.lit(n_c))).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def in_blocks(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        tile = _tile(len(left))
        cut = (right.iloc[at:at + tile] for at in range(0, len(right), tile))
        part = ((r["corpus_id"].tolist(), np.stack(r["vector"].to_numpy())) for r in cut)
        frames = list(keep(left["query_id"].tolist(), np.stack(left["vector"].to_numpy()), part))
        return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(columns=columns)

    return q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInPandas(in_blocks, schema)


def query_corpus_cross(queries: DataFrame, corpus: DataFrame, max_queries: int = MAX_QUERIES) -> DataFrame:
    """(query_id, corpus_id, score): the inner product of every query with every vector (a result of that size is asked for)."""
    def keep(ids, matrix, parts):
        for corpus_ids, vectors in parts:
            scores = matrix @ vectors.T
            yield pd.DataFrame({"query_id": np.repeat(np.array(ids, dtype=object), len(corpus_ids)),
                                "corpus_id": np.tile(np.array(corpus_ids, dtype=object), len(ids)), "score": scores.ravel()})
    return _score_blocks(queries, corpus, keep, ["query_id", "corpus_id", "score"], max_queries)


def knn_exact(queries: DataFrame, corpus: DataFrame, k: int, max_queries: int = MAX_QUERIES, exclude_self: bool = False) -> DataFrame:
    """(query_id, corpus_id, score, rank): top k by inner product (cosine for unit vectors).

    Every task keeps k rows per query, so what is shuffled is tasks x queries x k rows.
    """
    def keep(ids, matrix, parts):
        best_scores = [np.empty(0) for _ in ids]
        best_ids: list[list] = [[] for _ in ids]
        for corpus_ids, vectors in parts:
            scores = np.round(matrix @ vectors.T, DECIMALS)
            want = k + 1 if exclude_self else k
            for i in range(len(ids)):
                row = scores[i]
                if len(row) > want:
                    floor = np.partition(row, -want)[-want]
                    near = np.flatnonzero(row >= floor)     # keeps every tie of the last place
                else:
                    near = np.arange(len(row))
                names = [corpus_ids[j] for j in near]
                values = row[near]
                if exclude_self:
                    other = [n for n, name in enumerate(names) if name != ids[i]]
                    names, values = [names[n] for n in other], values[other]
                names = best_ids[i] + names
                values = np.concatenate([best_scores[i], values])
                order = sorted(range(len(names)), key=lambda n: (-values[n], names[n]))[:k]
                best_ids[i], best_scores[i] = [names[n] for n in order], values[order]
        rows = [(q, c, float(s)) for q, cs, ss in zip(ids, best_ids, best_scores) for c, s in zip(cs, ss)]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "corpus_id", "score"])

    local = _score_blocks(queries, corpus, keep, ["query_id", "corpus_id", "score"], max_queries)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered_knn(queries: DataFrame, corpus: DataFrame, pred: Column, k: int) -> DataFrame:
    """``knn_exact`` over the corpus rows where ``pred`` holds; the filter reaches the scan."""
    return knn_exact(queries, corpus.where(pred), k)


def cosine_matrix(df: DataFrame, id: str, vec: str, max_rows: int = 1000) -> DataFrame:
    """(id_l, id_r, cosine) for every pair of a selected set of at most ``max_rows`` vectors."""
    from quire.operators.joins import all_pairs
    unit = df.select(id, l2_normalize(vec).alias("_v"))
    return all_pairs(unit, id, max_rows).select(f"{id}_l", f"{id}_r", dot_product("_v_l", "_v_r").alias("cosine"))


def mmr_rerank(queries: DataFrame, corpus: DataFrame, k: int = 4, fetch_k: int = 20, lam: float = 0.5) -> DataFrame:
    """(query_id, corpus_id, rank): maximal marginal relevance over the ``fetch_k`` nearest of each query.

    The greedy choice runs per query on its ``fetch_k`` candidates, a bounded group.
    """
    vectors = _usable(corpus, "corpus_id")
    found = knn_exact(queries, corpus, fetch_k).join(vectors, "corpus_id")
    asked = _usable(queries, "query_id").select("query_id", F.col("vector").alias("qv"))
    found = found.join(asked, "query_id")
    schema = T.StructType([found.schema["query_id"], found.schema["corpus_id"], T.StructField("rank", T.LongType())])

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank", ignore_index=True)
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
        cand = unit(np.stack(group["vector"].to_numpy()))
        relevance = cand @ unit(np.asarray(group["qv"].iloc[0]))
        chosen: list[int] = []
        redundancy = np.full(len(group), -np.inf)
        while len(chosen) < min(k, len(group)):
            value = relevance if not chosen else lam * relevance - (1 - lam) * redundancy
            value = np.where(np.isin(np.arange(len(group)), chosen), -np.inf, value)
            chosen.append(int(np.argmax(value)))
            redundancy = np.maximum(redundancy, cand @ cand[chosen[-1]])
        return pd.DataFrame({"query_id": group["query_id"].iloc[chosen].to_numpy(), "corpus_id": group["corpus_id"].iloc[chosen].to_numpy(),
                             "rank": np.arange(1, len(chosen) + 1)})

    return found.groupBy("query_id").applyInPandas(pick, schema)


def chunk_metadata_join(chunks: DataFrame, works: DataFrame) -> DataFrame:
    """Chunks with the primary contributor and the first production date of their record (null when missing)."""
    primary = F.get(F.filter("contributors", lambda c: c["primary"]), F.lit(0))["agent"]["label"]
    date = F.get(F.get(F.col("production"), F.lit(0))["dates"], F.lit(0))["label"]
    return chunks.join(works.select("id", primary.alias("contributor"), date.alias("date")), "id", "left")


def fetch_by_ids(df: DataFrame, ids: list[str], id: str = "id", index: str = "chunk_index") -> DataFrame:
    """Rows by composite ids ``<id>_<index>``; the request is a small list."""
    asked = df.sparkSession.createDataFrame([(i,) for i in ids], "_full string").select(
        F.regexp_extract("_full", r"^(.*)_(\d+)$", 1).cast(df.schema[id].dataType).alias(id),
        F.regexp_extract("_full", r"^(.*)_(\d+)$", 2).cast(df.schema[index].dataType).alias(index))
    return df.join(F.broadcast(asked), [id, index], "left_semi")


def pca_project(df: DataFrame, vec: str, k: int = 3, whiten: bool = True, unit: bool = False, out: str = "projection") -> DataFrame:
    """Adds the first k principal components (centred; optionally unit variance, unit length)."""
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False)
    stages = [centred, PCA(k=k, inputCol="_c", outputCol="_p")]
    last = "_p"
    if whiten:
        stages.append(StandardScaler(inputCol="_p", outputCol="_w", withMean=False, withStd=True))
        last = "_w"
    if unit:
        stages.append(Normalizer(inputCol=last, outputCol="_u"))
        last = "_u"
    data = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    return Pipeline(stages=stages).fit(data).transform(data).select(*df.columns, vector_to_array(last).alias(out))


def projection_quality(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean cosine loss between a and b (null when their sizes differ), and the mean squared
    difference of the cosine structures of the two spaces over all pairs of rows.

    The second needs no pairs: with unit rows X and Z, the sum over pairs of (x.x' - z.z')^2 is
    |X'X|^2 - 2 |X'Z|^2 + |Z'Z|^2, and the Gram matrices are sums over rows.
    """
    data = df.select(l2_normalize(a).alias("x"), l2_normalize(b).alias("z"))

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, loss = None, 0, 0.0
        for batch in batches:
            if batch.num_rows:
                x, z = _matrix(batch.column("x")), _matrix(batch.column("z"))
                both = np.hstack([x, z])
                total = both.T @ both if total is None else total + both.T @ both
                n += len(x)
                loss += float((1 - (x * z).sum(axis=1)).sum()) if x.shape[1] == z.shape[1] else float("nan")
                d = x.shape[1]
        if total is not None:
            i, j = np.indices(total.shape)
            kind = np.where((i < d) & (j < d), "xx", np.where((i >= d) & (j >= d), "zz", np.where((i < d), "xz", "zx")))
            frame = pd.DataFrame({"kind": kind.ravel(), "i": i.ravel(), "j": j.ravel(), "v": total.ravel()})
            extra = pd.DataFrame({"kind": ["n", "loss"], "i": [0, 0], "j": [0, 0], "v": [float(n), loss]})
            yield pa.RecordBatch.from_pandas(pd.concat([frame, extra], ignore_index=True), preserve_index=False)

    sums = data.mapInArrow(gram, "kind string, i long, j long, v double").groupBy("kind", "i", "j").agg(F.sum("v").alias("v"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("v") * F.col("v")).otherwise(0.0))
    one = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("v")))
    n = one("n")
    return sums.agg((F.nanvl(one("loss"), F.lit(None).cast("double")) / n).alias("cosine_loss"),
                    ((of("xx") - 2 * of("xz") + of("zz")) / (n * n)).alias("structure_error"))


def rag_context(queries: DataFrame, corpus: DataFrame, k: int = 50, sep: str = "\n\n", search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(query_id, context, citations): the top k passages of each query joined in rank order.

    ``corpus`` has ``corpus_id, vector, text``. ``search(queries, corpus, k)`` finds them, by default ``ann.knn_ann``: an exact
    search would score every query against every passage. Passages stay where they are: the hits go there in blocks of some ``MAX_HITS``,
    and only lines that are found are shuffled.
    """
    found = durable((search or knn_ann)(queries, corpus.select("corpus_id", "vector"), k).select("query_id", "corpus_id", "rank"), "hits", few=True)
    blocks, texts = max(1, -(-found.count() // MAX_HITS)), corpus.select("corpus_id", "text")
    of_block = F.pmod(F.xxhash64("query_id", "corpus_id"), F.lit(blocks))
    hits = reduce(DataFrame.unionByName, [texts.join(F.broadcast(found.where(of_block == block) if blocks > 1 else found), "corpus_id") for block in range(blocks)])
    lines = F.struct("rank", F.concat(F.lit("["), F.col("corpus_id").cast("string"), F.lit("] "), F.col("text")).alias("line"),
                     F.col("corpus_id").cast("string").alias("cite"))
    ranked = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(lines)).alias("_a"))   # k rows per query
    return ranked.select("query_id", F.array_join(F.transform("_a", lambda x: x["line"]), sep).alias("context"),
                         F.array_join(F.transform("_a", lambda x: x["cite"]), ",").alias("citations"))
