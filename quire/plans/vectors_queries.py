"""2.12 Embeddings and vector search."""

from string import ascii_lowercase

from pyspark.sql import functions as F

from quire.functions.text import once
from quire.functions.vectors import dot_product as dot, l2_normalize as unit
from quire.operators import metric
from quire.operators import retrieval as R
from quire.operators import vectors as V
from quire.operators.ann import knn_ann as ann
from quire.plans.fixtures import works
from quire.plans.linkage_queries import HITS_SQL, label_queries, vector_corpus
from quire.plans.registry import query, table, texts

_RANKS = lambda df: df.select("query_id", "corpus_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("embed_text", r"""SELECT doc_id, CAST(256 AS INTEGER) AS dim,
  CASE WHEN len(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 1)) > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS norm2 FROM documents""")
def embed_text(spark, sf):
    out = V.embed_text(texts(spark, sf, "doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(dot("embedding", "embedding"), 3).alias("norm2"))


@query("validate_vectors", "SELECT vec_id, len(embedding) AS dim FROM embeddings WHERE label NOT IN (1, 2)")
def validate_vectors(spark, sf):
    broken = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") == 1, None).when(
        F.col("label") == 2, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"))
    return V.validate_vectors(broken, "embedding", 64).select("vec_id", F.size("embedding").cast("long").alias("dim"))


@query("knn_exact", f"WITH {HITS_SQL} SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM hits")
def knn_exact(spark, sf):
    return _RANKS(V.knn_exact(label_queries(spark, sf), vector_corpus(spark, sf), 20))


@query("knn_ann")
def knn_ann(spark, sf):
    return _RANKS(ann(label_queries(spark, sf), vector_corpus(spark, sf), 10, candidates=200))


@query("knn_ann_recall", "SELECT count(DISTINCT label) * 10 AS wanted, true AS recall_reached FROM embeddings")
def knn_ann_recall(spark, sf):
    """Whether at least 0.95 of the exact ten nearest are found."""
    queries, corpus = label_queries(spark, sf), vector_corpus(spark, sf)
    pairs = lambda df: df.select("query_id", "corpus_id")
    found = pairs(ann(queries, corpus, 10, candidates=200)).withColumn("hit", F.lit(1))
    exact = pairs(V.knn_exact(queries, corpus, 10)).join(found, ["query_id", "corpus_id"], "left")
    return exact.agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.95 * F.count("*")).alias("recall_reached"))


@query("l2_normalize", """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS z FROM embeddings)
SELECT vec_id, """ + ", ".join(f"round(v[{i}] / z, 6) AS x{i}" for i in range(1, 5)) + """, round(list_sum(list_transform(v, lambda x: (x / z) * (x / z))), 6) AS norm2 FROM n""")
def l2_normalize(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", unit("embedding").alias("u"))
    return u.select("vec_id", *[F.round(F.col("u")[i - 1], 6).alias(f"x{i}") for i in range(1, 5)], F.round(dot("u", "u"), 6).alias("norm2"))


_C_SQL = "m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) s(i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1)"


@query("cosine_matrix", f"WITH {_C_SQL} SELECT a.label AS label_l, b.label AS label_r, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM c a JOIN c b ON a.label < b.label")
def cosine_matrix(spark, sf):
    c = V.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return V.cosine_matrix(c, "label", "vector").withColumn("cosine", F.round("cosine", 6))


_DISTINCT_SQL = "u AS (SELECT min(vec_id) AS vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL GROUP BY embedding)"


@query("similarity_threshold_pairs", f"""WITH {_DISTINCT_SQL}, p AS (SELECT a.vec_id AS vec_id_l, b.vec_id AS vec_id_r, round(list_cosine_similarity(a.v, b.v), 12) AS score
  FROM u a JOIN u b ON a.vec_id < b.vec_id) SELECT vec_id_l, vec_id_r, round(score, 6) AS score FROM p WHERE score > 0.4""")
def similarity_threshold_pairs(spark, sf):
    """The whole table. Its vectors are unrelated, so the threshold is below the usual 0.65, where it has no pairs."""
    return metric.similarity_threshold_pairs(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.4).withColumn("score", F.round("score", 6))


@query("equal_vectors", "SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding) AS vec_id_rep FROM embeddings WHERE embedding IS NOT NULL")
def equal_vectors(spark, sf):
    return metric.equal_vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query("dot_product", f"WITH {_C_SQL} SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], v), 6) AS dot FROM embeddings e JOIN c ON e.label = c.label")
def dot_product(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.join(V.centroids(e, "label", "embedding"), "label").select("vec_id", F.round(dot("embedding", "vector"), 6).alias("dot"))


@query("mmr_rerank")
def mmr_rerank(spark, sf):
    return V.mmr_rerank(label_queries(spark, sf), vector_corpus(spark, sf))


_BM25_SQL = r"""dtk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2) AS t FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM dtk),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dtk) GROUP BY 1, 2, 3),
qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2))) AS term FROM benchmark),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM tf, st GROUP BY term, n),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean_len))), 9) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term), st GROUP BY 1, 2),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)"""


def _bm25(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25_search(q, texts(spark, sf, "doc_id", "text"), 10)


@query("bm25_search", f"WITH {_BM25_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM bm")
def bm25_search(spark, sf):
    return _bm25(spark, sf).select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


_LETTERS_OF = lambda t: "[" + ", ".join(f"(length(lower({t})) - length(replace(lower({t}), '{c}', '')))::DOUBLE" for c in ascii_lowercase) + "]"


def _letter_profile(text):
    """Letter counts of a text as a unit vector: an embedding that SQL can say too."""
    count = lambda low: F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in ascii_lowercase])
    return once(once(F.lower(text), count), lambda v: F.when(F.exists(v, lambda x: x > 0), unit(v)))


@query("hybrid_rrf", f"""WITH {_BM25_SQL},
bl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc),
dv AS MATERIALIZED (SELECT doc_id, list_transform(v, lambda x: x / z) AS v FROM (SELECT doc_id, v, sqrt(list_dot_product(v, v)) AS z FROM (SELECT doc_id, {_LETTERS_OF('text')} AS v FROM documents)) WHERE z > 0),
qv AS MATERIALIZED (SELECT query_id, list_transform(v, lambda x: x / z) AS v FROM (SELECT query_id, v, sqrt(list_dot_product(v, v)) AS z FROM (SELECT item_id AS query_id, {_LETTERS_OF('text')} AS v FROM benchmark)) WHERE z > 0),
vl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(qv.v, dv.v), 9) DESC, doc_id) AS rank FROM qv, dv),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM bl UNION ALL SELECT * FROM vl) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""")
def hybrid_rrf(spark, sf):
    """Full BM25 lists fused with full lists by a vector; the letter profile stands for an embedder."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", _letter_profile(F.col("text")).alias("vector"))
    docs = texts(spark, sf, "doc_id", "text").withColumn("vector", _letter_profile(F.col("text")))
    out = R.hybrid_rrf(q, docs, 10)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("shared_term_search", f"""WITH {_BM25_SQL}, cv AS (SELECT query_id, doc_id, count(*) AS score FROM qt JOIN tf USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cv) WHERE rank <= 10""")
def shared_term_search(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.shared_term_search(q, texts(spark, sf, "doc_id", "text"), 10).withColumn("rank", F.col("rank").cast("long"))


@query("filtered_knn", f"""WITH {_C_SQL}, f AS (SELECT c.label AS query_id, vec_id AS corpus_id, round(list_dot_product(v, embedding::DOUBLE[]), 12) AS score FROM c, embeddings e WHERE e.label IN (2, 3, 5))
SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank FROM f) WHERE rank <= 5""")
def filtered_knn(spark, sf):
    q = V.centroids(table(spark, sf, "embeddings"), "label", "embedding").select(F.col("label").alias("query_id"), "vector")
    return _RANKS(V.filtered_knn(q, vector_corpus(spark, sf), F.col("label").isin(2, 3, 5), 5))


@query("chunk_metadata_join", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rs FROM orders)
SELECT CAST(e.event_id AS VARCHAR) AS chunk_id, CAST(e.user_id AS VARCHAR) AS id, CASE WHEN s.o_orderstatus = 'F' THEN 'Agent ' || s.o_orderkey END AS contributor, CAST(year(d.o_orderdate) AS VARCHAR) AS date
FROM events e LEFT JOIN o d ON d.o_custkey = e.user_id AND d.rn = 1 LEFT JOIN o s ON s.o_custkey = e.user_id AND s.rs = 1 AND s.o_orderstatus = 'F'""")
def chunk_metadata_join(spark, sf):
    chunks = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("chunk_id"), F.col("user_id").cast("string").alias("id"))
    return V.chunk_metadata_join(chunks, works(spark, sf)).select("chunk_id", "id", "contributor", "date")


@query("fetch_by_ids", "SELECT conv_id, turn, role FROM conversations WHERE conv_id || '_' || turn IN ('0_0', '0_1', '3_1', '999999_0')")
def fetch_by_ids(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return V.fetch_by_ids(c, ["0_0", "0_1", "3_1", "999999_0"], "conv_id", "turn")


@query("pca_project")
def pca_project(spark, sf):
    out = V.pca_project(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.select("vec_id", *[F.round(F.abs(F.col("projection")[i]), 3).alias(f"p{i}") for i in range(3)])


@query("projection_quality", """
WITH n AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS z, sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])) AS zh, embedding::DOUBLE[] AS v, embedding[1:16]::DOUBLE[] AS h FROM embeddings)
SELECT CAST(NULL AS DOUBLE) AS cosine_loss, round(avg(pow(list_dot_product(a.v, b.v) / (a.z * b.z) - list_dot_product(a.h, b.h) / (a.zh * b.zh), 2)), 6) AS structure_error FROM n a, n b""")
def projection_quality(spark, sf):
    df = table(spark, sf, "embeddings").select("embedding", F.slice("embedding", 1, 16).alias("head"))
    return V.projection_quality(df, "embedding", "head").withColumn("structure_error", F.round("structure_error", 6))


@query("centroid_stats", f"WITH {_C_SQL} SELECT vec_id, e.label AS label, round(list_distance(embedding::DOUBLE[], v), 6) AS distance FROM embeddings e JOIN c ON e.label = c.label")
def centroid_stats(spark, sf):
    return V.centroid_stats(table(spark, sf, "embeddings"), "label", "embedding", "vec_id").withColumn("distance", F.round("distance", 6))


@query("rag_context")
def rag_context(spark, sf):
    """Every user turn against every document."""
    docs = table(spark, sf, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    turns = table(spark, sf, "conversations").where("role = 'user'").select(
        F.lit("q").alias("kind"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    vectors = V.embed_text(docs.unionByName(turns), "id", "text", out="vector")
    corpus = vectors.where("kind = 'd'").select(F.col("id").alias("corpus_id"), "vector", "text")
    asked = vectors.where("kind = 'q'").select(F.col("id").alias("query_id"), "vector")
    return V.rag_context(asked, corpus, 5)
