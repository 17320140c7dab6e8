"""2.5 Joins."""

from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.operators import joins as J
from quire.operators.similarity import block_pairs
from quire.operators.vectors import centroids, query_corpus_cross as cross
from quire.plans.registry import query, table


@query("inner_equi", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_equi(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.inner_equi(table(spark, sf, "orders"), c, "o_custkey").select("o_orderkey", "c_name")


@query("inner_multi_key", """
SELECT a.l_partkey, a.l_suppkey, a.n AS n_r, b.n AS n_a
FROM (SELECT l_partkey, l_suppkey, count(*) n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a
JOIN (SELECT l_partkey, l_suppkey, count(*) n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) b USING (l_partkey, l_suppkey)""")
def inner_multi_key(spark, sf):
    li = table(spark, sf, "lineitem")
    counts = lambda flag, name: li.where(F.col("l_returnflag") == flag).groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias(name))
    return counts("R", "n_r").join(counts("A", "n_a"), ["l_partkey", "l_suppkey"])


@query("left_join", "SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("left_join_missing", "SELECT DISTINCT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1")
def left_join_missing(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "").otherwise("ok").alias("note"))
    return J.left_join_missing(table(spark, sf, "documents").select("doc_id"), l, ["doc_id"], "note")


@query("left_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti(spark, sf):
    return J.left_anti(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("left_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def left_semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.left_semi(table(spark, sf, "customer").select("c_custkey"), big, "c_custkey")


@query("self_join_pairs", """
WITH r AS (SELECT p_brand, p_name, min(p_partkey) AS id FROM part GROUP BY 1, 2)
SELECT a.id AS id_l, b.id AS id_r FROM r a JOIN r b ON a.p_brand = b.p_brand AND a.id < b.id
WHERE split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) OR split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2)
UNION ALL SELECT id, p_partkey FROM part JOIN r USING (p_brand, p_name) WHERE p_partkey > id""")
def self_join_pairs(spark, sf):
    """Parts of one brand whose names share a word: same block, Jaccard of the two-word names at least 1/3. Parts of one name are tied to their first."""
    records = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array("p_brand").alias("keys"), F.split("p_name", " ").alias("tokens"))
    return block_pairs(records, 0.33).select("id_l", "id_r")


@query("double_lookup", """
SELECT l_partkey, l_suppkey, p_name AS name_l, s_name AS name_r FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey""")
def double_lookup(spark, sf):
    names = (table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("name"))
             .unionByName(table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name"))))
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().select(
        "*", F.concat(F.lit("p"), "l_partkey").alias("left_id"), F.concat(F.lit("s"), "l_suppkey").alias("right_id"))
    return J.double_lookup(pairs, names, "left_id", "right_id", "id").select("l_partkey", "l_suppkey", "name_l", "name_r")


@query("right_outer_ifnull", """
SELECT o_orderkey, coalesce(m, o_custkey) AS canon FROM orders LEFT JOIN
 (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS m FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def right_outer_ifnull(spark, sf):
    c = table(spark, sf, "customer").where("c_acctbal > 0")
    canon = c.join(c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("m")), ["c_nationkey", "c_mktsegment"])
    canon = canon.select(F.col("c_custkey").alias("o_custkey"), "m")
    return J.right_outer_ifnull(canon, table(spark, sf, "orders"), "o_custkey", "m", "o_custkey").select("o_orderkey", "canon")


@query("avg_compare_join", """
WITH t AS (SELECT o_custkey, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)
SELECT o_custkey, t.month, round(total, 2) AS total FROM t JOIN (SELECT month, avg(total) AS m FROM t GROUP BY 1) a ON t.month = a.month WHERE total > 1.5::DOUBLE * m""")
def avg_compare_join(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice")
    return J.avg_compare_join(o, ["o_custkey"], "month", "o_totalprice", 1.5).select("o_custkey", "month", F.round("total", 2).alias("total"))


_CENTROID_SQL = """m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) s(i) GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY 1)"""


@query("all_pairs", f"""
WITH {_CENTROID_SQL} SELECT a.label AS label_l, b.label AS label_r FROM c a JOIN c b ON a.label < b.label""")
def all_pairs(spark, sf):
    """Pairs of the groups of a table (ten label centroids), never of its rows."""
    return J.all_pairs(centroids(table(spark, sf, "embeddings"), "label", "embedding"), "label").select("label_l", "label_r")


@query("dictionary_join", r"""
WITH w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2)) AS term FROM documents),
d AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2)) AS term FROM benchmark)
SELECT term, count(*) AS n FROM w JOIN d USING (term) GROUP BY 1""")
def dictionary_join(spark, sf):
    terms = lambda name: table(spark, sf, name).select(F.explode(tokens("text")).alias("term"))
    # counted per term before the join: one row per word, not one per occurrence
    counts = terms("documents").groupBy("term").agg(F.count("*").alias("n"))
    return J.dictionary_join(counts, terms("benchmark").distinct(), "term")


@query("query_corpus_cross", f"""
WITH {_CENTROID_SQL} SELECT c.label AS query_id, vec_id AS corpus_id, round(list_dot_product(c.v, embedding::DOUBLE[]), 6) AS score FROM c, embeddings""")
def query_corpus_cross(spark, sf):
    e = table(spark, sf, "embeddings")
    q = centroids(e, "label", "embedding").select(F.col("label").alias("query_id"), "vector")
    return cross(q, e.select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"))).select(
        "query_id", "corpus_id", F.round("score", 6).alias("score"))


@query("rows_by_index", """
WITH g AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS ix FROM embeddings)
SELECT position, ix, vec_id FROM (VALUES (0, 17), (1, 3), (2, 480), (3, 3)) w(position, i) JOIN g ON ix = i""".replace(
    "SELECT position,", "SELECT position::BIGINT AS position,"))
def rows_by_index(spark, sf):
    return J.rows_by_index(table(spark, sf, "embeddings").select("vec_id", "label"), ["label", "vec_id"], [17, 3, 480, 3]).select("position", "ix", "vec_id")
