"""2.7 Windows, sorting, top-k, sampling."""

from pyspark.sql import functions as F

from quire.operators import sampling as S
from quire.operators import windows as W
from quire.plans.registry import query, table


@query("latest_per_key", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_per_key(spark, sf):
    return W.latest_per_key(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("sample_per_group", """
SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|42'), doc_id) AS rn FROM documents) WHERE rn <= 5""")
def sample_per_group(spark, sf):
    return S.sample_per_group(table(spark, sf, "documents").select("doc_id", "lang"), "lang", 5, "doc_id", 42)


@query("count_over", "SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS group_size FROM part")
def count_over(spark, sf):
    return W.count_over(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@query("rank_in_query", """
SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10""")
def rank_in_query(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    ranked = table(spark, sf, "customer").withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return ranked.select("c_nationkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("trailing_count", """
WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, user_id, count(*) OVER w AS trailing, count(*) OVER w >= 5 AS over_limit FROM e
WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING)""")
def trailing_count(spark, sf):
    # a day instead of an hour: the users of this table are too quiet for five requests an hour
    return W.trailing_count(table(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 86400, 5).drop("ts")


@query("global_index", "SELECT doc_id, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) - 1 AS ix FROM documents")
def global_index(spark, sf):
    return W.global_index(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), ["source", F.desc("n_chars"), "doc_id"]).select("doc_id", "ix")


@query("null_surrogate", """
SELECT p_partkey, coalesce(id, 'null' || lpad(CAST(row_number() OVER (PARTITION BY id IS NULL ORDER BY p_name, p_partkey) - 1 AS VARCHAR), 5, '0')) AS id, coalesce(t, 'missing') AS type
FROM (SELECT *, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS id, CASE WHEN p_size > 10 THEN p_type END AS t FROM part)""")
def null_surrogate(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("id"),
                                        F.when(F.col("p_size") > 10, F.col("p_type")).alias("type"))
    return W.null_surrogate(p, "id", ["p_name", "p_partkey"]).fillna("missing", ["type"]).drop("p_name")


@query("order_by_multi", "SELECT row_number() OVER (ORDER BY n_chars DESC, lang, doc_id) - 1 AS pos, doc_id FROM documents")
def order_by_multi(spark, sf):
    return W.global_index(table(spark, sf, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "lang", "doc_id"),
                          [F.desc("n_chars"), "lang", "doc_id"], "pos").select("pos", "doc_id")


@query("top_k", "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber LIMIT 25")
def top_k(spark, sf):
    return W.top_k(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice"),
                   [F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber"], 25)


@query("limit_n", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 7")
def limit_n(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(7)


@query("argmax_row", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def argmax_row(spark, sf):
    return W.argmax_row(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("bernoulli_sample")
def bernoulli_sample(spark, sf):
    return table(spark, sf, "documents").select("doc_id").sample(False, 0.2, seed=42)


@query("hash_sample", "SELECT o_orderkey FROM orders WHERE ('0x' || md5(o_orderkey || '|3')[1:8])::BIGINT < CAST(floor(0.05 * 4294967296) AS BIGINT)")
def hash_sample(spark, sf):
    return S.hash_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.05, seed=3)


@query("fixed_n_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id || '|9'), doc_id LIMIT 50")
def fixed_n_sample(spark, sf):
    return S.fixed_n_sample(table(spark, sf, "documents").select("doc_id"), "doc_id", 50, 9)


@query("sample_size_fpc", """
WITH s(confidence, margin, p, deff, z) AS (VALUES (0.95::DOUBLE, 0.05::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE, 1.959964::DOUBLE), (0.95, 0.03, 0.5, 1.0, 1.959964), (0.99, 0.05, 0.5, 1.5, 2.575829)),
t AS (SELECT lang, count(*) AS population FROM documents GROUP BY 1),
n AS (SELECT *, z*z*p*(1-p)/(margin*margin)*deff AS n0 FROM t, s)
SELECT lang, population, confidence, margin, p, deff, round(n0, 6) AS n0, round(n0 / (1 + (n0-1)/population), 6) AS n_fpc, greatest(30, CAST(ceil(n0 / (1 + (n0-1)/population)) AS BIGINT)) AS sample_size FROM n""")
def sample_size_fpc(spark, sf):
    scenarios = [{"confidence": 0.95, "margin": 0.05}, {"confidence": 0.95, "margin": 0.03}, {"confidence": 0.99, "margin": 0.05, "deff": 1.5}]
    return S.sample_size_fpc(table(spark, sf, "documents"), "lang", scenarios).withColumn("n0", F.round("n0", 6)).withColumn("n_fpc", F.round("n_fpc", 6))


@query("proportion_interval", """
WITH t AS (SELECT toxic, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM labels GROUP BY 1), p AS (SELECT *, k / n AS ph, 1.959964::DOUBLE AS z FROM t),
w AS (SELECT *, (ph + z*z/(2*n)) / (1 + z*z/n) AS c, z / (1 + z*z/n) * sqrt(ph*(1-ph)/n + z*z/(4*n*n)) AS h FROM p)
SELECT toxic, n, k, round(ph, 6) AS p_hat, round(z*sqrt(ph*(1-ph)/n), 6) AS margin, round(c-h, 6) AS wilson_low, round(c+h, 6) AS wilson_high, CAST(ceil(400 / ph) AS BIGINT) AS samples_needed FROM w""")
def proportion_interval(spark, sf):
    out = S.proportion_interval(table(spark, sf, "labels"), F.col("quality") == 1, "toxic", target=400)
    for c in ("p_hat", "margin", "wilson_low", "wilson_high"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@query("block_shuffle", "SELECT vec_id, ix, ix // 64 AS block FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ix FROM embeddings)")
def block_shuffle(spark, sf):
    ix = W.global_index(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"])
    return S.block_shuffle(ix, "ix", 64, seed=5, epoch=1).drop("draw")
