"""2.8 Set operations and de-duplication."""

from pyspark.sql import functions as F

from quire.operators import setops as S
from quire.plans.registry import query, table


@query("union_all", "SELECT c_name AS label, 'customer' AS source FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier")
def union_all(spark, sf):
    return S.union_all(("customer", table(spark, sf, "customer").select(F.col("c_name").alias("label"))),
                       ("supplier", table(spark, sf, "supplier").select(F.col("s_name").alias("label"))))


@query("distinct_rows", "SELECT DISTINCT p_name, p_brand FROM part")
def distinct_rows(spark, sf):
    return table(spark, sf, "part").select("p_name", "p_brand").distinct()


@query("drop_dup_keys_count", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def drop_dup_keys_count(spark, sf):
    return table(spark, sf, "lineitem").dropDuplicates(["l_partkey", "l_suppkey"]).agg(F.count("*").alias("n"))


@query("first_per_key", """
SELECT p_name, p_partkey, p_brand FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn = 1""")
def first_per_key(spark, sf):
    return S.first_per_key(table(spark, sf, "part"), ["p_name"], [F.desc("p_retailprice"), "p_partkey"]).select("p_name", "p_partkey", "p_brand")


@query("drop_dup_then_group", "SELECT p_brand, count(*) AS n FROM (SELECT DISTINCT p_name, p_brand FROM part) GROUP BY 1")
def drop_dup_then_group(spark, sf):
    return S.drop_dup_then_group(table(spark, sf, "part"), ["p_name", "p_brand"], ["p_brand"])


@query("validity_report", """
SELECT count(*) + count(*) FILTER (label = 4) AS total_rows, count(*) FILTER (label = 1) AS null_vectors, count(*) FILTER (label = 2) AS bad_vectors,
  count(*) FILTER (label = 4) AS duplicates, count(*) FILTER (label NOT IN (1, 2)) AS kept FROM embeddings""")
def validity_report(spark, sf):
    e = table(spark, sf, "embeddings")
    broken = e.select("vec_id", F.when(F.col("label") == 1, None).when(F.col("label") == 2, F.slice("embedding", 1, 10))
                      .otherwise(F.col("embedding")).alias("embedding"))
    again = e.where("label = 4").select("vec_id", "embedding")
    return S.validity_report(broken.unionByName(again), "vec_id", "embedding", 64)
