"""2.2 Sinks, catalog and incremental loading."""

import uuid

from pyspark.sql import functions as F

from quire.plans.registry import query, table
from quire.runtime import scratch_path
from quire.sources import sinks


@query("write_table", "SELECT s_suppkey, s_name FROM supplier")
def write_table(spark, sf):
    name = f"quire_supplier_{uuid.uuid4().hex[:8]}"
    return sinks.write_table(table(spark, sf, "supplier").select("s_suppkey", "s_name"), name, scratch_path(spark, "table"))


@query("write_parquet", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def write_parquet(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return sinks.write_parquet(df, scratch_path(spark, "parquet"), ["o_orderstatus"])


@query("export_csv_json", "SELECT 'csv' AS fmt, p_partkey, p_name FROM part UNION ALL SELECT 'json', p_partkey, p_name FROM part")
def export_csv_json(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name")
    csv, json = scratch_path(spark, "csv"), scratch_path(spark, "json")
    sinks.export_csv_json(df, csv, "csv")
    sinks.export_csv_json(df, json, "json")
    back = spark.read.schema(df.schema).csv(csv, header=True).withColumn("fmt", F.lit("csv"))
    return back.unionByName(spark.read.schema(df.schema).json(json).withColumn("fmt", F.lit("json")))


@query("fixed_size_shards", """
SELECT doc_id, ix, ix // 100 AS partition_id FROM (SELECT doc_id, row_number() OVER (ORDER BY lang, doc_id) - 1 AS ix FROM documents)""")
def fixed_size_shards(spark, sf):
    shards = sinks.fixed_size_shards(table(spark, sf, "documents").select("doc_id", "lang"), ["lang", "doc_id"], 100)
    back = sinks.write_parquet(shards, scratch_path(spark, "shards"), ["partition_id"])
    return back.select("doc_id", "ix", F.col("partition_id").cast("long").alias("partition_id"))


@query("hash_shards", """
SELECT page_id, ('0x' || md5(url)[1:8])::BIGINT % 7 AS shard FROM pages""")
def hash_shards(spark, sf):
    return sinks.hash_shards(table(spark, sf, "pages"), "url", 7).select("page_id", "shard")


@query("skip_existing", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def skip_existing(spark, sf):
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.skip_existing(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("partition_checkpoints", "SELECT o_orderpriority AS slice, o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2")
def partition_checkpoints(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.col("o_orderpriority").alias("slice"))
    return sinks.partition_checkpoints(
        df, lambda d: d.groupBy("slice", "o_custkey").agg(F.sum("o_totalprice").alias("total")),
        scratch_path(spark, "slices"), "slice")


@query("union_numbered_tables", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def union_numbered_tables(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    for i, kind in enumerate(["click", "view"]):
        e.where(F.col("event_type") == kind).createOrReplaceTempView(f"quire_events_{i:03d}")
    return sinks.union_numbered_tables(spark, r"quire_events_\d+")


@query("catalog_ops", "SELECT true AS before_drop, false AS after_drop, count(*) AS n_rows FROM customer")
def catalog_ops(spark, sf):
    name = f"quire_customer_{uuid.uuid4().hex[:8]}"
    path = scratch_path(spark, "table")
    n = sinks.write_table(table(spark, sf, "customer"), name, path).agg(F.count("*").alias("n_rows"))
    sinks.catalog_ops(spark, "refresh", name)
    before = sinks.catalog_ops(spark, "exists", name)
    n = spark.createDataFrame(n.collect(), n.schema)
    sinks.catalog_ops(spark, "drop", name)
    return n.select(F.lit(before).alias("before_drop"), F.lit(sinks.catalog_ops(spark, "exists", name)).alias("after_drop"), "n_rows")


@query("upsert_first_wins", """
WITH old AS (SELECT user_id, event_id, 'old' AS src FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) rn FROM events WHERE event_type = 'signup') WHERE rn = 1),
new AS (SELECT user_id, event_id, 'new' AS src FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events WHERE event_type = 'purchase') WHERE rn = 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE user_id NOT IN (SELECT user_id FROM old)""")
def upsert_first_wins(spark, sf):
    from quire.operators.setops import first_per_key
    e = table(spark, sf, "events")
    old = first_per_key(e.where("event_type = 'signup'").select("user_id", "event_id"), ["user_id"], ["event_id"]).withColumn("src", F.lit("old"))
    new = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts", F.lit("new").alias("src"))
    return sinks.upsert_first_wins(old.withColumn("ts", F.lit(None).cast("timestamp_ntz")), new, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("index_partition_sink", "SELECT vec_id || '_' || label AS es_doc_id FROM embeddings")
def index_partition_sink(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("chunk_index"),
                                               F.concat(F.lit("vector "), "vec_id").alias("chunk_text"), "embedding", "label")
    return sinks.index_partition_sink(df, scratch_path(spark, "index"), metadata_cols=["label"])


@query("matrix_index_export", """
SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_index, len(embedding) AS dim FROM embeddings WHERE label <> 3""")
def matrix_index_export(spark, sf):
    df = table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("label") != 3, F.col("embedding")))
    out = sinks.matrix_index_export(df, "vec_id", "embedding", 64)
    return out.select("vec_id", "row_index", F.size("embedding").cast("long").alias("dim"))


@query("fetch_status", """
WITH r AS (SELECT page_id, html, CASE WHEN contains(url, '#') THEN '' WHEN contains(url, 'blog') THEN NULL ELSE url END AS url,
  CASE WHEN url LIKE 'https%' THEN 200 WHEN page_id % 3 = 0 THEN 404 WHEN page_id % 3 = 1 THEN 503 END AS code FROM pages)
SELECT page_id, CASE WHEN url IS NULL OR trim(url) = '' THEN 'empty_url' WHEN code IS NULL THEN 'error' WHEN code = 200 THEN 'success'
  WHEN code = 404 THEN 'not_found' ELSE 'status_' || code END AS download_status,
  CAST(CASE WHEN url IS NOT NULL AND trim(url) <> '' AND code = 200 THEN length(html) END AS BIGINT) AS n_chars FROM r""")
def fetch_status(spark, sf):
    pages = table(spark, sf, "pages")
    code = (F.when(F.col("url").startswith("https"), 200).when(F.col("page_id") % 3 == 0, 404).when(F.col("page_id") % 3 == 1, 503))
    url = F.when(F.col("url").contains("#"), "").when(F.col("url").contains("blog"), None).otherwise(F.col("url"))
    out = sinks.fetch_status(pages.select("page_id", "html", code.alias("code"), url.alias("url")), "url", "code", "html")
    return out.select("page_id", "download_status", F.length("text").cast("long").alias("n_chars"))


@query("failed_download_audit", """
SELECT count(*) AS n_total, count(*) FILTER (strlen(body) < 3) AS n_failed, round(count(*) FILTER (strlen(body) < 3) * 100.0::DOUBLE / count(*), 4) AS pct_failed
FROM (SELECT CASE WHEN lang = 'fr' THEN '{}' ELSE text END AS body FROM documents)""")
def failed_download_audit(spark, sf):
    df = table(spark, sf, "documents").select(F.when(F.col("lang") == "fr", "{}").otherwise(F.col("text")).alias("body"))
    return sinks.failed_download_audit(df, "body")
