"""2.1 Sources."""

from pyspark.sql import functions as F

from quire.operators.nested import nest_children
from quire.plans.fixtures import threads
from quire.plans.registry import query, table
from quire.runtime import scratch_path
from quire.sources import readers


@query("read_jsonl", "SELECT event_id, user_id, event_type, round(value, 4) AS value, props FROM events")
def read_jsonl(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props").write.option(
        "compression", "gzip").json(path)
    return readers.read_jsonl(spark, path).select(
        "event_id", "user_id", "event_type", F.round("value", 4).alias("value"), "props")


@query("read_json_docs", "SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def read_json_docs(spark, sf):
    # a document file holds the records of a hundred conversations as one JSON array over many lines
    path = scratch_path(spark, "json-docs")
    docs = nest_children(threads(spark, sf).withColumn("batch", F.expr("conv_id div 100")), ["batch"], ["conv_id", "turns"],
                         ["conv_id"], out="records", max_items=1000)
    docs.select(F.regexp_replace(F.to_json("records"), r"\},\{", "},\n{")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_json_docs(spark, path).select("conv_id", F.size("turns").cast("long").alias("n_turns"))


@query("read_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query("read_csv_strings", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def read_csv_strings(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").write.csv(path, header=True)
    return readers.read_csv_strings(spark, path)


@query("read_table", "SELECT r_regionkey, r_name FROM region")
def read_table(spark, sf):
    table(spark, sf, "region").createOrReplaceTempView("quire_region")
    return readers.read_table(spark, "quire_region")


@query("json_infer_parse", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_infer_parse(spark, sf):
    out = readers.json_infer_parse(table(spark, sf, "events").select("event_id", "props"), "props", "parsed")
    return out.select("event_id", F.col("parsed.k").alias("k"))


@query("key_from_filename", r"""
WITH f AS (SELECT page_id, 'https://x.org/' || page_id || '_' || regexp_extract(url, '//([^/.]*)', 1) || '_v2.json' AS path FROM pages)
SELECT page_id, CAST(page_id AS VARCHAR) AS id, regexp_extract(path, '_(.*)\.json$', 1) AS manifest_id FROM f""")
def key_from_filename(spark, sf):
    files = table(spark, sf, "pages").select("page_id", F.concat(
        F.lit("https://x.org/"), "page_id", F.lit("_"), F.regexp_extract("url", "//([^/.]*)", 1), F.lit("_v2.json")).alias("path"))
    return readers.key_from_filename(files, "path").select("page_id", "id", "manifest_id")


@query("export_visible_records", """
SELECT o_orderkey, coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN 'u' || o_custkey END, 'o' || o_orderkey) AS canonical_id,
       '2024-11-14' AS exported_at
FROM orders WHERE o_orderstatus NOT IN ('P')""")
def export_visible_records(spark, sf):
    ids = [F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("u"), "o_custkey")), F.concat(F.lit("o"), "o_orderkey")]
    return readers.export_visible_records(table(spark, sf, "orders"), "o_orderstatus", ["P"], ids, "2024-11-14").select(
        "o_orderkey", "canonical_id", "exported_at")
