"""2.9 Scalar functions."""

from pyspark.sql import functions as F

from quire.functions import scalars as S
from quire.plans.registry import query, table


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("lower_trim", "SELECT p_partkey, lower(trim(' ' || p_name || ' ')) AS name FROM part")
def lower_trim(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.lower_trim(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("name"))


@query("regexp_replace_clean", "SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z ]', '', 'g')) AS clean_md5 FROM documents")
def regexp_replace_clean(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(S.regexp_replace_clean("text")).alias("clean_md5"))


@query("split_regex", r"SELECT doc_id, len(string_split_regex(text, '[.!?]+')) AS n_parts, string_split_regex(text, '[.!?]+')[1] AS first_part FROM documents")
def split_regex(spark, sf):
    parts = S.split_regex("text", r"[.!?]+")
    return _docs(spark, sf).select("doc_id", F.size(parts).cast("long").alias("n_parts"), parts[0].alias("first_part"))


@query("concat_lit", "SELECT doc_id, 'https://x.org/works/' || doc_id || '_' || lang AS url FROM documents")
def concat_lit(spark, sf):
    return _docs(spark, sf).select("doc_id", S.concat_lit(F.lit("https://x.org/works/"), "doc_id", F.lit("_"), "lang").alias("url"))


@query("char_length", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents")
def char_length(spark, sf):
    return _docs(spark, sf).select("doc_id", S.char_length("text").cast("long").alias("n"))


@query("byte_length", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents")
def byte_length(spark, sf):
    return _docs(spark, sf).select("doc_id", S.byte_length("text").cast("long").alias("n"))


@query("bytes_per_word", r"SELECT doc_id, round(strlen(text) / len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')), 6) AS ratio FROM documents")
def bytes_per_word(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(S.bytes_per_word("text"), 6).alias("ratio"))


@query("coalesce_default", "SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_default(spark, sf):
    return _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", S.coalesce_default("quality", -1).alias("quality"))


@query("url_last_segment", r"SELECT page_id, regexp_extract(url, '([^/]+)/*$', 1) AS segment FROM pages")
def url_last_segment(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.url_last_segment("url").alias("segment"))


@query("safe_filename", r"SELECT page_id, translate(url, '/\:', '___') AS filename FROM pages")
def safe_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.safe_filename("url").alias("filename"))


@query("word_count_tokens", r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM documents")
def word_count_tokens(spark, sf):
    return _docs(spark, sf).select("doc_id", S.word_count_tokens("text").cast("long").alias("n"))


@query("word_count_split", r"SELECT doc_id, len(string_split_regex(text, '\s+')) AS n FROM documents")
def word_count_split(spark, sf):
    return _docs(spark, sf).select("doc_id", S.word_count_split("text").cast("long").alias("n"))


@query("sentence_count_punct", r"SELECT doc_id, len(string_split_regex(text, '[.!?]+')) AS n FROM documents")
def sentence_count_punct(spark, sf):
    return _docs(spark, sf).select("doc_id", S.sentence_count_punct("text").cast("long").alias("n"))


@query("date_trunc_month", "SELECT CAST(date_trunc('month', o_orderdate) AS VARCHAR)[1:10] AS month, count(*) AS n FROM orders GROUP BY 1")
def date_trunc_month(spark, sf):
    month = F.date_format(S.date_trunc_month("o_orderdate"), "yyyy-MM-dd")
    return table(spark, sf, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("n"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", S.json_field("props", "$.k").alias("k"))


@query("minmax_scale", """
SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events) + 1e-8), 6) AS scaled FROM events""")
def minmax_scale(spark, sf):
    e = table(spark, sf, "events")
    lo, hi = e.agg(F.min("value"), F.max("value")).first()  # two numbers
    return e.select("event_id", F.round(S.minmax_scale("value", F.lit(lo), F.lit(hi)), 6).alias("scaled"))


@query("type_cast", "SELECT event_id, CAST(value AS VARCHAR) AS as_text, TRY_CAST(event_type AS INTEGER) AS as_int, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS as_double FROM events")
def type_cast(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", S.type_cast("value", "string").alias("as_text"), S.type_cast("event_type", "int").alias("as_int"),
        S.type_cast(S.json_field("props", "$.k"), "double").alias("as_double"))


@query("year_to_int", r"""
SELECT y AS year, count(*) AS n FROM (SELECT TRY_CAST(regexp_extract(url, '/([0-9a-z.]*)$', 1) AS INTEGER) AS y FROM pages) GROUP BY 1""")
def year_to_int(spark, sf):
    y = S.year_to_int(F.regexp_extract("url", r"/([0-9a-z.]*)$", 1))
    return table(spark, sf, "pages").groupBy(y.alias("year")).agg(F.count("*").alias("n"))


@query("template_prompt", "SELECT item_id, 'Instruct: Find passages' || chr(10) || 'Query: ' || text AS prompt FROM benchmark")
def template_prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.template_prompt("Find passages", "text").alias("prompt"))
