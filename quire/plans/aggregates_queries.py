"""2.6 Aggregation."""

from pyspark.sql import functions as F

from quire.functions.scalars import sentence_count_punct, word_count_tokens
from quire.operators import aggregates as A
from quire.operators.sampling import hash_sample
from quire.plans.fixtures import LABELS_SQL, customer_orders, labels_combined
from quire.plans.registry import query, table


@query("count_rows", "SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("n"))


@query("count_distinct_cols", f"""WITH {LABELS_SQL}
SELECT 'label' AS columns, (SELECT count(*) FROM (SELECT DISTINCT label FROM labels_combined)) AS n_distinct
UNION ALL SELECT 'id', (SELECT count(*) FROM (SELECT DISTINCT id FROM labels_combined))
UNION ALL SELECT 'label+id', (SELECT count(*) FROM (SELECT DISTINCT label, id FROM labels_combined))""")
def count_distinct_cols(spark, sf):
    return A.count_distinct_cols(labels_combined(spark, sf), [["label"], ["id"], ["label", "id"]])


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf):
    return A.value_counts(table(spark, sf, "documents"), "lang")


@query("multi_key_counts", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def multi_key_counts(spark, sf):
    return A.value_counts(table(spark, sf, "events"), "event_type", "user_id")


@query("labels_per_record", "SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS n_labels FROM orders GROUP BY o_custkey")
def labels_per_record(spark, sf):
    return A.labels_per_record(customer_orders(spark, sf), "id", "orders")


@query("histogram_of_counts", "SELECT n AS count, count(*) AS n_keys FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def histogram_of_counts(spark, sf):
    return A.histogram_of_counts(table(spark, sf, "orders"), "o_custkey")


@query("sum_agg", "SELECT round(sum(l_quantity), 2) AS qty, CAST(sum(len(string_split(l_returnflag, ','))) AS BIGINT) AS n_flags FROM lineitem")
def sum_agg(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.sum(F.size(F.split("l_returnflag", ","))).alias("n_flags"))


@query("min_max_agg", "SELECT user_id, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def min_max_agg(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("collect_list_sorted", """
SELECT o_custkey, max(o_orderkey) AS first_value, count(*) AS n_values, 0 AS part_no, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS vals FROM orders GROUP BY 1""")
def collect_list_sorted(spark, sf):
    out = A.collect_list_sorted(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "desc")
    return out.select("o_custkey", "first_value", "n_values", "part_no", F.array_join(F.col("values").cast("array<string>"), ",").alias("vals"))


@query("collect_set_size", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_distinct FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 80")
def collect_set_size(spark, sf):
    return A.collect_set_size(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", 80)


@query("nested_agg", "SELECT o_orderpriority, avg(n) AS mean_orders, max(n) AS max_orders FROM (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def nested_agg(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return per.groupBy("o_orderpriority").agg(F.avg("n").alias("mean_orders"), F.max("n").alias("max_orders"))


_NUMERIC = ["l_quantity", "l_discount", "l_tax"]


def _describe_sql(cols, table_name):
    parts = []
    for c in cols:
        for stat, expr in (("count", f"count({c})"), ("mean", f"avg({c})"), ("stddev", f"stddev_samp({c})"), ("min", f"min({c})"), ("max", f"max({c})")):
            parts.append(f"SELECT '{c}' AS \"column\", '{stat}' AS stat, round(CASE WHEN {expr} = 0 THEN 0 ELSE CAST({expr} AS DOUBLE) END, 4) AS value FROM {table_name}")
    return " UNION ALL ".join(parts)


@query("describe_stats", _describe_sql(_NUMERIC, "lineitem"))
def describe_stats(spark, sf):
    return A.describe_stats(table(spark, sf, "lineitem"), _NUMERIC).withColumn("value", F.round("value", 4))


@query("summary_stats", _describe_sql(_NUMERIC, "lineitem") + "".join(
    f" UNION ALL SELECT '{c}', '{int(p * 100)}%', round(quantile_cont({c}, {p}), 4) FROM lineitem" for c in _NUMERIC for p in (0.25, 0.5, 0.75)))
def summary_stats(spark, sf):
    return A.summary_stats(table(spark, sf, "lineitem"), _NUMERIC).withColumn("value", F.round("value", 4))


_PS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("percentiles", " UNION ALL ".join(
    f"SELECT 'n_chars' AS \"column\", {p}::DOUBLE AS p, round(quantile_cont(n_chars::DOUBLE, {p}), 4) AS value FROM documents" for p in _PS))
def percentiles(spark, sf):
    return A.percentiles(table(spark, sf, "documents"), ["n_chars"], _PS).withColumn("value", F.round("value", 4))


@query("percentiles_sketch", " UNION ALL ".join(f"SELECT 'n_chars' AS \"column\", {p}::DOUBLE AS p, true AS within_bound" for p in _PS))
def percentiles_sketch(spark, sf):
    """Whether each sketched quantile's rank is within 1 % of the rows of the wanted one."""
    docs = table(spark, sf, "documents").select("n_chars")
    found = A.sketch_quantiles(docs, ["n_chars"], _PS).collect()  # one row per quantile
    share = lambda hit: F.avg(hit.cast("int"))
    checks = [F.struct(F.lit(r["column"]).alias("column"), F.lit(r["p"]).alias("p"), ((share(F.col("n_chars") < r["value"]) <= r["p"] + 0.01)
              & (share(F.col("n_chars") <= r["value"]) >= r["p"] - 0.01)).alias("within_bound")) for r in found]
    return docs.agg(F.array(*checks).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("mean_median", """
WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT round(avg(n), 6) AS mean, median(n) AS median, max(n)::DOUBLE AS max, min(n)::DOUBLE AS min, round(stddev_samp(n), 6) AS std FROM t""")
def mean_median(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return A.mean_median(per, "n").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("iqr_outliers", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.75) b, quantile_cont(l_tax, 0.25) c, quantile_cont(l_tax, 0.75) d FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem, q
WHERE l_extendedprice BETWEEN a - 0.5::DOUBLE * (b - a) AND b + 0.5::DOUBLE * (b - a) AND l_tax BETWEEN c - 0.5::DOUBLE * (d - c) AND d + 0.5::DOUBLE * (d - c) GROUP BY 1""")
def iqr_outliers(spark, sf):
    kept = A.iqr_outliers(table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], 0.5)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("quantile_trim", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.02) a, quantile_cont(l_extendedprice, 0.98) b, quantile_cont(l_quantity, 0.02) c, quantile_cont(l_quantity, 0.98) d FROM lineitem)
SELECT l_linestatus, count(*) AS n FROM lineitem, q WHERE l_extendedprice BETWEEN a AND b AND l_quantity BETWEEN c AND d GROUP BY 1""")
def quantile_trim(spark, sf):
    return A.quantile_trim(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], 0.02, 0.98).groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("top_n_plus_others", """
WITH t AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS rn FROM t)
SELECT CASE WHEN rn <= 5 THEN source ELSE 'Others' END AS source, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def top_n_plus_others(spark, sf):
    return A.top_n_plus_others(table(spark, sf, "documents"), "source", 5)


@query("share_percent", "SELECT count(*) AS n_total, count(*) FILTER (n_chars > 2000) AS n_match, round(count(*) FILTER (n_chars > 2000) * 100.0::DOUBLE / count(*), 6) AS percent FROM documents")
def share_percent(spark, sf):
    return A.share_percent(table(spark, sf, "documents"), F.col("n_chars") > 2000).withColumn("percent", F.round("percent", 6))


@query("pivot_counts", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P", count(*) FILTER (o_orderstatus = 'X') AS "X" FROM orders GROUP BY 1""")
def pivot_counts(spark, sf):
    return A.pivot_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P", "X"])


@query("agreement_rate", """
SELECT count(*) AS n_pairs, count(*) FILTER (quality = 1 - toxic) AS n_agree, round(count(*) FILTER (quality = 1 - toxic)::DOUBLE / count(*), 6) AS agreement FROM labels""")
def agreement_rate(spark, sf):
    l = table(spark, sf, "labels").select("quality", (1 - F.col("toxic")).alias("clean"))
    return A.agreement_rate(l, "quality", "clean").withColumn("agreement", F.round("agreement", 6))


@query("conditional_counts", """
SELECT lang, count(*) FILTER (n_chars > 3000) AS long_texts, count(*) FILTER (contains(text, '@')) AS with_at FROM documents GROUP BY 1""")
def conditional_counts(spark, sf):
    return A.conditional_counts(table(spark, sf, "documents"), {"long_texts": F.col("n_chars") > 3000, "with_at": F.col("text").contains("@")}, "lang")


@query("binned_histogram", """
SELECT 'width' AS kind, CAST(floor((value - (SELECT min(value) FROM events)) / 10) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 2
UNION ALL SELECT 'integer', CAST(floor(value) AS BIGINT) AS bin, count(*) FROM events WHERE value IS NOT NULL GROUP BY 2
UNION ALL SELECT 'log', CAST(floor(log10(value)) AS BIGINT) AS bin, count(*) FROM events WHERE value > 0 GROUP BY 2""")
def binned_histogram(spark, sf):
    e = table(spark, sf, "events")
    frames = {"width": A.binned_histogram(e, "value", 10), "integer": A.binned_histogram(e, "value"), "log": A.binned_histogram(e, "value", log=True)}
    return A.union_frames([df.withColumn("kind", F.lit(kind)) for kind, df in frames.items()])


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 5) AS corr FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def correlation_matrix(spark, sf):
    return A.correlation_matrix(table(spark, sf, "lineitem"), _CORR).withColumn("corr", F.round("corr", 5))


@query("group_top_values", """
SELECT p_brand, p_type, n FROM (SELECT p_brand, p_type, count(*) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2) WHERE rn <= 3""")
def group_top_values(spark, sf):
    return A.group_top_values(table(spark, sf, "part"), "p_brand", "p_type", 3)


@query("distinct_totals_by_source", f"""WITH {LABELS_SQL}, d AS (SELECT *, coalesce(id, '~null') AS idn FROM labels_combined)
SELECT source, count(*) AS n_rows, count(DISTINCT label) AS distinct_label, count(DISTINCT idn) AS distinct_id FROM d GROUP BY 1
UNION ALL SELECT 'all', count(*), count(DISTINCT label), count(DISTINCT idn) FROM d""")
def distinct_totals_by_source(spark, sf):
    return A.distinct_totals_by_source(labels_combined(spark, sf), "source", ["label", "id"])


@query("coverage_overlap", """
WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a JOIN b USING (doc_id)) AS n_both,
  round((SELECT count(*) FROM a JOIN b USING (doc_id)) * 100.0::DOUBLE / (SELECT count(*) FROM a), 6) AS percent""")
def coverage_overlap(spark, sf):
    out = A.coverage_overlap(table(spark, sf, "documents"), table(spark, sf, "labels").where("quality = 1"), "doc_id")
    return out.withColumn("percent", F.round("percent", 6))


@query("scale_up_estimate", """
WITH s AS (SELECT * FROM orders WHERE ('0x' || md5(o_orderkey || '|7')[1:8])::BIGINT < CAST(floor(0.1 * 4294967296) AS BIGINT))
SELECT round(sum(o_totalprice), 2) AS sample_total, count(*) AS sample_rows, round(sum(o_totalprice) / 0.1::DOUBLE, 1) AS estimate FROM s""")
def scale_up_estimate(spark, sf):
    out = A.scale_up_estimate(hash_sample(table(spark, sf, "orders"), "o_orderkey", 0.1, seed=7), "o_totalprice", 0.1)
    return out.withColumn("sample_total", F.round("sample_total", 2)).withColumn("estimate", F.round("estimate", 1))


@query("partition_profile")
def partition_profile(spark, sf):
    return A.partition_profile(table(spark, sf, "lineitem"))


@query("group_concat_top", """
WITH t AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20)
SELECT t.user_id, n, 0 AS part_no, string_agg(event_type, '; ' ORDER BY event_type) AS labels FROM t JOIN events e ON t.user_id = e.user_id GROUP BY 1, 2""")
def group_concat_top(spark, sf):
    return A.group_concat_top(table(spark, sf, "events"), "user_id", "event_type", 20)


@query("unpivot_long", r"""
WITH s AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n_words, len(string_split_regex(text, '[.!?]+')) AS n_sentences FROM documents)
SELECT doc_id, 'n_chars' AS metric, n_chars AS value FROM s UNION ALL SELECT doc_id, 'n_words', n_words FROM s UNION ALL SELECT doc_id, 'n_sentences', n_sentences FROM s""")
def unpivot_long(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n_chars"),
                                             word_count_tokens("text").cast("long").alias("n_words"), sentence_count_punct("text").cast("long").alias("n_sentences"))
    return A.unpivot_long(d, ["doc_id"], ["n_chars", "n_words", "n_sentences"])
