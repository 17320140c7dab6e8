"""2.4 Filters and predicates."""

from pyspark.sql import functions as F

from quire.functions import predicates as P
from quire.operators.nested import explode_array
from quire.plans.fixtures import customer_orders
from quire.plans.registry import query, table


@query("eq_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def eq_filter(spark, sf):
    return table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_orderstatus")


@query("in_filter", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (1, 2, 3)")
def in_filter(spark, sf):
    e = table(spark, sf, "events")
    return e.where(F.col("event_type").isin("click", "view") & ~F.col("user_id").isin(1, 2, 3)).select("event_id", "event_type")


@query("null_empty_filter", """
SELECT page_id FROM pages WHERE length(regexp_extract(url, '\\?(.*)$', 1)) > 0 AND html IS NOT NULL""")
def null_empty_filter(spark, sf):
    df = table(spark, sf, "pages").withColumn("query", F.regexp_extract("url", r"\?(.*)$", 1))
    return df.where(P.null_empty("query") & P.null_empty("html")).select("page_id")


@query("contains_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'widget')")
def contains_filter(spark, sf):
    return table(spark, sf, "part").where(P.contains_ci("p_name", "RED", "widget")).select("p_partkey", "p_name")


@query("like_rlike", """
SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority LIKE '%URGENT%' AND regexp_matches(o_orderstatus, '^[FO]$') GROUP BY 1""")
def like_rlike(spark, sf):
    o = explode_array(customer_orders(spark, sf).select("id", F.filter("orders", lambda x: x["priority"].like("%URGENT%")).alias("u")), "u", "x")
    return (o.where(F.col("x.status").rlike("^[FO]$")).groupBy(F.col("id").cast("long").alias("o_custkey"))
            .agg(F.count("*").alias("n")))


@query("exists_nested", """
SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity >= 50""")
def exists_nested(spark, sf):
    hit = P.exists_nested("orders", lambda o: P.exists_nested(o["items"], lambda i: i["qty"] >= 50))
    return customer_orders(spark, sf).where(hit).select("id")


@query("length_filter", "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) >= 2000")
def length_filter(spark, sf):
    return table(spark, sf, "documents").where(F.length(F.trim("text")) >= 2000).select("doc_id")


@query("having_filter", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 10")
def having_filter(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 10")


_SEARCH_SQL = """WITH r AS (SELECT p_partkey AS idx, lower(p_name) AS l, lower(p_type) AS t, p_name AS label, p_type AS type FROM part),
h AS (SELECT *, contains(l,'red') AS l1, contains(t,'red') AS t1, contains(l,'widget') AS l2, contains(t,'widget') AS t2,
             contains(l,'economy') AS l3, contains(t,'economy') AS t3 FROM r)
"""


@query("boolean_query_search", _SEARCH_SQL + """
SELECT idx, label, type, concat_ws(',', CASE WHEN l1 OR l2 OR l3 THEN 'label' END, CASE WHEN t1 OR t2 OR t3 THEN 'type' END) AS match_fields,
  concat_ws(',', CASE WHEN l1 OR t1 THEN 'red' END, CASE WHEN l2 OR t2 THEN 'widget' END, CASE WHEN l3 OR t3 THEN 'economy' END) AS matched_terms
FROM h WHERE ((l1 OR t1) AND (l2 OR t2)) OR (l3 OR t3)""")
def boolean_query_search(spark, sf):
    records = table(spark, sf, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("label"), F.col("p_type").alias("type"))
    out = P.boolean_query_search(records, "Red AND widget or ECONOMY")
    return out.select("idx", "label", "type", F.array_join("match_fields", ",").alias("match_fields"),
                      F.array_join("matched_terms", ",").alias("matched_terms"))


@query("pair_search", """
WITH p AS (SELECT l_partkey AS idx_l, l_suppkey AS idx_r, p_name AS label_l, p_type AS type_l, s_name AS label_r, l_shipmode AS type_r,
      CASE WHEN l_returnflag = 'R' THEN 'distinct' ELSE 'match' END AS pair_label
    FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linestatus AS l_shipmode, max(l_returnflag) OVER (PARTITION BY l_partkey, l_suppkey) AS l_returnflag FROM lineitem)
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
m AS (SELECT *, (contains(lower(label_l),'blue') OR contains(lower(type_l),'blue')) AND (contains(lower(label_l),'bolt') OR contains(lower(type_l),'bolt')) AS record1_matches,
        (contains(lower(label_r),'blue') OR contains(lower(type_r),'blue')) AND (contains(lower(label_r),'bolt') OR contains(lower(type_r),'bolt')) AS record2_matches FROM p)
SELECT idx_l, idx_r, type_r, pair_label, record1_matches, record2_matches FROM m
WHERE pair_label = 'match' AND (record1_matches OR record2_matches)""")
def pair_search(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.max("l_returnflag").alias("flag"), F.array_sort(F.collect_set("l_linestatus")).alias("types"))
    pairs = (li.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
             .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("l_partkey").alias("idx_l"), F.col("l_suppkey").alias("idx_r"), F.col("p_name").alias("label_l"),
                     F.col("p_type").alias("type_l"), F.col("s_name").alias("label_r"), F.explode("types").alias("type_r"),
                     F.when(F.col("flag") == "R", "distinct").otherwise("match").alias("pair_label")))
    out = P.pair_search(pairs, "blue AND bolt", "match", order_by=("idx_l", "idx_r", "type_r"))
    return out.select("idx_l", "idx_r", "type_r", "pair_label", "record1_matches", "record2_matches")


@query("struct_field_filter", "SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS order_key FROM orders WHERE o_orderpriority = '5-LOW'")
def struct_field_filter(spark, sf):
    o = explode_array(customer_orders(spark, sf), "orders", "o")
    return o.where(F.col("o.priority") == "5-LOW").select("id", F.col("o.key").alias("order_key"))


@query("range_outlier_filter", "SELECT event_id, value FROM events WHERE value BETWEEN 1 AND 30")
def range_outlier_filter(spark, sf):
    return table(spark, sf, "events").where(F.col("value").between(1, 30)).select("event_id", "value")


@query("metadata_prefilter", "SELECT vec_id, label FROM embeddings WHERE label IN (2, 3)")
def metadata_prefilter(spark, sf):
    return P.metadata_prefilter(table(spark, sf, "embeddings"), {"label": [2, 3]}).select("vec_id", "label")
