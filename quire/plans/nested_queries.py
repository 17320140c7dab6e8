"""2.3 Projection and nested data."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import nested as N
from quire.functions.scalars import array_distinct_ordered
from quire.operators import nested as O
from quire.plans.fixtures import customer_orders, geography, threads, works
from quire.plans.registry import query, table


@query("explode_array", "SELECT conv_id, role, length(text) AS n_chars FROM conversations")
def explode_array(spark, sf):
    return O.explode_array(threads(spark, sf), "turns", "t").select(
        "conv_id", F.col("t.role").alias("role"), F.length("t.text").cast("long").alias("n_chars"))


@query("explode_outer_keep", """
SELECT CAST(c_custkey AS VARCHAR) AS id, o_orderkey AS order_key FROM customer
LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey""")
def explode_outer_keep(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select("o_custkey", "o_orderkey")
    kids = O.nest_children(o, ["o_custkey"], ["o_orderkey"], ["o_orderkey"], out="orders")
    parents = table(spark, sf, "customer").join(kids, F.col("c_custkey") == F.col("o_custkey"), "left")
    return O.explode_outer_keep(parents, "orders", "o").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("o.o_orderkey").alias("order_key"))


@query("explode_multi_level", """
SELECT r_name, n_name, s_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey""")
def explode_multi_level(spark, sf):
    return O.explode_multi_level(geography(spark, sf), ["nations", "suppliers"], ["r_name"]).select(
        "r_name", F.col("_1.n_name").alias("n_name"), F.col("_2.s_name").alias("s_name"))


@query("explode_cross", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus AS a, o_orderpriority AS b FROM orders)
SELECT CAST(c_custkey AS VARCHAR) AS id, x.a AS status, y.b AS priority
FROM customer JOIN (SELECT DISTINCT o_custkey, a FROM o) x ON c_custkey = x.o_custkey
JOIN (SELECT DISTINCT o_custkey, b FROM o) y ON c_custkey = y.o_custkey""")
def explode_cross(spark, sf):
    df = customer_orders(spark, sf).select("id", F.expr("array_distinct(orders.status)").alias("statuses"),
                                           F.expr("array_distinct(orders.priority)").alias("priorities"))
    return O.explode_cross(df, {"statuses": "status", "priorities": "priority"}, ["id"])


@query("posexplode_index", """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS pos, role FROM conversations""")
def posexplode_index(spark, sf):
    return O.posexplode_index(threads(spark, sf), "turns", "pos", "t").select(
        "conv_id", F.col("pos").cast("long").alias("pos"), F.col("t.role").alias("role"))


@query("struct_star", "SELECT o_orderkey, o_orderstatus AS f_status, o_orderpriority AS f_priority FROM orders")
def struct_star(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.struct(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("s"))
    return O.struct_star(df, "s", prefix="f_")


@query("nested_path_project", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_mktsegment AS work_type, lower(c_mktsegment) AS work_type_id FROM customer")
def nested_path_project(spark, sf):
    return O.nested_path_project(works(spark, sf), {"id": "id", "work_type": "workType.label", "work_type_id": "workType.id"})


@query("first_element", """
SELECT CAST(c_custkey AS VARCHAR) AS id, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def first_element(spark, sf):
    return customer_orders(spark, sf).select("id", N.first_element("orders", "key").alias("first_order"))


@query("transform_join", """
SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(string_agg(o_orderpriority, '; ' ORDER BY o_orderkey), '') AS priorities
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def transform_join(spark, sf):
    return customer_orders(spark, sf).select("id", N.transform_join("orders", "priority").alias("priorities"))


@query("nested_transform_join", """
WITH i AS (SELECT l_orderkey, string_agg('part ' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS body
           FROM lineitem GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(string_agg(o_orderpriority || ': ' || body, '; ' ORDER BY o_orderkey), '') AS notes
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def nested_transform_join(spark, sf):
    return works(spark, sf).select("id", N.nested_transform_join("notes", "contents", prefix="noteType.label").alias("notes"))


@query("case_size_null", """
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN count(o_orderkey) > 0 THEN string_agg(o_orderstatus, ',' ORDER BY o_orderkey) END AS late_orders
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') ON c_custkey = o_custkey GROUP BY c_custkey""")
def case_size_null(spark, sf):
    late = F.expr("filter(orders, o -> o.date >= timestamp'2000-01-01')")
    df = customer_orders(spark, sf).select("id", late.alias("late"))
    return df.select("id", N.case_size_null("late", F.array_join(F.col("late.status"), ",")).alias("late_orders"))


WORKS_TEXT_SQL = """
WITH i AS (SELECT l_orderkey, string_agg('part ' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS body,
                  string_agg('part ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS subj
           FROM lineitem GROUP BY 1),
works_text AS (
SELECT CAST(c_custkey AS VARCHAR) AS id, any_value(c_name) AS title,
  CASE WHEN any_value(c_acctbal) >= 0 THEN any_value(c_mktsegment) END AS description,
  CAST(NULL AS VARCHAR) AS "physicalDescription", CAST(NULL AS VARCHAR) AS lettering,
  'nation/' || any_value(c_nationkey) AS "referenceNumber", CAST(NULL AS VARCHAR) AS edition,
  coalesce(string_agg(CASE WHEN o_orderstatus <> 'P' THEN 'Agent ' || o_orderkey || ' (' ||
     CASE WHEN o_orderstatus = 'O' THEN 'contributor' ELSE o_orderstatus END || ')' END, '; ' ORDER BY o_orderkey), '') AS contributor_names,
  coalesce(string_agg(o_orderpriority, '; ' ORDER BY o_orderkey), '') AS alternative_titles,
  coalesce(string_agg(subj, '; ' ORDER BY o_orderkey), '') AS subject_labels,
  coalesce(string_agg(o_orderstatus, '; ' ORDER BY o_orderkey), '') AS genre_labels,
  '' AS language_labels,
  coalesce(string_agg(CAST(year(o_orderdate) AS VARCHAR), '; ' ORDER BY o_orderkey), '') AS production_info,
  coalesce(string_agg(body, '; ' ORDER BY o_orderkey), '') AS note_contents,
  any_value(c_mktsegment) AS work_type,
  CASE WHEN any_value(c_nationkey) < 12 THEN 'Online; Open shelves' ELSE '' END AS availability_labels
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN i ON l_orderkey = o_orderkey GROUP BY c_custkey)"""


@query("works_text_flattened", WORKS_TEXT_SQL + " SELECT * FROM works_text")
def works_text_flattened(spark, sf):
    return O.works_text_flattened(works(spark, sf))


@query("concat_text_columns", """
SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR)) AS text FROM part""")
def concat_text_columns(spark, sf):
    return O.concat_text_columns(table(spark, sf, "part"), ["p_name", "p_brand", "p_type", "p_size"], "text").select("p_partkey", "text")


@query("filter_array", """
SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS order_key FROM orders WHERE o_orderstatus = 'F'""")
def filter_array(spark, sf):
    df = customer_orders(spark, sf).select("id", N.filter_array("orders", lambda o: o["status"] == "F").alias("done"))
    return O.explode_array(df, "done", "o").select("id", F.col("o.key").alias("order_key"))


@query("from_json_array", """
SELECT o_orderkey, l_partkey AS part, round(l_quantity, 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 25""")
def from_json_array(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))
    docs = O.nest_children(lines, ["l_orderkey"], ["part", "qty"], ["part", "qty"], out="items").select(
        "l_orderkey", F.to_json("items").alias("rendering"))
    docs = table(spark, sf, "orders").select("o_orderkey").join(docs, F.col("o_orderkey") == F.col("l_orderkey"))
    schema = T.ArrayType(T.StructType([T.StructField("part", T.LongType()), T.StructField("qty", T.DoubleType())]))
    return O.from_json_array(docs, "rendering", schema, lambda x: x["qty"] > 25).select(
        "o_orderkey", F.col("element.part").alias("part"), F.round("element.qty", 2).alias("qty"))


_MANIFEST = """transform(turns, t -> named_struct('images', transform(
    filter(array(t.role, t.text), x -> t.role <> 'system'),
    x -> named_struct('resource', named_struct('@id', if(t.role = 'assistant', '', concat(conv_id, '/', t.turn)))))))"""


@query("nested_first_resource_ids", """
SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN conv_id || '/' || turn END, ',' ORDER BY turn, role), '') AS image_ids
FROM conversations GROUP BY conv_id""")
def nested_first_resource_ids(spark, sf):
    manifests = threads(spark, sf).select("conv_id", F.expr(f"array(named_struct('canvases', {_MANIFEST}))").alias("sequences"))
    return O.nested_first_resource_ids(manifests, "sequences").select("conv_id", F.array_join("image_ids", ",").alias("image_ids"))


@query("array_size_of_path", "SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def array_size_of_path(spark, sf):
    manifests = threads(spark, sf).select("conv_id", F.expr(f"array(named_struct('canvases', {_MANIFEST}))").alias("sequences"))
    return manifests.select("conv_id", N.array_size_of_path("sequences", "canvases").cast("long").alias("n_pages"))


@query("child_table_project", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos0 FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS parent_key, pos0,
  row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos1,
  l_partkey AS part, l_suppkey AS supp, l_quantity AS qty, l_extendedprice AS price, l_returnflag AS flag
FROM o JOIN lineitem ON o_orderkey = l_orderkey""")
def child_table_project(spark, sf):
    out = O.child_table(customer_orders(spark, sf), "orders.items")
    return out.withColumn("pos0", F.col("pos0").cast("long")).withColumn("pos1", F.col("pos1").cast("long"))


@query("partof_edges", """
WITH s AS (SELECT 's' || s_suppkey AS sid, 'n' || n_nationkey AS nid, 'r' || r_regionkey AS rid
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT sid AS child, nid AS parent, 1 AS depth FROM s UNION ALL SELECT nid, rid, 2 FROM s""")
def partof_edges(spark, sf):
    s = (table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
         .join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    records = s.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.expr("""array(named_struct(
        'id', concat('n', n_nationkey), 'partOf', array(named_struct('id', concat('r', r_regionkey)))))""").alias("partOf"))
    return O.partof_edges(records, 2)


_WORLD = "SELECT 'r' || r_regionkey AS child, 'world' AS parent FROM region UNION ALL SELECT 'world', 'r' || min(r_regionkey) FROM region"


@query("partof_closure", f"""
WITH RECURSIVE e AS (SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL {_WORLD}),
p AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION SELECT p.child, e.parent, depth + 1 FROM p JOIN e ON p.ancestor = e.child WHERE depth < 8)
SELECT child, ancestor, CAST(min(depth) AS BIGINT) AS depth FROM p GROUP BY 1, 2""")
def partof_closure(spark, sf):
    """Suppliers and customers in nations in regions in the world, which is said to be part of one of them."""
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("child"), F.concat(F.lit(b), y).alias("parent"))
    region = table(spark, sf, "region")
    edges = [edge(table(spark, sf, "supplier"), "s", "s_suppkey", "n", "s_nationkey"), edge(table(spark, sf, "customer"), "c", "c_custkey", "n", "c_nationkey"),
             edge(table(spark, sf, "nation"), "n", "n_nationkey", "r", "n_regionkey"), region.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent")),
             region.agg(F.min("r_regionkey").alias("k")).select(F.lit("world").alias("child"), F.concat(F.lit("r"), "k").alias("parent"))]
    return O.partof_closure(reduce(DataFrame.unionByName, edges))


@query("nest_children", """
SELECT o_custkey, 0 AS part_no, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY o_custkey""")
def nest_children(spark, sf):
    out = O.nest_children(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderkey"])
    return out.select("o_custkey", "part_no", F.array_join(F.expr("transform(children, x -> cast(x.o_orderkey as string))"), ",").alias("order_keys"))


@query("row_to_json_doc", """
SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS doc FROM nation""")
def row_to_json_doc(spark, sf):
    return O.row_to_json_doc(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


@query("drop_rename_cols", "SELECT p_partkey, p_name AS label, p_brand, 'part' AS source FROM part")
def drop_rename_cols(spark, sf):
    return O.drop_rename_cols(table(spark, sf, "part"), ["p_type", "p_size", "p_retailprice"], {"p_name": "label"}, {"source": "part"})


@query("schema_profile", """
WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT count(*) AS n_rows FROM customer)
SELECT 'id' AS path, 'string' AS type, n_rows, n_rows AS non_null, CAST(NULL AS BIGINT) AS max_size FROM c
UNION ALL SELECT 'orders', 'array<struct<key:bigint,status:string,items:array<struct<part:bigint>>>>', n_rows, (SELECT count(*) FROM p WHERE o_custkey IN (SELECT c_custkey FROM customer)), (SELECT max(n) FROM p) FROM c
UNION ALL SELECT 'orders.key', 'bigint', n_rows, (SELECT count(*) FROM o), NULL FROM c
UNION ALL SELECT 'orders.status', 'string', n_rows, (SELECT count(o_orderstatus) FROM o), NULL FROM c
UNION ALL SELECT 'orders.items', 'array<struct<part:bigint>>', n_rows, (SELECT count(n) FROM o), (SELECT max(n) FROM o) FROM c
UNION ALL SELECT 'orders.items.part', 'bigint', n_rows, CAST((SELECT sum(n) FROM o) AS BIGINT), NULL FROM c""")
def schema_profile(spark, sf):
    df = customer_orders(spark, sf).select("id", F.expr("""transform(orders, o -> named_struct('key', o.key, 'status', o.status,
        'items', transform(o.items, i -> named_struct('part', i.part))))""").alias("orders"))
    return O.schema_profile(df)


@query("array_distinct_ordered", """
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
SELECT CAST(o_custkey AS VARCHAR) AS id, string_agg(o_orderpriority, ',' ORDER BY k) AS priorities FROM f GROUP BY o_custkey""")
def array_distinct_ordered_query(spark, sf):
    df = customer_orders(spark, sf).where("orders is not null")
    return df.select("id", F.array_join(array_distinct_ordered(F.col("orders.priority")), ",").alias("priorities"))
