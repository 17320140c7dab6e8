"""Works-shaped, geography-shaped and label tables that Spark derives from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.nested import nest_children
from quire.plans.registry import table


def customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    """``id, label, orders[key, status, priority, date, items[part, supp, qty, price, flag]]`` per customer."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))
    items = nest_children(lines, ["l_orderkey"], ["part", "supp", "qty", "price", "flag"],
                          ["l_linenumber", "part", "supp", "qty", "price"], out="items").drop("part_no")
    orders = table(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_custkey", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("date"), "items")
    nested = nest_children(orders, ["o_custkey"], ["key", "status", "priority", "date", "items"], ["key"], out="orders")
    # a customer of several pages is several records, each with an id of its own
    page = F.when(F.col("part_no") > 0, F.concat(F.lit("#"), "part_no")).otherwise(F.lit(""))
    return table(spark, sf, "customer").join(nested, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.concat(F.col("c_custkey").cast("string"), page).alias("id"), F.col("c_name").alias("label"),
        "c_nationkey", "c_acctbal", "c_mktsegment", "orders")


def works(spark: SparkSession, sf: str) -> DataFrame:
    """Catalogue-record shape over customers, orders and line items."""
    null = F.lit(None).cast("string")
    year = "cast(year(o.date) as string)"
    return customer_orders(spark, sf).select(
        "id", F.col("label").alias("title"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("description"),
        null.alias("physicalDescription"), null.alias("lettering"),
        F.concat(F.lit("nation/"), F.col("c_nationkey")).alias("referenceNumber"), null.alias("edition"),
        F.expr("transform(orders, o -> o.priority)").alias("alternativeTitles"),
        F.expr("""transform(orders, o -> named_struct(
            'agent', named_struct('id', concat('a', o.key),
                                  'label', if(o.status = 'P', null, concat('Agent ', o.key)), 'type', 'Agent'),
            'primary', o.status = 'F',
            'roles', filter(array(named_struct('label', o.status)), r -> o.status <> 'O')))""").alias("contributors"),
        F.expr("""flatten(transform(filter(orders, o -> o.items is not null), o -> transform(o.items, i -> named_struct(
            'label', concat('part ', i.part),
            'concepts', array(named_struct('id', concat('s', i.supp), 'label', concat('supplier ', i.supp), 'type', 'Agent'))))))
            """).alias("subjects"),
        F.expr("""transform(orders, o -> named_struct('label', o.status, 'concepts',
            array(named_struct('id', concat('g', o.status), 'label', o.status, 'type', 'Genre'))))""").alias("genres"),
        F.expr("cast(array() as array<struct<id:string,label:string>>)").alias("languages"),
        F.expr(f"""transform(orders, o -> named_struct('label', {year},
            'dates', array(named_struct('label', {year}))))""").alias("production"),
        F.expr("""transform(orders, o -> named_struct('contents', transform(o.items, i -> concat('part ', i.part)),
            'noteType', named_struct('label', o.priority)))""").alias("notes"),
        F.struct(F.lower("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("label")).alias("workType"),
        F.when(F.col("c_nationkey") < 12, F.expr(
            "array(named_struct('id','online','label','Online'), named_struct('id','shelf','label','Open shelves'))")
        ).alias("availabilities"))


def geography(spark: SparkSession, sf: str) -> DataFrame:
    """region -> nations -> suppliers, three levels."""
    suppliers = nest_children(table(spark, sf, "supplier"), ["s_nationkey"], ["s_suppkey", "s_name", "s_acctbal"],
                              ["s_suppkey"], out="suppliers").drop("part_no")
    nations = table(spark, sf, "nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").drop("s_nationkey")
    nested = nest_children(nations, ["n_regionkey"], ["n_nationkey", "n_name", "suppliers"], ["n_nationkey"],
                           out="nations").drop("part_no")
    return table(spark, sf, "region").join(nested, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(
        "r_regionkey", "r_name", "nations")


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """``conv_id, turns[turn, role, text]``."""
    return nest_children(table(spark, sf, "conversations"), ["conv_id"], ["turn", "role", "text"], ["turn", "role"],
                         out="turns").drop("part_no")


def labels_combined(spark: SparkSession, sf: str) -> DataFrame:
    """``label, id, type, source`` over customers, suppliers and parts; parts of brand 1 have no id."""
    from quire.operators.linkage import combine_labels
    return combine_labels(
        ("customer", table(spark, sf, "customer").select(F.col("c_name").alias("label"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("Person").alias("type"))),
        ("supplier", table(spark, sf, "supplier").select(F.col("s_name").alias("label"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("Agent").alias("type"))),
        ("part", table(spark, sf, "part").select(F.col("p_name").alias("label"), F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).alias("id"), F.lit("Subject").alias("type"))))


LABELS_SQL = """labels_combined AS (
  SELECT c_name AS label, 'c' || c_custkey AS id, 'Person' AS type, 'customer' AS source FROM customer
  UNION ALL SELECT s_name, 's' || s_suppkey, 'Agent', 'supplier' FROM supplier
  UNION ALL SELECT p_name, CASE WHEN p_brand <> 'Brand#1' THEN p_brand END, 'Subject', 'part' FROM part)"""


def person_names(spark: SparkSession, sf: str) -> DataFrame:
    """``id, name``: customers with life dates from their orders, in the forms catalogues use."""
    years = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1"))
    title = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.expr(f"substring({c}, 2)")))
    surname = F.concat(title("c_mktsegment"), F.col("c_nationkey").cast("string"))
    forename = F.when(F.col("c_acctbal") < 0, F.substring("r_name", 1, 1)).otherwise(title("r_name"))
    dates = (F.when(F.col("c_acctbal") > 6000, F.concat(F.lit(", "), "y0", F.lit("-"), "y1", F.lit(".")))
             .when(F.col("c_acctbal") > 3000, F.concat(F.lit(", b. "), "y0"))
             .when(F.col("c_acctbal") > 1000, F.concat(F.lit(", "), "y0", F.lit("-"))).otherwise(F.lit("")))
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (table(spark, sf, "customer").join(years, F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.col("c_custkey").alias("id"), F.concat(surname, F.lit(", "), forename, F.coalesce(dates, F.lit(""))).alias("name")))


PERSON_NAMES_SQL = """person_names AS (
  SELECT c_custkey AS id,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || c_nationkey || ', '
    || CASE WHEN c_acctbal < 0 THEN r_name[1] ELSE upper(r_name[1]) || lower(r_name[2:]) END
    || coalesce(CASE WHEN c_acctbal > 6000 THEN ', ' || y0 || '-' || y1 || '.'
            WHEN c_acctbal > 3000 THEN ', b. ' || y0
            WHEN c_acctbal > 1000 THEN ', ' || y0 || '-' ELSE '' END, '') AS name
  FROM customer
  LEFT JOIN (SELECT o_custkey, min(year(o_orderdate)) AS y0, max(year(o_orderdate)) AS y1 FROM orders GROUP BY 1)
    ON c_custkey = o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
