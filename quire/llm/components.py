"""Connected components by hooking and pointer jumping on small tables of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import discard, durable

_ROWS = 250_000  # rows of an intermediate table for each of its partitions


def components(links: DataFrame, left: str = "id_l", right: str = "id_r") -> DataFrame:
    """(id, canon_id): the smallest id of its component, for every id of a link. Ids are long integers, not null.

    Every round a node takes the smallest label next to it, tells it to the node it pointed to, and then points to
    where that one points; labels only fall, so an unchanged sum of labels is the end. Rounds grow with the logarithm
    of the longest path. A hub is one key of a partial aggregate. Rounds are written to shared storage and the one
    before is deleted; tables are written in as many partitions as their rows need.
    """
    both = links.where(F.col(left) != F.col(right)).select(F.explode(F.array(
        F.struct(F.col(left).alias("id"), F.col(right).alias("to")), F.struct(F.col(right).alias("id"), F.col(left).alias("to")))).alias("e"))
    edges = durable(both.select("e.*"), "component-edges")
    parts = 1 + edges.count() // _ROWS

    def kept(df: DataFrame) -> DataFrame:
        return durable(df.coalesce(parts), "component-labels")

    labels = kept(edges.groupBy("id").agg(F.least("id", F.min("to")).alias("label")))
    total = None
    while True:
        told = edges.join(labels, "id").select(F.col("to").alias("id"), "label", F.lit(None).cast("long").alias("was"))
        own = labels.select("id", "label", F.col("label").alias("was"))
        low = own.unionByName(told).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        hooked = low.select(F.explode(F.array(F.struct("id", "label"), F.struct(F.col("was").alias("id"), "label"))).alias("h"))
        hooked = kept(hooked.groupBy("h.id").agg(F.min("h.label").alias("label")))
        jumped = kept(hooked.alias("a").join(hooked.alias("b"), F.col("a.label") == F.col("b.id"))
                      .select("a.id", F.least("a.label", "b.label").alias("label")))
        discard(labels, hooked)
        labels, before = jumped, total
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            discard(edges)
            return labels.select("id", F.col("label").alias("canon_id"))
