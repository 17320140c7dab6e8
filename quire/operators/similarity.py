"""Exact set-similarity join: pairs above a Jaccard threshold without comparing everything in a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.windows import global_index
from quire.runtime import durable

DIRECT = 128  # records of a block that all meet each other
PAGE = 64     # copies of a record that travel as one row where every copy is paired


def prefix_length(n: Column, threshold: float) -> Column:
    """Two sets with Jaccard >= t share a member among the first n - ceil(t n) + 1 of each, in any common order."""
    return (n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def rare_first(sets: DataFrame, id: str, members: str) -> DataFrame:
    """(id, ordered): the members of each set that some other set has too, rarest first; no row for a set without any.

    Members of one set only stay behind in the count and are neither sorted nor shuffled again.
    """
    long = sets.select(id, F.explode(members).alias("_m"))
    freq = long.groupBy("_m").agg(F.count("*").alias("_f")).where("_f > 1")
    ranked = long.join(freq, "_m").groupBy(id).agg(F.sort_array(F.collect_list(F.struct(F.col("_f").alias("f"), F.col("_m").alias("m")))).alias("_a"))
    return ranked.select(id, F.transform("_a", lambda x: x["m"]).alias("ordered"))


def block_pairs(records: DataFrame, threshold: float, direct: int = DIRECT, carry: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """(id_l, id_r, similarity) for records sharing a block key with token Jaccard >= ``threshold`` > 0.

    ``records`` has ``id``, ``keys`` (array) and ``tokens`` (array). Columns named in ``carry`` come along for both sides,
    with ``_l`` and ``_r`` suffixes, so that pairs, of which there are many more than records, need no look-up. Exact copies (same keys and
    tokens) are paired with their smallest id only, and only that one meets other records, so a
    group of copies costs one row each. In a block of at most ``direct`` records all meet; in a larger one they
    meet on (key, rare token): by the prefix principle no qualifying pair is missed, and a block that holds a
    third of the table is never enumerated. Keys and tokens are numbers by then, a record carries all of its own,
    and a pair is judged where it meets and counts at its first shared key (and rarest shared token) only: no row
    that is not a result leaves the join, and results need no ``distinct``.

    With ``every``, copies are not tied to one of them: each pair of records is given, of two copies and of a copy with another
    record. Copies are still judged as one; they travel in pages of some ``PAGE``, and two pages become pairs where they met.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    sets = records.select("id", F.sort_array(F.array_distinct("keys")).alias("keys"), F.sort_array(F.array_distinct("tokens")).alias("tokens"), *carry)
    sets = sets.where((F.size("tokens") > 0) & (F.size("keys") > 0)).withColumn("h", F.sha2(F.to_json(F.struct("keys", "tokens")), 256))
    if every:
        units, copies, held = _paged(durable(sets.where("id IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "pair-sets"), carry)
        carried = ("copies",)
    else:
        units, copies = _led(durable(sets, "pair-sets"), carry)
        held, carried = None, carry

    keyed = units.select("u", F.explode("keys").alias("k"))
    blocks = keyed.groupBy("k").agg(F.count("*").alias("size")).where("size > 1")
    blocks = durable(blocks.select("k", F.monotonically_increasing_id().alias("block"), "size"), "blocks")
    placed = keyed.join(blocks, "k").groupBy("u").agg(F.collect_list(F.struct("block", "size")).alias("blocks"))
    # a token that no other record has can be shared by no pair: it counts in ``n`` and takes a place of the prefix
    long = units.select("u", F.explode("tokens").alias("m"))
    shared = long.groupBy("m").agg(F.count("*").alias("f")).where("f > 1")
    numbers = global_index(shared, [F.col("f"), F.col("m")], "t").select("m", F.col("t").cast("int").alias("t"))
    ordered = long.join(numbers, "m").groupBy("u").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    sized = units.select("u", "id", F.size("tokens").alias("n"), *carry) if held is None else units.select("u", F.col("u").alias("id"), F.size("tokens").alias("n")).join(held, "u")
    records = durable(sized.join(placed, "u").join(ordered, "u").drop("u"), "postings")

    rare = F.slice("ts", F.lit(1), F.greatest(prefix_length(F.col("n"), threshold) - (F.col("n") - F.size("ts")), F.lit(0)))
    posts = records.select("id", "n", "ts", F.transform("blocks", lambda b: b["block"]).alias("bs"), F.explode("blocks").alias("b"), *carried)
    # whether a block is the first shared one is told by those up to it
    posts = posts.select("id", "n", "ts", *carried, F.filter("bs", lambda x: x <= F.col("b.block")).alias("bs"), F.col("b.block").alias("block"), F.explode(F.when(F.col("b.size") <= direct, F.array(F.lit(-1))).otherwise(rare)).alias("t"))
    side = lambda s: posts.select("block", "t", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "ts", "bs", *carried)])
    fits = F.least("n_l", "n_r") >= F.greatest("n_l", "n_r") * F.lit(threshold) - F.lit(1e-9)
    here = F.array_min(F.array_intersect("bs_l", "bs_r")) == F.col("block")
    met = side("l").join(side("r"), ["block", "t"]).where((F.col("id_l") < F.col("id_r")) & fits & here)
    # the shared tokens are used several times: computed once
    sides = [c + side for side in ("_l", "_r") for c in carried]
    met = met.select("id_l", "id_r", "t", *sides, (F.col("n_l") + F.col("n_r")).alias("n"), F.explode(F.array(F.array_intersect("ts_l", "ts_r"))).alias("both"))
    both = F.size("both")
    pairs = (met.where((F.col("t") < 0) | (F.array_min("both") == F.col("t"))).withColumn("similarity", both.cast("double") / (F.col("n") - both))
             .where(F.col("similarity") >= F.lit(threshold) - F.lit(1e-9)).select("id_l", "id_r", "similarity", *sides))
    return (pairs if held is None else _each_copy(pairs.drop("id_l", "id_r"), carry, F.col("x.id") != F.col("y.id"))).unionByName(copies)


def _led(sets: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """One numbered record of each group of copies, that of the smallest id, and its pairs with the others."""
    of_first = [F.min_by(c, "id").alias(f"{c}_l") for c in carry]
    many = durable(sets.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *of_first).where("copies > 1").drop("copies"), "copies")
    copies = (sets.select("h", "id", *[F.col(c).alias(f"{c}_r") for c in carry]).join(many, "h").where("id > rep")
              .select(F.col("rep").alias("id_l"), F.col("id").alias("id_r"), F.lit(1.0).alias("similarity"), *[c + side for side in ("_l", "_r") for c in carry]))
    led = sets.join(many.select("h", "rep"), "h").where("id = rep").dropDuplicates(["h"])
    units = sets.join(many, "h", "left_anti").where("id IS NOT NULL").unionByName(led.select(sets.columns))
    return durable(units.select(F.monotonically_increasing_id().alias("u"), "id", "keys", "tokens", *carry), "units"), copies


def _paged(sets: DataFrame, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A numbered unit for each group of copies, all pairs within the groups, and (u, copies): the copies of a unit in pages."""
    groups = sets.groupBy("h").agg(F.min_by("keys", "row").alias("keys"), F.min_by("tokens", "row").alias("tokens"), F.count("*").alias("n"))
    units = durable(groups.withColumn("u", F.monotonically_increasing_id()), "units")
    numbered = sets.select("h", "row", F.struct("id", *carry).alias("copy")).join(units.select("h", "u", "n"), "h")
    page = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / PAGE)).alias("page")
    held = durable(numbered.groupBy("u", page).agg(F.collect_list("copy").alias("copies"), F.first("n").alias("n")), "copies")
    side = lambda s: held.where("n > 1").select("u", F.col("page").alias(f"page_{s}"), F.col("copies").alias(f"copies_{s}"))
    met = side("l").join(side("r"), "u").where("page_l <= page_r").select("page_l", "page_r", "copies_l", "copies_r", F.lit(1.0).alias("similarity"))
    once = F.when(F.col("page_l") == F.col("page_r"), F.col("x.id") < F.col("y.id")).otherwise(F.col("x.id") != F.col("y.id"))
    return units, _each_copy(met, carry, once), held.select("u", "copies")


def _each_copy(met: DataFrame, carry: tuple[str, ...], once: Column) -> DataFrame:
    """The pairs ``once`` holds for, of a copy ``x`` of one page and a copy ``y`` of the other, smaller id first."""
    pairs = met.withColumn("x", F.explode("copies_l")).withColumn("y", F.explode("copies_r")).where(once)
    pairs = pairs.withColumn("l", F.when(F.col("x.id") < F.col("y.id"), F.col("x")).otherwise(F.col("y"))).withColumn("r", F.when(F.col("x.id") < F.col("y.id"), F.col("y")).otherwise(F.col("x")))
    return pairs.select(F.col("l.id").alias("id_l"), F.col("r.id").alias("id_r"), "similarity", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in ("l", "r") for c in carry])


def _meet(posts: DataFrame, on: list[str], threshold: float) -> DataFrame:
    """(id_l, id_r) of records in the same posting whose sizes and places in it allow the threshold.

    ``posts`` has ``id``, ``n`` members and the posting's ``pos`` in the record's order. At the first member that two records share, all
    they share are at or behind it in both, so the shorter rest bounds their overlap. Both tests are part of the join.
    """
    side = lambda s: posts.select(*on, F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), (F.col("n") - F.col("pos")).alias(f"rest_{s}"))
    fits = F.least("n_l", "n_r") >= F.greatest("n_l", "n_r") * F.lit(threshold) - F.lit(1e-9)
    reach = F.least("rest_l", "rest_r") * F.lit(1 + threshold) >= (F.col("n_l") + F.col("n_r")) * F.lit(threshold) - F.lit(1e-9)
    return side("l").join(side("r"), on).where((F.col("id_l") < F.col("id_r")) & fits & reach).select("id_l", "id_r")
