"""Mixing sources to target weights by Pareto order sampling.

Expected copies of a document fall with its length class and are scaled so that each source's expected words equal
its target. Whole copies are allocated with certainty; for the fractional rest, documents are ranked by
``odds(u) / odds(p)`` (``u`` hashed from the row, ``p`` the fraction) and taken in that order up to the words still
missing, a sample of fixed size with unequal probabilities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import durable

WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 52
_DIGIT = 12  # bits of the rank that one refinement round resolves


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), limit: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target): all words shared by weight, no source above ``limit`` times its size.

    ``sizes`` has (source, source_size), one row per source. Sources by code point, null last, take the weights in
    turn. The stop-and-reshare loop has a closed form: by limit per weight, the sources that stop come first.
    A source without words has target 0.
    """
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy("_ratio", F.col("source").isNull(), "source")
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    ranked = sizes.withColumn("weight", F.element_at(weights, ((F.row_number().over(names) - 1) % len(cycle) + 1).cast("int")))
    ranked = (ranked.withColumn("_ratio", limit * F.col("source_size") / F.col("weight"))
              .withColumn("_share", (F.sum("source_size").over(everyone) - limit * F.coalesce(F.sum("source_size").over(done), F.lit(0)))
                          / F.sum("weight").over(rest)))
    # the first source whose share is within its limit, and all after it, get that share
    level = ranked.withColumn("_level", F.min(F.when(F.col("_share") <= F.col("_ratio"), F.struct("_ratio", "_share"))).over(everyone))
    open_ = F.col("_ratio") >= F.col("_level._ratio")
    return level.select("source", "source_size", "weight",
                        F.when(open_, F.least(F.col("_level._share"), F.col("_ratio")) * F.col("weight"))
                        .otherwise(limit * F.col("source_size")).cast("double").alias("target"))


def _copies(classes: DataFrame, limit: float) -> DataFrame:
    """(source, size_class, copies): copies = min(limit, a * class weight), ``a`` solved per source.

    Class weights fall with the class, so the classes at the limit are the shortest ones: a prefix again.
    """
    w = Window.partitionBy("source").orderBy("size_class")
    rest, done = w.rowsBetween(Window.currentRow, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy("source")
    solved = (classes.withColumn("_a", (F.col("target") - limit * F.coalesce(F.sum("class_size").over(done), F.lit(0)))
                                 / F.sum(F.col("class_weight") * F.col("class_size")).over(rest))
              .withColumn("_first", F.min(F.when(F.col("_a") * F.col("class_weight") <= limit, F.struct("size_class", "_a"))).over(everyone)))
    return solved.select("source", "size_class", F.when(F.col("size_class") >= F.col("_first.size_class"),
                                                        F.col("_first._a") * F.col("class_weight"))
                         .otherwise(limit).alias("copies"))


def mix_documents(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), limit: float = 3.0, tilt: float = 0.05,
                  seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source, text_key) for every row of ``docs``.

    ``size`` counts words, ``taken = copies * size``. Copies never exceed ``limit``; the words a source takes differ from
    its target by half of one document at most, and as a rule by far less: one drawn document may be changed for it. ``tilt`` is the loss of expected copies per length class (powers of
    two); 0 treats all alike. A null text has no words, and a document without words is taken in 0 copies. A null
    source is a source, ordered last. Rows with a null id, and repeated rows, count as rows; equal rows are
    interchangeable. The draw hashes (seed, id, text digest), so reruns agree. An empty table gives no rows.

    Sums per source are partial aggregates; the ranks at which each source stops are found by refining the rank
    digit by digit, so that a window only ever sees the few rows of one crossing bin.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text_key = F.md5(text.cast("binary"))
    salt = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_key)
    # 48 bits of MD5, which every SQL engine can repeat
    draw = (F.conv(F.substring(F.md5(salt.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0 ** 48)
    rows = durable(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        text_key.alias("text_key"), draw.alias("_u"), F.monotonically_increasing_id().alias("_row"))
        .withColumn("size_class", F.length(F.bin("size"))), "mix-rows")
    classes = rows.groupBy("source", "size_class").agg(F.sum("size").alias("class_size"))
    targets = durable(source_targets(classes.groupBy("source").agg(F.sum("class_size").alias("source_size")), cycle, limit), "mix-targets")
    class_weight = 1.0 / (1.0 + tilt * F.col("size_class"))
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    wanted = (classes.alias("c").join(targets.alias("t"), same("c", "t"))
              .select("c.source", "size_class", "class_size", "source_size", "target", class_weight.alias("class_weight")))
    copies = _copies(wanted.where("source_size > 0"), limit)
    whole = F.floor(F.col("copies") + 1e-12)
    # expected copies as a whole part and a fraction; what the whole parts leave of the target is drawn for
    plan = (wanted.alias("w").join(copies.alias("k"), same("w", "k") & (F.col("w.size_class") == F.col("k.size_class")), "left")
            .select("w.source", "w.size_class", "class_size", "source_size", "target", F.coalesce("copies", F.lit(0.0)).alias("copies"))
            .withColumn("whole", whole).withColumn("p", F.greatest(F.col("copies") - F.col("whole"), F.lit(0.0))))
    plan = plan.withColumn("missing", F.col("target") - F.sum(F.col("whole") * F.col("class_size")).over(Window.partitionBy("source")))
    plan = durable(plan, "mix-plan")
    # q = odds(u) / odds(p), as the whole number of 2^-52 in q / (1 + q)
    above, below = F.col("_u") * (1 - F.col("p")), (1 - F.col("_u")) * F.col("p")
    rank = F.least(F.floor(above / (above + below) * F.lit(float(_UNIT))), F.lit(_UNIT - 1)).cast("long")
    # plan has one row per source and length class, at most 64 per source
    ranked = durable(rows.alias("r").join(plan.alias("p"), same("r", "p") & (F.col("r.size_class") == F.col("p.size_class")))
                     .select("doc_id", "r.source", "size", "text_key", "_row", "_u", "source_size", "target", "missing", "whole", "p",
                             F.when((F.col("p") > 0) & (F.col("size") > 0), rank).alias("rank")), "mix-ranked")
    drawn = _stop_ranks(ranked)
    taken = (ranked.alias("r").join(drawn.alias("d"), same("r", "d"), "left")
             .select("r.*", "d.prefix", "d.digits")
             .withColumn("_bin", F.expr("shiftright(rank, cast(52 - digits as int))")))
    sure = taken.select("doc_id", "source", "size", "text_key", "source_size", "target", "whole", "_row",
                        F.when(F.col("rank").isNull() | F.col("prefix").isNull() | (F.col("_bin") > F.col("prefix")), 0)
                        .when(F.col("_bin") < F.col("prefix"), 1).alias("extra"),
                        "rank", "_u")
    # the crossing bin of each source, in exact order
    order = Window.partitionBy("source").orderBy("rank", "_u", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    edge = sure.where("extra is null").alias("e").join(drawn.alias("d"), same("e", "d")).select("e.*", "d.left")
    edge = (edge.withColumn("_sum", F.coalesce(F.sum("size").over(order), F.lit(0)))
            .withColumn("extra", (F.col("_sum") + F.col("size") / 2.0 <= F.col("left")).cast("int")))
    every = durable(sure.where("extra is not null").unionByName(edge.select(*sure.columns)), "mix-taken")
    every = _nearest(every)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0).cast("int")
    return every.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"),
                        (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "source", "text_key")


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it.

    Copies are joined back by text digest, id and source. Rows that repeat all three appear as one row repeated as often
    as all of them are taken.
    """
    mixed = mix_documents(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    copies = mixed.where("copies > 0").groupBy("doc_id", "source", "text_key").agg(F.sum("copies").cast("int").alias("copies"))
    row = F.struct(*[F.col(c) for c in docs.columns])  # so that the names of its columns meet no others
    keyed = docs.select(row.alias("doc"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_key"),
                        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source")).dropDuplicates(["text_key", "doc_id", "source"])
    same = [F.col("d.text_key") == F.col("c.text_key"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("d.source").eqNullSafe(F.col("c.source"))]
    return (keyed.alias("d").join(copies.alias("c"), same).select("d.doc", F.explode(F.sequence(F.lit(1), F.col("c.copies"))))
            .select("doc.*"))


def _nearest(every: DataFrame) -> DataFrame:
    """One drawn document more or less per source, where that brings its words nearer to the target."""
    miss = every.groupBy("source").agg((F.first("target") - F.sum((F.col("whole") + F.col("extra")) * F.col("size"))).alias("miss"))
    # by its size, the document whose change leaves least missing; a source without a better one has no row
    gap = F.abs(F.col("miss") - F.col("size") * (1 - 2 * F.col("extra")))
    change = (every.where("rank is not null").alias("e").join(miss.alias("m"), F.col("e.source").eqNullSafe(F.col("m.source")))
              .where(gap < F.abs("miss")).groupBy(F.col("m.source").alias("source"))
              .agg(F.min(F.struct(gap, "rank", "_u", "doc_id", "size", "_row")).alias("c")).select("source", F.col("c._row").alias("_changed")))
    return (every.alias("e").join(change.alias("c"), F.col("e.source").eqNullSafe(F.col("c.source")), "left")
            .select("e.*", "_changed").withColumn("extra", F.when(F.col("_row") == F.col("_changed"), 1 - F.col("extra")).otherwise(F.col("extra"))))


def _stop_ranks(ranked: DataFrame) -> DataFrame:
    """(source, prefix, digits, left): the rank bin in which each source reaches its missing words, after two digits."""
    state = ranked.where("rank is not null").groupBy("source").agg(F.first("missing").alias("left")) \
        .withColumn("prefix", F.lit(0).cast("long")).withColumn("digits", F.lit(0))
    for _ in range(2):
        bins = (ranked.where("rank is not null").alias("r").join(state.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
                .where(F.expr("shiftright(rank, cast(52 - digits as int)) = prefix"))
                .groupBy(F.col("s.source").alias("source"), "left", "digits",
                         F.expr(f"shiftright(rank, cast({52 - _DIGIT} - digits as int))").alias("bin")).agg(F.sum("size").alias("n")))
        w = Window.partitionBy("source").orderBy("bin")
        sums = bins.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # the last bin that begins at or below what is left holds the stop
        state = (sums.where((F.col("before") <= F.col("left")) | (F.col("before") == 0)).groupBy("source")
                 .agg(F.max(F.struct("bin", "before", "left", "digits")).alias("b"))
                 .select("source", (F.col("b.left") - F.col("b.before")).alias("left"), F.col("b.bin").alias("prefix"),
                         (F.col("b.digits") + _DIGIT).alias("digits")))
        state = durable(state, "mix-stops")
    return state
