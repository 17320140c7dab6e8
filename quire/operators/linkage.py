"""Record linkage: labels, blocks, pairs, scores, clusters, review ledgers, duplicates."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.constants import SINGLE_YEAR_PATTERN
from quire.functions import text as X
from quire.operators.aggregates import exact_quantiles
from quire.operators.components import cluster_pairs, cluster_refine, connected_components
from quire.operators.joins import double_lookup, right_outer_ifnull
from quire.operators.nested import nest_children
from quire.operators.setops import first_per_key, union_all
from quire.operators.similarity import _meet, block_pairs, prefix_length, rare_first
from quire.operators.windows import global_index
from quire.runtime import durable

__all__ = ["cluster_pairs", "cluster_refine", "block_pairs"]


def combine_labels(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Label sources (``label, id, type``) appended, each tagged with its ``source``."""
    return union_all(*sources)


def dedupe_input(df: DataFrame) -> DataFrame:
    """(idx, label, id, type): distinct records numbered in (id, label, type) order.

    A null id becomes ``null`` and a five-digit number in that order, a null type ``missing``.
    """
    order = [F.col("id").asc_nulls_last(), F.col("label").asc_nulls_last(), F.col("type").asc_nulls_last()]
    indexed = global_index(df.select("label", "id", "type").distinct(), order, "idx")
    # nulls sort last, so their running number is the index minus the count of rows with an id
    n_known = indexed.agg(F.count("id")).first()[0]
    return indexed.select("idx", "label", F.coalesce("id", F.format_string("null%05d", F.col("idx") - F.lit(n_known))).alias("id"),
                          F.coalesce("type", F.lit("missing")).alias("type"))


def _tokens(label) -> Column:
    return X.tokens(label, 1)


BLOCK_KINDS = ("first_token", "sorted_tokens", "prefix5", "surname_year", "rare_grams")


def _kind_keys(kind: str, label: str) -> Column:
    """Array of keys of one kind; empty when the kind does not apply."""
    toks = _tokens(label)
    none = F.array().cast("array<string>")
    if kind == "first_token":
        return F.when(F.size(toks) > 0, F.array(toks[0])).otherwise(none)
    if kind == "sorted_tokens":
        return F.when(F.size(toks) > 0, F.array(F.array_join(F.sort_array(toks), " "))).otherwise(none)
    if kind == "prefix5":
        return F.array(F.substring(F.lower(label), 1, 5))
    if kind == "surname_year":
        year = F.regexp_extract(label, SINGLE_YEAR_PATTERN, 1)
        surname = F.lower(F.trim(F.regexp_extract(label, r"^([^,]*),", 1)))
        return F.when((year != "") & (surname != ""), F.array(F.concat(surname, F.lit("|"), year))).otherwise(none)
    if kind == "one_deletion":
        return X.one_deletions(F.lower(label))
    raise ValueError(f"unknown block kind {kind}")


def _tagged(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda x: F.concat(F.lit(kind + ":"), x))


def block_keys(df: DataFrame, id: str, label: str, kinds: tuple[str, ...] = BLOCK_KINDS) -> DataFrame:
    """(block_key, id): the keys of each record, prefixed by their kind.

    ``rare_grams`` are the 3-grams of the record's rarest word, by word frequency over all records.
    ``one_deletion`` keys make blocks of labels one edit apart.
    """
    plain = [k for k in kinds if k != "rare_grams"]
    tagged = [_tagged(_kind_keys(k, label), k) for k in plain]
    keyed = df.select(id, F.explode(F.array_distinct(F.concat(*tagged))).alias("block_key")) if plain else None
    if "rare_grams" not in kinds:
        return keyed.select("block_key", id)
    long = df.select(id, F.explode(F.array_distinct(_tokens(label))).alias("w"))
    freq = long.groupBy("w").agg(F.count("*").alias("f"))
    rarest = long.join(freq, "w").groupBy(id).agg(F.min_by("w", F.struct("f", "w")).alias("w"))
    grams = rarest.select(id, F.explode(_tagged(X.char_grams("w", 3), "rare_grams")).alias("block_key"))
    return (grams if keyed is None else keyed.unionByName(grams)).select("block_key", id)


def block_size_report(blocks: DataFrame) -> DataFrame:
    """(block_key, size, cost): rows per block and size squared, the price of comparing it fully."""
    return blocks.groupBy("block_key").agg(F.count("*").alias("size")).withColumn("cost", F.col("size") * F.col("size"))


def block_size_cap(blocks: DataFrame, q: float = 0.998) -> DataFrame:
    """Blocks not larger than the ``q`` quantile of the block sizes."""
    sizes = durable(block_size_report(blocks).select("block_key", "size"), "sizes")
    bound = exact_quantiles(sizes, ["size"], [q]).first()
    if bound is None:
        return blocks
    return blocks.join(sizes.where(F.col("size") <= bound["value"]).select("block_key"), "block_key", "left_semi")


def candidate_pairs(blocks: DataFrame, records: DataFrame, threshold: float = 0.6, id: str = "idx", label: str = "label",
                    carry: tuple[str, ...] = (), every: bool = False) -> DataFrame:
    """(id_l, id_r, similarity): records that share a block and whose label 3-grams reach ``threshold``.

    Columns of ``records`` named in ``carry`` come along for both sides; with ``every``, each copy is paired as any record is. See ``block_pairs``: exact for this definition, whatever the block sizes, without enumerating a block.
    """
    keys = blocks.groupBy(id).agg(F.collect_set("block_key").alias("keys"))   # a record has few keys
    sets = records.select(id, X.char_grams(F.lower(label), 3).alias("tokens"), *carry).join(keys, id)
    return block_pairs(sets.withColumnRenamed(id, "id"), threshold, carry=carry, every=every)


def label_parts(df: DataFrame, label: str = "label") -> DataFrame:
    """Adds what ``pair_features`` compares besides the label itself: its distinct ``words`` and ``years``."""
    return df.withColumn("words", F.array_distinct(_tokens(label))).withColumn("years", F.array_distinct(F.regexp_extract_all(F.col(label), F.lit(SINGLE_YEAR_PATTERN), F.lit(1))))


def pair_features(pairs: DataFrame, left: str = "label_l", right: str = "label_r") -> DataFrame:
    """Adds edit similarity, token Jaccard, same type and shared year of the two labels.

    Pairs that carry the ``label_parts`` of both records, of which there are far fewer than pairs, give them up here; others are cut here.
    """
    a, b = F.lower(left), F.lower(right)
    longest = F.greatest(F.length(a), F.length(b))
    if "words_l" not in pairs.columns:
        pairs = label_parts(label_parts(pairs, left).withColumnsRenamed({"words": "words_l", "years": "years_l"}), right).withColumnsRenamed({"words": "words_r", "years": "years_r"})
    both = F.size(F.array_intersect("words_l", "words_r"))
    return (pairs.withColumn("edit_sim", F.coalesce(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest), F.lit(1.0)))
            .withColumn("token_jaccard", F.coalesce(F.try_divide(both.cast("double"), F.size("words_l") + F.size("words_r") - both), F.lit(0.0)))
            .withColumn("same_type", F.coalesce((F.col("type_l") == F.col("type_r")).cast("double"), F.lit(0.0)))
            .withColumn("shared_year", F.arrays_overlap("years_l", "years_r").cast("double")).drop("words_l", "words_r", "years_l", "years_r"))


FEATURES = ["edit_sim", "token_jaccard", "same_type", "shared_year"]


def _lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.LongType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    ratios = {}  # of a batch, in which copies make many equal pairs
    for x, y in zip(a, b):
        if (x, y) not in ratios:
            ratios[x, y] = round(200 * _lcs_length(x, y) / (len(x) + len(y))) if x or y else 100
    return pd.Series([ratios[p] for p in zip(a, b)], dtype="int64")


def fuzz_ratio(a, b, exact: bool = False) -> Column:
    """0..100 similarity: from edit distance on the JVM, or the exact insert/delete ratio in Arrow batches."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    if exact:
        return _indel_ratio(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    longest = F.greatest(F.length(a), F.length(b))
    return F.round(100 * (1 - F.coalesce(F.try_divide(F.levenshtein(a, b).cast("double"), longest), F.lit(0.0)))).cast("long")


def fit_pair_model(features: DataFrame, label: str) -> PipelineModel:
    """Logistic regression on the pair features; ``label`` is 1 for a match, 0 for distinct."""
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="_f"),
                            LogisticRegression(featuresCol="_f", labelCol=label, probabilityCol="_p", rawPredictionCol="_r",
                                               predictionCol="_y", regParam=0.01, maxIter=50)]).fit(features)


def pair_scores(features: DataFrame, model: PipelineModel | None = None) -> DataFrame:
    """Adds ``score`` in 0..1: the model's match probability, or fixed weights without a model."""
    if model is not None:
        return model.transform(features).withColumn("score", vector_to_array("_p")[1]).drop("_f", "_p", "_r", "_y")
    return features.withColumn("score", 0.5 * F.col("edit_sim") + 0.3 * F.col("token_jaccard")
                               + 0.15 * F.col("same_type") + 0.05 * F.col("shared_year"))


def canonical_join(clusters: DataFrame, records: DataFrame, id: str = "idx") -> DataFrame:
    """(id, canon_id, label_l, type_l, label_r, type_r): clustered records beside their canonical one, where label or type differ."""
    named = double_lookup(clusters.select("id", "canon_id"), records.select(id, "label", "type"), "id", "canon_id", id)
    return named.where(~F.col("label_l").eqNullSafe(F.col("label_r")) | ~F.col("type_l").eqNullSafe(F.col("type_r")))


def canonical_rollup(facts: DataFrame, clusters: DataFrame, key: str, measure: str, k: int = 10) -> DataFrame:
    """(canon_id, total, n): measure totals by canonical entity, the k largest; unclustered keys stand for themselves."""
    totals = facts.groupBy(key).agg(F.sum(measure).alias("_t"), F.count("*").alias("_n"))
    mapped = right_outer_ifnull(clusters.select(F.col("id").alias(key), "canon_id"), totals, key, "canon_id", key, "canon")
    merged = mapped.groupBy(F.col("canon").alias("canon_id")).agg(F.sum("_t").alias("total"), F.sum("_n").alias("n"))
    return merged.orderBy(F.desc("total"), "canon_id").limit(k)


def uncertain_pairs(scored: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """The k unlabelled pairs whose score is closest to one half."""
    todo = scored.join(labelled.select("id_l", "id_r"), ["id_l", "id_r"], "left_anti")
    return todo.orderBy(F.abs(F.round(F.col("score"), 9) - 0.5), "id_l", "id_r").limit(k)


def label_ledger(labels: DataFrame) -> DataFrame:
    """(id_l, id_r, pair_label) in force, from an append-only log (id_l, id_r, label, at).

    The latest entry of a pair counts; ``remove`` takes it out, ``unsure`` counts as match and as distinct.
    """
    last = first_per_key(labels, ["id_l", "id_r"], [F.desc("at"), "label"])
    both = F.when(F.col("label") == "unsure", F.array(F.lit("match"), F.lit("distinct"))).otherwise(F.array("label"))
    return last.where("label <> 'remove'").select("id_l", "id_r", F.explode(both).alias("pair_label"))


def eval_ledger(evals: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per type: pairs, evaluated, yes / no / unsure, precision of the decided, remaining.

    ``pairs`` has ``id, type``; ``evals`` has ``id, evaluation, at``; the latest evaluation counts.
    """
    last = first_per_key(evals, ["id"], [F.desc("at"), "evaluation"]).select("id", "evaluation")
    e = F.col("evaluation")
    out = pairs.join(last, "id", "left").groupBy("type").agg(
        F.count("*").alias("n_pairs"), F.count(e).alias("n_evaluated"), F.count_if(e == "yes").alias("n_yes"),
        F.count_if(e == "no").alias("n_no"), F.count_if(e == "unsure").alias("n_unsure"))
    return (out.withColumn("precision", F.try_divide(F.col("n_yes").cast("double"), F.col("n_yes") + F.col("n_no")))
            .withColumn("remaining", F.col("n_pairs") - F.col("n_evaluated")))


def name_candidates(hits: DataFrame, floor: float = 0.8, ratio: float = 0.7) -> DataFrame:
    """Adds ``cutoff`` = max(best score, floor) * ratio per query and ``in_context`` (score at or above it).

    ``hits`` holds k rows per query, so the window is over a bounded group.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    out = hits.withColumn("cutoff", F.greatest(best, F.lit(floor)) * F.lit(ratio))
    return out.withColumn("in_context", F.col("score") >= F.col("cutoff"))


def _name_parts(df: DataFrame, col: str, side: str) -> DataFrame:
    years = F.regexp_extract_all(F.col(col), F.lit(SINGLE_YEAR_PATTERN), F.lit(1))
    bare = F.regexp_replace(F.col(col), r"\([^)]*\)|\b[bd]\.\s*\d{4}|\d{4}\s*-?\s*(\d{4})?|[.]", " ")
    surname = F.lower(F.trim(F.regexp_extract(bare, r"^([^,]*)", 1)))
    fore = F.filter(F.split(F.lower(F.regexp_extract(bare, r"^[^,]*,([^,]*)", 1)), r"\s+"), lambda x: x != "")
    return df.withColumn(f"surname{side}", surname).withColumn(f"fore{side}", fore).withColumn(f"years{side}", years)


def reconcile_rules(pairs: DataFrame, target: str = "target", candidate: str = "candidate") -> DataFrame:
    """Adds ``degree`` (high, medium, low, none) and ``reconciled`` (medium or better).

    Same surname and full forenames: high with a shared year, medium when a side has no year, none
    when the years disagree. Forenames that only agree by initials: medium with a shared year,
    else low. A target without forenames is too ambiguous.
    """
    p = _name_parts(_name_parts(pairs, target, "_t"), candidate, "_c")
    same_surname = (F.col("surname_t") == F.col("surname_c")) & (F.col("surname_t") != "")
    shared = F.arrays_overlap("years_t", "years_c")
    undated = (F.size("years_t") == 0) | (F.size("years_c") == 0)
    full = F.col("fore_t") == F.col("fore_c")
    short = F.exists("fore_t", lambda x: F.length(x) == 1) | F.exists("fore_c", lambda x: F.length(x) == 1)
    initials = F.transform("fore_t", lambda x: F.substring(x, 1, 1)) == F.transform("fore_c", lambda x: F.substring(x, 1, 1))
    degree = (F.when(~same_surname | (F.size("fore_t") == 0) | (F.size("fore_c") == 0), "none")
              .when(full & ~short, F.when(shared, "high").when(undated, "medium").otherwise("none"))
              .when(initials & short, F.when(shared, "medium").otherwise("low")).otherwise("none"))
    out = p.withColumn("degree", degree)
    return out.select(*pairs.columns, "degree", F.col("degree").isin("high", "medium").alias("reconciled"))


def reconcile_names(names: DataFrame, id: str, name: str) -> DataFrame:
    """(id, target, candidate_id, candidate, degree, reconciled): the best of all other names for each, by ``reconcile_rules``.

    High comes before medium before low, then the smaller id; a name for which no other has a degree has null candidates and ``none``.
    A degree depends on surname, forenames or initials, and years alone, so each rule is a key: the two smallest ids of every
    key are found (two, as one may be the name itself), every name looks up its own keys, and no two names meet as a pair.
    """
    p = _name_parts(names.where(F.col(id).isNotNull() & F.col(name).isNotNull()).select(F.col(id).alias("id"), F.col(name).alias("name")), "name", "")
    p = p.where((F.col("surname") != "") & (F.size("fore") > 0)).select(
        "id", "surname", "fore", F.transform("fore", lambda x: F.substring(x, 1, 1)).alias("initials"), F.array_distinct("years").alias("years"),
        F.exists("fore", lambda x: F.length(x) == 1).alias("short"))
    p = durable(p, "name-parts")
    dated = p.withColumn("year", F.explode("years"))

    def look_up(asking: DataFrame, offered: DataFrame, keys: list[str], order: int) -> DataFrame:
        first = Window.partitionBy(*keys).orderBy("other")
        least = offered.select(*keys, F.col("id").alias("other")).distinct().withColumn("_n", F.row_number().over(first)).where("_n <= 2").drop("_n")
        return asking.select("id", *keys).join(least, keys).where("id <> other").select("id", F.struct(F.lit(order).alias("order"), "other").alias("best"))

    full, full_year, brief, brief_year = ["surname", "fore"], ["surname", "fore", "year"], ["surname", "initials"], ["surname", "initials", "year"]
    undated = F.size("years") == 0
    found = [look_up(dated.where("not short"), dated.where("not short"), full_year, 0),
             look_up(p.where(~F.col("short") & undated), p.where("not short"), full, 1),
             look_up(p.where(~F.col("short") & ~undated), p.where(~F.col("short") & undated), full, 1),
             look_up(dated.where("short"), dated, brief_year, 1), look_up(dated.where("not short"), dated.where("short"), brief_year, 1),
             look_up(p.where("short"), p, brief, 2), look_up(p.where("not short"), p.where("short"), brief, 2)]
    best = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("best").alias("best"))
    order = F.col("b.best.order")
    degree = F.when(order == 0, "high").when(order == 1, "medium").when(order == 2, "low").otherwise("none")
    out = names.select(F.col(id).alias("id"), F.col(name).alias("target")).alias("n").join(best.alias("b"), F.col("n.id") == F.col("b.id"), "left")
    out = out.select("n.id", "n.target", F.col("b.best.other").alias("candidate_id"), degree.alias("degree"))
    known = names.select(F.col(id).alias("candidate_id"), F.col(name).alias("candidate"))
    return out.join(known, "candidate_id", "left").select("id", "target", "candidate_id", "candidate", "degree", F.col("degree").isin("high", "medium").alias("reconciled"))


def reconcile_record(hits: DataFrame) -> DataFrame:
    """One record per target: ``query_id, label, reconciled_labels[], candidates[]``.

    ``hits`` has ``query_id, label, idx, candidate, score, reconciled``, k rows per target.
    """
    out = nest_children(hits, ["query_id", "label"], ["rank", "idx", "candidate", "score", "reconciled"], ["rank"], out="candidates")
    kept = F.transform(F.filter("candidates", lambda c: c["reconciled"]), lambda c: c["candidate"])
    return out.select("query_id", "label", kept.alias("reconciled_labels"), "candidates")


def exact_dup_docs(df: DataFrame, id: str, text: str) -> DataFrame:
    """(text_hash, canon_id, n) of every text that occurs more than once; no list of members is built."""
    return (df.groupBy(F.sha2(text, 256).alias("text_hash")).agg(F.min(id).alias("canon_id"), F.count("*").alias("n"))
            .where(F.col("n") > 1))


def near_dup_links(df: DataFrame, id: str, text: str, shingle: int = 5, threshold: float = 0.8,
                   words: Callable[[str], Column] = lambda c: X.tokens(c, 1)) -> DataFrame:
    """(id_l, id_r): links between texts whose sets of ``shingle``-word runs have Jaccard >= ``threshold``.

    The links connect exactly the texts that all qualifying pairs would connect, but a large group
    of copies is a star instead of all its pairs:

    1. Texts with the same set of runs are tied to their smallest id, which goes on for them.
    2. Of the texts left that share the same core (the runs some other text has too), the one with
       the fewest runs of its own is at least as similar to any text as each of the others is. Those
       that qualify with it are tied to it and need no further comparison.
    3. The rest meet on their rare runs (prefix principle), over whole texts and without a cap.
    """
    # tokens are used several times: computed once
    df = df.select(F.col(id).alias("id"), F.explode(F.array(words(text))).alias("_w"))
    w = F.col("_w")
    runs = F.when(F.size(w) >= shingle, X.ngram_array(w, shingle)).otherwise(F.array(F.array_join(w, " ")))
    hashed = F.sort_array(F.array_distinct(F.transform(runs, lambda x: F.xxhash64(x))))
    digest = lambda c: F.sha2(F.array_join(F.col(c).cast("array<string>"), ","), 256)
    sets = durable(df.where(F.size(w) > 0).select("id", hashed.alias("s")).withColumn("h", digest("s")), "shingles")
    firsts = durable(sets.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    copies = sets.join(firsts.where("n > 1"), "h").where("id > rep").select(F.col("rep").alias("id_l"), F.col("id").alias("id_r"))

    units = sets.join(firsts.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "s")
    eps = F.lit(1e-9)
    whole = units.groupBy("id").agg(F.sum(F.size("s")).cast("int").alias("n"))
    # ``ordered`` is the text's core; what it lacks are the text's own runs, the rarest of all
    ranked = rare_first(units, "id", "s").join(whole, "id").withColumn("own", F.col("n") - F.size("ordered"))
    # a text's own runs take up places of the prefix but can meet nobody
    rare = F.slice("ordered", F.lit(1), F.greatest(prefix_length(F.col("n"), threshold) - F.col("own"), F.lit(0)))
    ranked = ranked.withColumn("core", F.sort_array("ordered")).select("id", "n", "own", digest("core").alias("h"), rare.alias("rare"))
    ranked = durable(ranked, "ranked")
    leads = ranked.groupBy("h").agg(F.min_by("id", F.struct("own", "id")).alias("lead"), F.min("own").alias("lead_own"))
    close = (F.col("n") - F.col("own")) / (F.col("n") + F.col("lead_own"))
    judged = ranked.join(leads, "h").withColumn("tied", (F.col("id") != F.col("lead")) & (close >= F.lit(threshold) - eps))
    judged = durable(judged.select("id", "n", "own", "rare", "lead", "tied"), "judged")
    same_core = judged.where("tied").select(F.col("lead").alias("id_l"), F.col("id").alias("id_r"))

    posts = judged.where("NOT tied").select("id", "n", "own", F.posexplode("rare").alias("at", "t"))
    posts = durable(posts.select("id", "n", "t", (F.col("own") + F.col("at")).alias("pos")), "postings")
    met = _meet(posts, ["t"], threshold).distinct()
    both = (met.join(units.select(F.col("id").alias("id_l"), F.col("s").alias("s_l")), "id_l")
            .join(units.select(F.col("id").alias("id_r"), F.col("s").alias("s_r")), "id_r"))
    near = both.where(X.jaccard("s_l", "s_r") >= F.lit(threshold) - eps).select("id_l", "id_r")
    return near.unionByName(same_core).unionByName(copies)


def near_dup_docs(df: DataFrame, id: str, text: str, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, canon_id): clusters of near copies."""
    return connected_components(near_dup_links(df, id, text, shingle, threshold), "id_l", "id_r")
