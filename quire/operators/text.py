"""Text statistics, terms, spelling, sentiment, entities and topics as joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import constants as K
from quire.functions import scalars as S
from quire.functions import text as X
from quire.operators.setops import first_per_key
from quire.operators.word2vec import fit_mean_vectors
from quire.runtime import durable


def text_stats(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(
        id, S.char_length(text).cast("long").alias("n_chars"), S.word_count_tokens(text).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, r"\s", "")).cast("long").alias("n_nonspace"),
        S.sentence_count_punct(text).cast("long").alias("n_sentences"))


def total_word_count(df: DataFrame, text: str) -> DataFrame:
    """Non-empty words of the whole corpus; counted in the row, so only one number per task is shuffled."""
    return df.agg(F.coalesce(F.sum(S.word_count_tokens(text).cast("long")), F.lit(0)).alias("n_words"))


def regex_tokenize(df: DataFrame, text: str, min_len: int = 2, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, X.tokens(text, min_len))


def stopword_remove(df: DataFrame, tokens: str, words: list[str] | None = None) -> DataFrame:
    return df.withColumn(tokens, X.drop_stopwords(tokens, words))


def clean_tokens(df: DataFrame, tokens: str) -> DataFrame:
    return df.withColumn(tokens, X.keep_clean(tokens))


def term_counts(df: DataFrame, tokens: str, k: int | None = 50) -> DataFrame:
    """(term, n), the k most frequent; counts are combined before the shuffle."""
    # one row per text first: exploding an expression would repeat it in the filters Spark infers
    rows = df.select(F.explode(F.array(tokens)).alias("_t"))
    counts = rows.select(F.explode("_t").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counts if k is None else counts.orderBy(F.desc("n"), "term").limit(k)


def ngrams(df: DataFrame, tokens: str, n: int, k: int | None = 40) -> DataFrame:
    return term_counts(df.select(X.ngram_array(tokens, n).alias("grams")), "grams", k)


def term_frequencies(df: DataFrame, tokens: str, min_df: int = 1) -> DataFrame:
    """(term, n, df): all terms in at least ``min_df`` rows, with their occurrences and rows."""
    df = df.select(F.explode(F.array(tokens)).alias(tokens))  # tokens are used twice: computed once
    marks = F.concat(F.transform(tokens, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
                     F.transform(F.array_distinct(tokens), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))))
    return (df.select(F.explode(marks).alias("m")).groupBy("m.term")
            .agg(F.sum("m.tf").alias("n"), F.sum("m.df").alias("df")).where(F.col("df") >= min_df))


def vocab_min_df(df: DataFrame, tokens: str, min_df: int = 5, size: int = 10_000) -> DataFrame:
    """(term, n, df, term_ix): terms in at least ``min_df`` rows, the ``size`` most frequent, numbered from 0."""
    top = term_frequencies(df, tokens, min_df).orderBy(F.desc("n"), "term").limit(size)
    # numbering runs over the vocabulary only, at most ``size`` rows
    return top.withColumn("term_ix", (F.row_number().over(Window.orderBy(F.desc("n"), "term")) - 1).cast("long"))


def doc_term_matrix(df: DataFrame, id: str, tokens: str, vocab: DataFrame) -> DataFrame:
    """(id, term_ix, term, n): counts of vocabulary terms per record."""
    found = df.select(id, F.explode(tokens).alias("term")).join(vocab.select("term", "term_ix"), "term")
    return found.groupBy(id, "term_ix", "term").agg(F.count("*").alias("n"))


def field_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``jaccard`` and ``unique_share`` (words of b that are not in a, as a share of b); null for a blank field."""
    names = df.columns
    for c, w in ((a, "_wa"), (b, "_wb")):
        df = df.select("*", F.explode(F.array(F.array_distinct(X.words(F.lower(F.col(c)))))).alias(w))
    wa, wb = F.col("_wa"), F.col("_wb")
    usable = (F.trim(F.coalesce(a, F.lit(""))) != "") & (F.trim(F.coalesce(b, F.lit(""))) != "")
    return (df.withColumn("jaccard", F.when(usable, X.jaccard(wa, wb)))
            .withColumn("unique_share", F.when(usable, F.try_divide(F.size(F.array_except(wb, wa)).cast("double"), F.size(wb))))
            .select(*names, "jaccard", "unique_share"))


def sentence_split(df: DataFrame, id: str, text: str) -> DataFrame:
    return df.select(id, F.posexplode(X.sentences(text)).alias("sentence_idx", "sentence"))


def readability(df: DataFrame, text: str, easy_words: list[str] | None = None) -> DataFrame:
    """Adds six published readability measures; null for a text without words."""
    w = X.words(text)
    out = (df.withColumn("_w", w)
           .withColumn("_n", F.size("_w").cast("double"))
           .withColumn("_s", F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: F.trim(s) != ""))).cast("double"))
           .withColumn("_syl", F.transform("_w", X.syllables))
           .withColumn("_y", F.aggregate("_syl", F.lit(0), lambda a, x: a + x).cast("double"))
           .withColumn("_poly", F.size(F.filter("_syl", lambda x: x >= 3)).cast("double"))
           .withColumn("_c", F.length(F.array_join("_w", "")).cast("double"))
           .withColumn("_hard", F.size(F.filter("_w", lambda x: ~F.regexp_replace(F.lower(x), "[^a-z]", "").isin(
               easy_words if easy_words is not None else K.EASY_WORDS))).cast("double")))
    n, s, y, c = (F.col(x) for x in ("_n", "_s", "_y", "_c"))
    hard_pct = F.try_divide(F.col("_hard") * 100, n)
    wps, spw = n / s, F.try_divide(y, n)
    measures = {
        "flesch_ease": 206.835 - 1.015 * wps - 84.6 * spw,
        "flesch_kincaid": 0.39 * wps + 11.8 * spw - 15.59,
        "smog": 1.0430 * F.sqrt(F.col("_poly") * 30 / s) + 3.1291,
        "coleman_liau": 0.0588 * F.try_divide(c * 100, n) - 0.296 * F.try_divide(s * 100, n) - 15.8,
        "ari": 4.71 * F.try_divide(c, n) + 0.5 * wps - 21.43,
        "dale_chall": 0.1579 * hard_pct + 0.0496 * wps + F.when(hard_pct > 5, 3.6365).otherwise(0.0)}
    out = out.select(*df.columns, *[F.when(n > 0, m).alias(name) for name, m in measures.items()])
    return out


def temporal_refs(df: DataFrame, text: str, k: int | None = None) -> DataFrame:
    """(kind, ref, n) for years, centuries and decades in the text; the k most common of each kind."""
    kinds = {"year": K.YEAR_PATTERN, "century": K.CENTURY_PATTERN, "decade": K.DECADE_PATTERN}

    def refs(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        return F.transform(hits, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("ref")))

    found = F.concat(*[refs(kind, pattern) for kind, pattern in kinds.items()])
    counts = df.select(F.explode(found).alias("r")).groupBy("r.kind", "r.ref").agg(F.count("*").alias("n"))
    return counts if k is None else first_per_key(counts, ["kind"], [F.desc("n"), "ref"], k)


def life_dates(df: DataFrame, name: str, out: str = "dates") -> DataFrame:
    """Adds the distinct years of a name: spans, born / died marks, single years, in that order."""
    c = F.col(name)
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(g)) for p, g in (
        (K.SPAN_PATTERN, 1), (K.SPAN_PATTERN, 2), (K.BORN_DIED_PATTERN, 1), (K.SINGLE_YEAR_PATTERN, 1))]
    return df.withColumn(out, F.array_distinct(F.concat(*found)))


def _letters(text: str) -> Column:
    return X.words(F.regexp_replace(F.lower(F.col(text)), r"[^a-z\s]", ""))


def spell_ratio(df: DataFrame, id: str, text: str, dictionary: DataFrame, k: int = 10) -> DataFrame:
    """(id, ratio, top_misspelled): share of words outside the dictionary (column ``word``), and the k most frequent of them.

    Texts are dealt by record and words counted there; where the written dictionary is small enough for Spark to
    broadcast, nothing else is shuffled. A record without words has ratio 0.
    """
    dealt = df.select(id, text).repartition(F.col(id))
    counts = dealt.select(id, F.explode_outer(_letters(text)).alias("word")).groupBy(id, "word").agg(F.count("word").alias("n"))
    known = durable(dictionary.select("word", F.lit(True).alias("_known")).distinct(), "dictionary")
    judged = counts.join(known, "word", "left").withColumn("_bad", F.col("word").isNotNull() & F.col("_known").isNull())
    ratio = judged.groupBy(id).agg(F.coalesce(F.try_divide(
        F.sum(F.when(F.col("_bad"), F.col("n")).otherwise(0)).cast("double"), F.sum("n")), F.lit(0.0)).alias("ratio"))
    worst = first_per_key(judged.where("_bad").select(id, "word", "n"), [id], [F.desc("n"), "word"], k)
    listed = worst.groupBy(id).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "word"))), lambda x: x["word"]), ",").alias("top_misspelled"))
    return ratio.join(listed, id, "left").select(id, "ratio", F.coalesce("top_misspelled", F.lit("")).alias("top_misspelled"))


def spell_suggest(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, suggestion, n): the most frequent dictionary word (``word``, ``n``) at edit distance at most 1.

    Both sides are expanded to their one-character deletions and met by equality: words at distance
    one always share a deletion, and no word is compared with the whole dictionary.
    """
    asked = words.select("word").distinct().select("word", F.explode(X.one_deletions("word")).alias("_d"))
    known = dictionary.select(F.col("word").alias("suggestion"), "n").withColumn("_d", F.explode(X.one_deletions("suggestion")))
    near = (asked.join(known, "_d").where(F.levenshtein("word", "suggestion", 1) >= 0)
            .select("word", "suggestion", "n").distinct())
    exact_first = F.when(F.col("word") == F.col("suggestion"), 0).otherwise(1)
    return first_per_key(near, ["word"], [exact_first, F.desc("n"), "suggestion"])


def sentiment_lexicon(df: DataFrame, id: str, text: str, lexicon: DataFrame, negations: list[str] | None = None) -> DataFrame:
    """(id, polarity, subjectivity): mean over words of the lexicon (``word, polarity, subjectivity``).

    A negation right before a word turns its polarity by -0.5. NaN for a blank text, 0 without a
    lexicon word. Only lexicon hits are aggregated: the join keeps one row per hit.
    """
    toks = X.tokens(text, 1)
    pairs = F.zip_with(toks, F.concat(F.array(F.lit("")), F.slice(toks, 1, F.size(toks))),
                       lambda w, prev: F.struct(w.alias("word"), prev.alias("prev")))
    hits = (df.select(id, F.explode(pairs).alias("t")).where(F.col("t.word").isNotNull())
            .select(id, "t.word", "t.prev").join(lexicon, "word"))
    flip = F.when(F.col("prev").isin(negations if negations is not None else K.NEGATIONS), -0.5).otherwise(1.0)
    means = hits.groupBy(id).agg(F.avg(F.col("polarity") * flip).alias("polarity"), F.avg("subjectivity").alias("subjectivity"))
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    filled = lambda c: F.when(blank, F.lit(float("nan"))).otherwise(F.coalesce(c, F.lit(0.0))).alias(c)
    return df.join(means, id, "left").select(id, filled("polarity"), filled("subjectivity"))


def lda_topics(df: DataFrame, tokens: str, k: int, max_iter: int = 10, seed: int = 42, min_df: int = 5,
               vocab_size: int = 10_000, terms: int = 10) -> DataFrame:
    """(topic, rank, term, weight): the strongest terms of each topic."""
    vectors = CountVectorizer(inputCol=tokens, outputCol="_tf", vocabSize=vocab_size, minDF=float(min_df)).fit(df)
    model = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="_tf").fit(vectors.transform(df).select("_tf"))
    names = F.array(*[F.lit(v) for v in vectors.vocabulary]) if len(vectors.vocabulary) <= 500 else None
    topics = model.describeTopics(terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    topics = topics.select("topic", "rank", F.col("t.termIndices").alias("term_ix"), F.col("t.termWeights").alias("weight"))
    if names is not None:
        return topics.select("topic", "rank", names[F.col("term_ix")].alias("term"), "weight")
    vocab = df.sparkSession.createDataFrame(list(enumerate(vectors.vocabulary)), "term_ix int, term string")
    return topics.join(vocab, "term_ix").select("topic", "rank", "term", "weight")


def word2vec_doc_vectors(df: DataFrame, tokens: str, size: int = 100, min_count: int = 2, seed: int = 42,
                         partitions: int | None = None, out: str = "embedding") -> DataFrame:
    """Adds the mean word vector of each record.

    ``partitions`` is the trainer's parallelism, by default one per core; fix it for a repeatable model.
    """
    row = max(df.columns, key=len) + "_row"  # longer than any, so free
    df = df.withColumn(row, F.monotonically_increasing_id()).transform(durable, "records")
    partitions = partitions or df.sparkSession.sparkContext.defaultParallelism
    means = fit_mean_vectors(df, row, tokens, size, min_count, seed, partitions, out)
    return df.drop(out).join(means, row).drop(row)


def kmeans_segments(df: DataFrame, vec: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``cluster``, fitted on all rows."""
    data = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(data)
    return model.transform(data).drop("_v")


def html_text_title(df: DataFrame, html: str) -> DataFrame:
    """Adds ``title``, ``body_text`` and ``links`` (href values) of a page."""
    h = F.col(html)
    body = reduce(lambda c, p: F.regexp_replace(c, p, " "), [
        r"(?is)<head.*?</head>", r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>", r"\s+"], h)
    return (df.withColumn("title", F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)))
            .withColumn("body_text", F.trim(body))
            .withColumn("links", F.regexp_extract_all(h, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))))
