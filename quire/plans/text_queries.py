"""2.10 Text analytics."""

from pyspark.sql import functions as F

from quire import constants as K
from quire.functions import text as X
from quire.operators import text as T
from quire.operators.language import fit_language_profiles, language_id as language_of
from quire.operators.entities import entity_mentions as entity_mentions_of
from quire.operators.aggregates import group_top_values, value_counts
from quire.operators.chunking import chunk_fixed as fixed, chunk_recursive as recursive
from quire.plans.fixtures import person_names, PERSON_NAMES_SQL, works
from quire.plans.nested_queries import WORKS_TEXT_SQL
from quire.plans.registry import query, table, texts


def _docs(spark, sf):
    return texts(spark, sf, "doc_id", "text", "lang", "source")


def _terms(spark, sf):
    """Documents with cleaned tokens: split, stop words out, short and numeric ones out."""
    df = T.regex_tokenize(_docs(spark, sf).select("doc_id", "lang", "text"), "text")
    return T.clean_tokens(T.stopword_remove(df, "tokens"), "tokens").drop("text")


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS)
_TOK = r"list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2)"
_CLEAN_SQL = rf"""toks AS (SELECT doc_id, lang, list_filter({_TOK}, lambda x: x NOT IN ({_STOP}) AND length(x) > 2 AND NOT regexp_matches(x, '^\d+$')) AS t FROM documents)"""
_WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')"
_LOW_WORDS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')"


@query("text_stats", rf"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, len({_WORDS}) AS n_words, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS n_nonspace,
  len(string_split_regex(text, '[.!?]+')) AS n_sentences FROM documents""")
def text_stats(spark, sf):
    return T.text_stats(_docs(spark, sf), "doc_id", "text")


@query("total_word_count", rf"SELECT CAST(sum(len({_WORDS})) AS BIGINT) AS n_words FROM documents")
def total_word_count(spark, sf):
    return T.total_word_count(_docs(spark, sf), "text")


@query("regex_tokenize", f"SELECT doc_id, len({_TOK}) AS n, md5(array_to_string({_TOK}, ' ')) AS tokens_md5 FROM documents")
def regex_tokenize(spark, sf):
    df = T.regex_tokenize(_docs(spark, sf), "text")
    return df.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("stopword_remove", f"""
WITH k AS (SELECT doc_id, list_filter({_TOK}, lambda x: x NOT IN ({_STOP})) AS t FROM documents)
SELECT doc_id, len(t) AS n, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM k""")
def stopword_remove(spark, sf):
    df = T.stopword_remove(T.regex_tokenize(_docs(spark, sf), "text"), "tokens")
    return df.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("clean_tokens", f"WITH {_CLEAN_SQL} SELECT doc_id, len(t) AS n, md5(coalesce(array_to_string(t, ' '), '')) AS tokens_md5 FROM toks")
def clean_tokens(spark, sf):
    return _terms(spark, sf).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


@query("term_counts", f"WITH {_CLEAN_SQL} SELECT term, count(*) AS n FROM (SELECT unnest(t) AS term FROM toks) GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def term_counts(spark, sf):
    return T.term_counts(_terms(spark, sf), "tokens", 50)


@query("works_term_counts", WORKS_TEXT_SQL + r""", w AS (SELECT concat_ws(' ', title, description, contributor_names, alternative_titles, subject_labels, genre_labels, production_info, note_contents, work_type, availability_labels) AS text FROM works_text)
SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 2)) AS term FROM w) GROUP BY 1 ORDER BY n DESC, term LIMIT 50""")
def works_term_counts(spark, sf):
    """Flattened records to their most frequent terms: the flagship chain."""
    from quire.operators.nested import concat_text_columns, works_text_flattened
    cols = ["title", "description", "contributor_names", "alternative_titles", "subject_labels", "genre_labels",
            "production_info", "note_contents", "work_type", "availability_labels"]
    flat = concat_text_columns(works_text_flattened(works(spark, sf)), cols, "text")
    return T.term_counts(T.regex_tokenize(flat.select("text"), "text"), "tokens", 50)


_VOCAB_SQL = f"""WITH {_CLEAN_SQL}, u AS (SELECT doc_id, unnest(t) AS term FROM toks),
v AS (SELECT term, n, df, row_number() OVER (ORDER BY n DESC, term) - 1 AS term_ix FROM (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM u GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5) QUALIFY term_ix < 10000)"""


@query("vocab_min_df", _VOCAB_SQL + " SELECT term, n, df, term_ix FROM v")
def vocab_min_df(spark, sf):
    return T.vocab_min_df(_terms(spark, sf), "tokens", 5, 10_000)


@query("doc_term_matrix", _VOCAB_SQL + " SELECT doc_id, term_ix, u.term, count(*) AS n FROM u JOIN v ON u.term = v.term GROUP BY 1, 2, 3")
def doc_term_matrix(spark, sf):
    terms = _terms(spark, sf)
    return T.doc_term_matrix(terms, "doc_id", "tokens", T.vocab_min_df(terms, "tokens", 5, 10_000))


def _gram_sql(n):
    parts = " || ' ' || ".join(f"t[i + {j}]" for j in range(n))
    return f"""WITH {_CLEAN_SQL} SELECT term, count(*) AS n FROM (SELECT {parts} AS term FROM (SELECT t, unnest(range(1, len(t) - {n} + 2)) AS i FROM toks)) GROUP BY 1 ORDER BY n DESC, term LIMIT 40"""


@query("bigrams", _gram_sql(2))
def bigrams(spark, sf):
    return T.ngrams(_terms(spark, sf), "tokens", 2, 40)


@query("trigrams", _gram_sql(3))
def trigrams(spark, sf):
    return T.ngrams(_terms(spark, sf), "tokens", 3, 40)


@query("avg_word_length", rf"SELECT doc_id, round(length(array_to_string({_WORDS}, ''))::DOUBLE / len({_WORDS}), 6) AS mean_len FROM documents")
def avg_word_length(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(X.avg_word_length("text"), 6).alias("mean_len"))


@query("lexical_diversity", rf"SELECT doc_id, round(len(list_distinct({_LOW_WORDS}))::DOUBLE / len({_LOW_WORDS}), 6) AS diversity FROM documents")
def lexical_diversity(spark, sf):
    return _docs(spark, sf).select("doc_id", F.round(X.lexical_diversity("text"), 6).alias("diversity"))


@query("field_jaccard", r"""
WITH p AS (SELECT a.conv_id, a.turn, list_distinct(list_filter(string_split_regex(lower(a.text), '\s+'), lambda x: x <> '')) AS wa,
    list_distinct(list_filter(string_split_regex(lower(b.text), '\s+'), lambda x: x <> '')) AS wb
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(len(list_intersect(wa, wb))::DOUBLE / len(list_distinct(list_concat(wa, wb))), 6) AS jaccard,
  round((len(wb) - len(list_intersect(wa, wb)))::DOUBLE / len(wb), 6) AS unique_share FROM p""")
def field_jaccard(spark, sf):
    c = table(spark, sf, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    pairs = c.select("conv_id", "turn", "text").join(nxt, ["conv_id", "turn"])
    return T.field_jaccard(pairs, "text", "reply").select("conv_id", "turn", F.round("jaccard", 6).alias("jaccard"), F.round("unique_share", 6).alias("unique_share"))


_SENT_SQL = r"""sents AS (SELECT doc_id, lang, s AS sentence, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS sentence_idx FROM (
  SELECT doc_id, lang, trim(unnest(parts), ' ') AS s, generate_subscripts(parts, 1) AS i FROM (
    SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)) WHERE s <> '')"""


@query("sentence_split", f"WITH {_SENT_SQL} SELECT doc_id, sentence_idx, sentence FROM sents")
def sentence_split(spark, sf):
    return T.sentence_split(_docs(spark, sf), "doc_id", "text").withColumn("sentence_idx", F.col("sentence_idx").cast("long"))


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return recursive(_docs(spark, sf), "doc_id", "text")


@query("chunk_fixed", """
WITH n AS (SELECT doc_id, text, greatest(1, CAST(ceil((length(text) - 200) / 800) AS BIGINT)) AS total_chunks FROM documents WHERE trim(text) <> '')
SELECT doc_id, substr(text, i * 800 + 1, 1000) AS chunk_text, i AS chunk_index, total_chunks FROM (SELECT *, unnest(range(0, total_chunks)) AS i FROM n)""")
def chunk_fixed(spark, sf):
    out = fixed(_docs(spark, sf), "doc_id", "text", 1000, 200)
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn("total_chunks", F.col("total_chunks").cast("long"))


_EASY = ", ".join(f"'{w}'" for w in K.EASY_WORDS)


@query("readability", rf"""
WITH a AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, len(w)::DOUBLE AS n, greatest(1, len(list_filter(string_split_regex(text, '[.!?]+'), lambda x: trim(x, ' ') <> '')))::DOUBLE AS s,
  list_transform(w, lambda x: len(regexp_extract_all(lower(x), '[aeiouy]+'))) AS syl, length(array_to_string(w, ''))::DOUBLE AS c,
  len(list_filter(w, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g') NOT IN ({_EASY})))::DOUBLE AS hard FROM a),
d AS (SELECT *, list_sum(syl)::DOUBLE AS y, len(list_filter(syl, lambda x: x >= 3))::DOUBLE AS poly FROM b)
SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE * (n/s) - 84.6::DOUBLE * (y/n), 6) AS flesch_ease,
  round(0.39::DOUBLE * (n/s) + 11.8::DOUBLE * (y/n) - 15.59::DOUBLE, 6) AS flesch_kincaid,
  round(1.043::DOUBLE * sqrt(poly * 30 / s) + 3.1291::DOUBLE, 6) AS smog,
  round(0.0588::DOUBLE * (c*100/n) - 0.296::DOUBLE * (s*100/n) - 15.8::DOUBLE, 6) AS coleman_liau,
  round(4.71::DOUBLE * (c/n) + 0.5::DOUBLE * (n/s) - 21.43::DOUBLE, 6) AS ari,
  round(0.1579::DOUBLE * (hard*100/n) + 0.0496::DOUBLE * (n/s) + CASE WHEN hard*100/n > 5 THEN 3.6365::DOUBLE ELSE 0 END, 6) AS dale_chall FROM d""")
def readability(spark, sf):
    out = T.readability(_docs(spark, sf).select("doc_id", "text"), "text")
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("flesch_ease", "flesch_kincaid", "smog", "coleman_liau", "ari", "dale_chall")])


def _dated(spark, sf):
    """Documents with a dated remark from the order of the same number."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("y"))
    note = F.concat(F.lit(" Printed in "), "y", F.lit(", on the 19th century and the "), F.expr("y div 10 * 10"), F.lit("s."))
    return _docs(spark, sf).join(o, "doc_id").select("doc_id", F.concat("text", note).alias("text"))


_DATED_SQL = """dated AS (SELECT doc_id, text || ' Printed in ' || y || ', on the 19th century and the ' || (y // 10 * 10) || 's.' AS text
  FROM documents JOIN (SELECT o_orderkey, year(o_orderdate) AS y FROM orders) ON doc_id = o_orderkey)"""


@query("temporal_refs", f"WITH {_DATED_SQL}, r AS (" + " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS ref FROM dated" for kind, p in (
        ("year", K.YEAR_PATTERN), ("century", K.CENTURY_PATTERN), ("decade", K.DECADE_PATTERN))) + ") SELECT kind, ref, count(*) AS n FROM r GROUP BY 1, 2")
def temporal_refs(spark, sf):
    return T.temporal_refs(_dated(spark, sf), "text")


@query("life_dates", rf"""WITH {PERSON_NAMES_SQL},
d AS (SELECT id, name, list_concat(regexp_extract_all(name, '{K.SPAN_PATTERN}', 1), regexp_extract_all(name, '{K.SPAN_PATTERN}', 2),
  regexp_extract_all(name, '{K.BORN_DIED_PATTERN}', 1), regexp_extract_all(name, '{K.SINGLE_YEAR_PATTERN}', 1)) AS y FROM person_names)
SELECT id, name, coalesce(array_to_string(list_sort(list_distinct(y)), ','), '') AS dates FROM d""")
def life_dates(spark, sf):
    out = T.life_dates(person_names(spark, sf), "name")
    return out.select("id", "name", F.array_join(F.sort_array("dates"), ",").alias("dates"))


_LETTERS = r"list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z\s]', '', 'g'), '\s+'), lambda x: x <> '')"
_DICT_SQL = f"""dict AS (SELECT word, n FROM (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS d FROM (SELECT doc_id, unnest({_LETTERS}) AS word FROM documents WHERE lang = 'en') GROUP BY 1) WHERE d >= 20)"""


def _dictionary(spark, sf):
    """Words of the English documents seen in at least 20 of them."""
    en = _docs(spark, sf).where("lang = 'en'").select(T._letters("text").alias("tokens"))
    return T.term_frequencies(en, "tokens", 20).select(F.col("term").alias("word"), "n")


@query("spell_ratio", f"""WITH {_DICT_SQL}, u AS (SELECT doc_id, unnest({_LETTERS}) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM u GROUP BY 1, 2), j AS (SELECT c.*, dict.word IS NULL AS bad FROM c LEFT JOIN dict ON c.word = dict.word),
r AS (SELECT doc_id, sum(CASE WHEN bad THEN n ELSE 0 END)::DOUBLE / sum(n) AS ratio FROM j GROUP BY 1),
w AS (SELECT doc_id, string_agg(word, ',' ORDER BY n DESC, word) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word) AS rn FROM j WHERE bad) WHERE rn <= 10 GROUP BY 1)
SELECT d.doc_id, round(coalesce(ratio, 0), 6) AS ratio, coalesce(top, '') AS top_misspelled FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN w ON d.doc_id = w.doc_id""")
def spell_ratio(spark, sf):
    out = T.spell_ratio(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", _dictionary(spark, sf))
    return out.withColumn("ratio", F.round("ratio", 6))


@query("spell_suggest", f"""WITH {_DICT_SQL}, w AS (SELECT DISTINCT unnest({_LETTERS}) AS word FROM conversations),
n AS (SELECT w.word, dict.word AS suggestion, n FROM w JOIN dict ON abs(length(w.word) - length(dict.word)) <= 1 AND levenshtein(w.word, dict.word) <= 1)
SELECT word, suggestion, n FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY word <> suggestion, n DESC, suggestion) AS rn FROM n) WHERE rn = 1""")
def spell_suggest(spark, sf):
    words = table(spark, sf, "conversations").select(F.explode(T._letters("text")).alias("word"))
    return T.spell_suggest(words, _dictionary(spark, sf))


def _held_out():
    """A fifth of the documents, by a hash of their ids."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def _profiles(spark, sf):
    return fit_language_profiles(_docs(spark, sf).where(~_held_out()).select("text", "lang"), "text", "lang")


@query("language_id")
def language_id(spark, sf):
    sents = T.sentence_split(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text")
    return language_of(sents, "sentence", _profiles(spark, sf)).select("doc_id", "sentence_idx", "language")


@query("language_id_accuracy", "SELECT count(*) > 0 AS any_held_out, true AS accurate FROM documents WHERE lang IS NOT NULL")
def language_id_accuracy(spark, sf):
    """Whether at least 0.9 of the documents that the profiles were not made from get their language."""
    docs = _docs(spark, sf).select("doc_id", "text", "lang").where(_held_out() & F.col("lang").isNotNull())
    hit = language_of(docs, "text", _profiles(spark, sf))
    return hit.agg((F.count("*") > 0).alias("any_held_out"), (F.count_if(F.col("language") == F.col("lang")) >= 0.9 * F.count("*")).alias("accurate"))


@query("language_distribution", "SELECT source, lang, count(*) AS n, count(DISTINCT lang) OVER (PARTITION BY source) > 1 AS several FROM documents GROUP BY 1, 2".replace(
    "count(DISTINCT lang) OVER (PARTITION BY source) > 1", "count(*) OVER (PARTITION BY source) > 1"))
def language_distribution(spark, sf):
    counts = _docs(spark, sf).groupBy("source", "lang").agg(F.count("*").alias("n"))
    several = counts.groupBy("source").agg((F.count("*") > 1).alias("several"))
    return counts.join(several, "source")


_LEX = ", ".join(f"('{w}', {p}::DOUBLE, {s}::DOUBLE)" for w, p, s in K.OPINION_LEXICON)
_NEG = ", ".join(f"'{w}'" for w in K.NEGATIONS)


@query("sentiment_lexicon", rf"""
WITH lex(word, polarity, subjectivity) AS (VALUES {_LEX}),
t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 1) AS t FROM documents),
p AS (SELECT doc_id, t[i] AS word, CASE WHEN i > 1 THEN t[i - 1] ELSE '' END AS prev FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM t)),
h AS (SELECT doc_id, avg(polarity * CASE WHEN prev IN ({_NEG}) THEN -0.5::DOUBLE ELSE 1 END) AS polarity, avg(subjectivity) AS subjectivity FROM p JOIN lex USING (word) GROUP BY 1)
SELECT d.doc_id, CASE WHEN round(coalesce(polarity, 0), 10) = 0 THEN 0 ELSE round(polarity, 10) END AS polarity, round(coalesce(subjectivity, 0), 10) AS subjectivity FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def sentiment_lexicon(spark, sf):
    lexicon = spark.createDataFrame(K.OPINION_LEXICON, "word string, polarity double, subjectivity double")
    out = T.sentiment_lexicon(_docs(spark, sf).select("doc_id", "text"), "doc_id", "text", lexicon)
    return out.select("doc_id", F.round("polarity", 10).alias("polarity"), F.round("subjectivity", 10).alias("subjectivity"))


def _gazetteer(spark, sf):
    """Names of 2 to 12 words, the openings of the benchmark passages, and the passages' whole sentences as works."""
    b = table(spark, sf, "benchmark")
    n = (2 + F.col("item_id") % 11).cast("int")
    opening = b.withColumn("_t", X.tokens("text", 1)).where(F.size("_t") >= n).select(
        F.array_join(F.slice("_t", F.lit(1), n), " ").alias("entity_text"), F.when(F.col("item_id") % 2 == 0, "PERSON").otherwise("ORG").alias("entity_label"))
    works = T.sentence_split(b, "item_id", "text").select(F.array_join(X.tokens("sentence", 1), " ").alias("entity_text"), F.lit("WORK").alias("entity_label"))
    return opening.unionByName(works).where("entity_text <> ''").distinct()


_TOKENS = lambda t: rf"list_filter(regexp_split_to_array(lower({t}), '\W+'), lambda x: length(x) >= 1)"
_ENT_SQL = rf"""{_SENT_SQL}, bw AS (SELECT item_id, {_TOKENS('text')} AS w FROM benchmark),
gz AS MATERIALIZED (SELECT DISTINCT entity_text, entity_label, len(string_split(entity_text, ' ')) AS n FROM (
  SELECT array_to_string(w[1:2 + item_id % 11], ' ') AS entity_text, CASE WHEN item_id % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS entity_label FROM bw WHERE len(w) >= 2 + item_id % 11
  UNION ALL SELECT array_to_string({_TOKENS('s')}, ' '), 'WORK' FROM (SELECT unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM benchmark)) WHERE entity_text <> ''),
st AS MATERIALIZED (SELECT doc_id, sentence_idx, sentence, {_TOKENS('sentence')} AS t FROM sents),
gr AS (SELECT doc_id, sentence_idx, t, i, t[i] AS w FROM (SELECT doc_id, sentence_idx, t, unnest(range(1, len(t) + 1)) AS i FROM st)),
ent AS (SELECT doc_id, sentence_idx, entity_text, entity_label FROM gr JOIN (SELECT *, string_split(entity_text, ' ')[1] AS w FROM gz) g
    ON gr.w = g.w AND array_to_string(t[i:i + n - 1], ' ') = entity_text
  UNION ALL SELECT doc_id, sentence_idx, unnest(regexp_extract_all(sentence, '{K.YEAR_PATTERN}')), 'DATE' FROM st)"""


def _entities(spark, sf):
    return entity_mentions_of(_docs(spark, sf), "doc_id", "text", _gazetteer(spark, sf))


@query("entity_mentions", f"WITH {_ENT_SQL} SELECT doc_id, sentence_idx, entity_text, entity_label FROM ent")
def entity_mentions(spark, sf):
    return _entities(spark, sf).withColumn("sentence_idx", F.col("sentence_idx").cast("long"))


@query("entity_type_counts", f"""WITH {_ENT_SQL}, c AS (SELECT entity_label, entity_text, count(*) AS n, row_number() OVER (PARTITION BY entity_label ORDER BY count(*) DESC, entity_text) AS rn FROM ent GROUP BY 1, 2)
SELECT entity_label, entity_text, n FROM c WHERE rn <= 5""")
def entity_type_counts(spark, sf):
    return group_top_values(_entities(spark, sf), "entity_label", "entity_text", 5)


@query("lda_topics")
def lda_topics(spark, sf):
    return T.lda_topics(_terms(spark, sf), "tokens", 10, 10)


@query("word2vec_doc_vectors")
def word2vec_doc_vectors(spark, sf):
    out = T.word2vec_doc_vectors(_terms(spark, sf).select("doc_id", "tokens"), "tokens")
    return out.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


@query("kmeans_segments")
def kmeans_segments(spark, sf):
    return value_counts(T.kmeans_segments(table(spark, sf, "embeddings"), "embedding", 5), "cluster")


@query("collection_overlap_lang", """
WITH m AS (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1)
SELECT d.source, count(*) AS n_texts FROM documents d JOIN m ON d.source = m.source JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def collection_overlap_lang(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "source", "lang")
    mixed = docs.select("source", "lang").distinct().groupBy("source").agg(F.count("*").alias("k")).where("k > 1").select("source")
    reviewed = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id")
    return reviewed.groupBy("source").agg(F.count("*").alias("n_texts")).join(mixed, "source", "left_semi")


@query("field_completeness", WORKS_TEXT_SQL + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS field, count(*) FILTER (length({c}) > 0) AS n_filled, CAST(sum(len(string_split({c}, ';'))) AS BIGINT) AS n_items FROM works_text"""
    for c in ("contributor_names", "subject_labels", "language_labels", "availability_labels")))
def field_completeness(spark, sf):
    from quire.operators.nested import works_text_flattened
    cols = ["contributor_names", "subject_labels", "language_labels", "availability_labels"]
    flat = works_text_flattened(works(spark, sf))
    wide = flat.agg(*[F.struct(F.count_if(F.length(c) > 0).alias("n_filled"), F.sum(F.size(F.split(c, ";"))).alias("n_items")).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).n_filled.alias("n_filled"), F.col(c).n_items.alias("n_items")) for c in cols])).alias("r")).select("r.*")


@query("dup_sentence_lookup", f"WITH {_SENT_SQL} SELECT doc_id, sentence_idx, sentence FROM sents WHERE sentence_idx = 0")
def dup_sentence_lookup(spark, sf):
    s = T.sentence_split(_docs(spark, sf), "doc_id", "text").where("sentence_idx = 0")
    return s.withColumn("sentence_idx", F.col("sentence_idx").cast("long"))


@query("html_text_title", r"""
SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ') AS title,
  md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head.*?</head>', ' ', 'g'), '(?is)<script.*?</script>', ' ', 'g'),
    '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), ' ')) AS body_md5,
  coalesce(array_to_string(regexp_extract_all(html, '(?i)<a\s[^>]*href="([^"]*)"', 1), ' '), '') AS links FROM pages""")
def html_text_title(spark, sf):
    return T.html_text_title(table(spark, sf, "pages"), "html").select(
        "page_id", "title", F.md5("body_text").alias("body_md5"), F.array_join("links", " ").alias("links"))
