"""2.11 Entity resolution."""

from pyspark.sql import functions as F

from quire.operators import fellegi_sunter
from quire.operators import linkage as L
from quire.operators.components import cluster_pairs as cluster, cluster_refine as refine
from quire.operators.vectors import centroids, knn_exact
from quire.functions.vectors import l2_normalize
from quire.plans.fixtures import LABELS_SQL, PERSON_NAMES_SQL, labels_combined, person_names
from quire.plans.registry import query, table, texts
from quire.runtime import durable

RECORDS_SQL = f"""{LABELS_SQL}, recs AS (SELECT idx, label, coalesce(id, 'null' || lpad(CAST(idx - (SELECT count(*) FROM (SELECT DISTINCT label, id, type FROM labels_combined) WHERE id IS NOT NULL) AS VARCHAR), 5, '0')) AS id, type
  FROM (SELECT *, row_number() OVER (ORDER BY id, label, type) - 1 AS idx FROM (SELECT DISTINCT label, id, type FROM labels_combined)))"""


def _records(spark, sf):
    return L.dedupe_input(labels_combined(spark, sf))


@query("combine_labels", f"WITH {LABELS_SQL} SELECT label, id, type, source FROM labels_combined")
def combine_labels(spark, sf):
    return labels_combined(spark, sf)


@query("dedupe_input", f"WITH {RECORDS_SQL} SELECT idx, label, id, type FROM recs")
def dedupe_input(spark, sf):
    return _records(spark, sf)


_TOKS = r"list_filter(regexp_split_to_array(lower(name), '\W+'), lambda x: length(x) >= 1)"
_BLOCKS_SQL = rf"""{PERSON_NAMES_SQL}, pt AS (SELECT id, name, {_TOKS} AS t FROM person_names),
pw AS (SELECT DISTINCT id, unnest(t) AS w FROM pt), pf AS (SELECT w, count(*) AS f FROM pw GROUP BY 1),
pr AS (SELECT id, w FROM (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS rn FROM pw JOIN pf USING (w)) WHERE rn = 1),
blocks AS (SELECT DISTINCT id, block_key FROM (
  SELECT id, 'first_token:' || t[1] AS block_key FROM pt WHERE len(t) > 0
  UNION ALL SELECT id, 'sorted_tokens:' || array_to_string(list_sort(t), ' ') FROM pt WHERE len(t) > 0
  UNION ALL SELECT id, 'prefix5:' || lower(name)[1:5] FROM pt
  UNION ALL SELECT id, 'surname_year:' || lower(trim(regexp_extract(name, '^([^,]*),', 1), ' ')) || '|' || regexp_extract(name, '\b(\d{{4}})\b', 1) FROM pt WHERE regexp_extract(name, '\b(\d{{4}})\b', 1) <> ''
  UNION ALL SELECT id, 'rare_grams:' || CASE WHEN length(w) < 3 THEN w ELSE substr(w, i, 3) END FROM (SELECT id, w, unnest(range(1, greatest(length(w) - 2, 1) + 1)) AS i FROM pr)))"""


def _blocks(spark, sf):
    return L.block_keys(person_names(spark, sf), "id", "name")


@query("block_keys", f"WITH {_BLOCKS_SQL} SELECT block_key, id FROM blocks")
def block_keys(spark, sf):
    return _blocks(spark, sf)


@query("block_size_report", f"WITH {_BLOCKS_SQL} SELECT block_key, count(*) AS size, count(*) * count(*) AS cost FROM blocks GROUP BY 1")
def block_size_report(spark, sf):
    return L.block_size_report(_blocks(spark, sf))


@query("block_size_cap", f"""WITH {_BLOCKS_SQL}, z AS (SELECT block_key, count(*) AS size FROM blocks GROUP BY 1)
SELECT b.block_key, b.id FROM blocks b JOIN z ON b.block_key = z.block_key WHERE z.size <= (SELECT quantile_cont(size::DOUBLE, 0.998) FROM z)""")
def block_size_cap(spark, sf):
    return L.block_size_cap(_blocks(spark, sf))


@query("type_restrict_blocks", f"""WITH {RECORDS_SQL} SELECT 'first_token:' || regexp_split_to_array(lower(label), '\\W+')[1] AS block_key, idx FROM recs WHERE type IN ('Person', 'Agent')""")
def type_restrict_blocks(spark, sf):
    recs = _records(spark, sf)
    blocks = L.block_keys(recs, "idx", "label", ("first_token",))
    return blocks.join(recs.where(F.col("type").isin("Person", "Agent")).select("idx"), "idx", "left_semi").select("block_key", "idx")


_GRAMS = "list_distinct(list_transform(range(1, length(l) - 1), lambda i: substr(l, i, 3)))"
_PAIRS_SQL = f"""{RECORDS_SQL}, units AS (SELECT lower(label) AS l, min(idx) AS rep FROM recs GROUP BY 1),
gr AS (SELECT rep, l, {_GRAMS} AS g FROM units),
bk AS (SELECT DISTINCT rep, k FROM (SELECT rep, CASE WHEN i = 0 THEN l ELSE substr(l, 1, i - 1) || substr(l, i + 1) END AS k FROM (SELECT rep, l, unnest(range(0, length(l) + 1)) AS i FROM units))),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM bk a JOIN bk b ON a.k = b.k AND a.rep < b.rep),
pairs AS (SELECT a AS id_l, b AS id_r, len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(list_concat(x.g, y.g))) AS similarity FROM cand JOIN gr x ON x.rep = a JOIN gr y ON y.rep = b),
kept AS (SELECT * FROM pairs WHERE similarity >= 0.6 - 1e-9 UNION ALL SELECT rep, idx, 1.0 FROM recs JOIN units ON lower(label) = l WHERE idx > rep)"""


def _pairs(spark, sf, recs, carry=(), every=False):
    return L.candidate_pairs(L.block_keys(recs, "idx", "label", ("sorted_tokens", "one_deletion")), recs, 0.6, carry=carry, every=every)


@query("candidate_pairs", f"WITH {_PAIRS_SQL} SELECT id_l, id_r, round(similarity, 6) AS similarity FROM kept")
def candidate_pairs(spark, sf):
    return _pairs(spark, sf, _records(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query("candidate_pairs_all_kinds", f"""WITH {_BLOCKS_SQL}, un AS (SELECT name, min(id) AS rep FROM person_names GROUP BY 1),
ug AS (SELECT rep, list_distinct(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3))) AS g FROM un),
ub AS (SELECT DISTINCT block_key, rep FROM blocks JOIN un ON rep = id),
cand AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM ub a JOIN ub b ON a.block_key = b.block_key AND a.rep < b.rep),
met AS (SELECT a AS id_l, b AS id_r, len(list_intersect(x.g, y.g))::DOUBLE / len(list_distinct(list_concat(x.g, y.g))) AS similarity FROM cand JOIN ug x ON x.rep = a JOIN ug y ON y.rep = b)
SELECT id_l, id_r, round(similarity, 6) AS similarity FROM met WHERE similarity >= 0.6 - 1e-9
UNION ALL SELECT rep, id, 1.0 FROM person_names JOIN un ON person_names.name = un.name WHERE id > rep""")
def candidate_pairs_all_kinds(spark, sf):
    """Names that share a block of any kind; the copies of a name are tied to its smallest id, which stands for them."""
    names = person_names(spark, sf).select("id", F.col("name").alias("label"))
    return L.candidate_pairs(_blocks(spark, sf), names, 0.6, id="id").withColumn("similarity", F.round("similarity", 6))


_FEATURES_SQL = f"""{_PAIRS_SQL}, nm AS (SELECT id_l, id_r, lower(a.label) AS x, lower(b.label) AS y, a.type AS type_l, b.type AS type_r, a.label AS label_l, b.label AS label_r FROM kept JOIN recs a ON a.idx = id_l JOIN recs b ON b.idx = id_r),
feat AS (SELECT *, 1 - levenshtein(x, y)::DOUBLE / greatest(length(x), length(y)) AS edit_sim, len(list_intersect(tx, ty))::DOUBLE / len(list_distinct(list_concat(tx, ty))) AS token_jaccard,
    CASE WHEN type_l = type_r THEN 1.0::DOUBLE ELSE 0 END AS same_type, 0.0::DOUBLE AS shared_year
  FROM (SELECT *, list_filter(regexp_split_to_array(x, '\\W+'), lambda z: length(z) >= 1) AS tx, list_filter(regexp_split_to_array(y, '\\W+'), lambda z: length(z) >= 1) AS ty FROM nm)),
scored AS (SELECT *, 0.5::DOUBLE * edit_sim + 0.3::DOUBLE * token_jaccard + 0.15::DOUBLE * same_type + 0.05::DOUBLE * shared_year AS score FROM feat)"""


def _features(spark, sf, every=False):
    return L.pair_features(_pairs(spark, sf, _records(spark, sf), ("label", "type"), every))


def _scored(spark, sf):
    """The same features, of words and years that are cut once per record."""
    return L.pair_scores(L.pair_features(_pairs(spark, sf, L.label_parts(_records(spark, sf)), ("label", "type", "words", "years"))))


@query("pair_features", f"WITH {_FEATURES_SQL} SELECT id_l, id_r, round(edit_sim, 6) AS edit_sim, round(token_jaccard, 6) AS token_jaccard, same_type, shared_year FROM feat")
def pair_features(spark, sf):
    return _features(spark, sf).select("id_l", "id_r", F.round("edit_sim", 6).alias("edit_sim"), F.round("token_jaccard", 6).alias("token_jaccard"), "same_type", "shared_year")


@query("fuzz_ratio", f"""WITH {_FEATURES_SQL} SELECT id_l, id_r, CAST(round(100 * (1 - levenshtein(label_l, label_r)::DOUBLE / greatest(length(label_l), length(label_r)))) AS BIGINT) AS ratio
FROM scored WHERE round(100 * (1 - levenshtein(label_l, label_r)::DOUBLE / greatest(length(label_l), length(label_r)))) < 95""")
def fuzz_ratio(spark, sf):
    out = _features(spark, sf).select("id_l", "id_r", L.fuzz_ratio("label_l", "label_r").alias("ratio"))
    return out.where("ratio < 95")


@query("fuzz_ratio_exact")
def fuzz_ratio_exact(spark, sf):
    """All pairs of records, copies of a label included."""
    return _features(spark, sf, every=True).select("id_l", "id_r", L.fuzz_ratio("label_l", "label_r", exact=True).alias("ratio"))


@query("pair_scores", f"WITH {_FEATURES_SQL} SELECT id_l, id_r, round(score, 6) AS score FROM scored")
def pair_scores(spark, sf):
    return _scored(spark, sf).select("id_l", "id_r", F.round("score", 6).alias("score"))


def _name_pairs(spark, sf):
    """Features of the candidate pairs of person names."""
    names = person_names(spark, sf).select("id", F.col("name").alias("label"), F.lit("Person").alias("type"))
    pairs = L.candidate_pairs(_blocks(spark, sf), names, 0.6, id="id").select("id_l", "id_r")
    return L.pair_features(L.double_lookup(pairs, names, "id_l", "id_r", "id"))


def _reviewed(spark, sf, pairs):
    """A review log of the pairs: the reviewer knows nation and first and last year of the orders, which few names show in full."""
    years = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.year("o_orderdate")).alias("y0"), F.max(F.year("o_orderdate")).alias("y1"))
    who = table(spark, sf, "customer").join(years, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.struct("c_nationkey", "y0", "y1").alias("k"))
    both = pairs.select("id_l", "id_r").join(who.select(F.col("c_custkey").alias("id_l"), F.col("k").alias("kl")), "id_l").join(who.select(F.col("c_custkey").alias("id_r"), F.col("k").alias("kr")), "id_r")
    return both.select("id_l", "id_r", F.when(F.col("kl").eqNullSafe(F.col("kr")), "match").otherwise("distinct").alias("label"), F.lit(1).alias("at"))


@query("pair_scores_model")
def pair_scores_model(spark, sf):
    """Regression on the labels in force of a review log."""
    f = durable(_name_pairs(spark, sf), "features")
    ledger = L.label_ledger(_reviewed(spark, sf, f)).withColumn("y", (F.col("pair_label") == "match").cast("double"))
    return L.pair_scores(f, L.fit_pair_model(f.join(ledger, ["id_l", "id_r"]), "y")).select("id_l", "id_r", F.round("score", 3).alias("score"))


@query("pair_scores_em")
def pair_scores_em(spark, sf):
    """The same pairs weighed without any labels."""
    f = durable(_name_pairs(spark, sf), "features")
    model = fellegi_sunter.fit_match_model(f, {"edit_sim": (0.7, 0.85, 0.95), "token_jaccard": (0.4, 0.7, 1.0), "shared_year": (1.0,)})
    return fellegi_sunter.match_scores(f, model).select("id_l", "id_r", F.round("weight", 4).alias("weight"), F.round("score", 4).alias("score"))


def _components_sql(edges, nodes="SELECT a AS id FROM e"):
    return f"""e AS ({edges}), reach AS (SELECT DISTINCT a AS id, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id AND reach.root < e.b),
comp AS (SELECT id, min(root) AS canon_id FROM reach GROUP BY 1)"""


@query("cluster_pairs", f"""WITH RECURSIVE {_FEATURES_SQL}, {_components_sql("SELECT id_l AS a, id_r AS b, score FROM scored WHERE score >= 0.4 UNION ALL SELECT id_r, id_l, score FROM scored WHERE score >= 0.4")},
best AS (SELECT a AS id, max(score) AS prob FROM e GROUP BY 1)
SELECT comp.id, canon_id, round(prob, 6) AS prob FROM comp JOIN best ON comp.id = best.id""")
def cluster_pairs(spark, sf):
    return cluster(_scored(spark, sf)).withColumn("prob", F.round("prob", 6))


@query("cluster_refine")
def cluster_refine(spark, sf):
    pairs = durable(_pairs(spark, sf, _records(spark, sf)), "pairs")
    return refine(pairs, cluster(pairs, 0.85, score="similarity"), 0.85, score="similarity")


_TIGHT_SQL = f"""{_PAIRS_SQL}, {_components_sql("SELECT id_l AS a, id_r AS b FROM kept WHERE similarity >= 0.85 UNION ALL SELECT id_r, id_l FROM kept WHERE similarity >= 0.85")}"""


def _tight(spark, sf, recs):
    return cluster(_pairs(spark, sf, recs), 0.85, score="similarity")


@query("canonical_join", f"""WITH RECURSIVE {_TIGHT_SQL}
SELECT comp.id, canon_id, a.label AS label_l, a.type AS type_l, b.label AS label_r, b.type AS type_r FROM comp JOIN recs a ON a.idx = comp.id JOIN recs b ON b.idx = canon_id
WHERE a.label <> b.label OR a.type <> b.type""")
def canonical_join(spark, sf):
    recs = _records(spark, sf)
    return L.canonical_join(_tight(spark, sf, recs), recs).select("id", "canon_id", "label_l", "type_l", "label_r", "type_r")


@query("canonical_rollup", f"""WITH RECURSIVE {_TIGHT_SQL}, f AS (SELECT idx, o_totalprice FROM orders JOIN recs ON id = 'c' || o_custkey)
SELECT coalesce(canon_id, idx) AS canon_id, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM f LEFT JOIN comp ON comp.id = idx GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10""")
def canonical_rollup(spark, sf):
    recs = _records(spark, sf)
    facts = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("id"), "o_totalprice").join(recs.select("id", "idx"), "id")
    return L.canonical_rollup(facts, _tight(spark, sf, recs), "idx", "o_totalprice", 10).withColumn("total", F.round("total", 2))


@query("uncertain_pairs", f"""WITH {_FEATURES_SQL} SELECT id_l, id_r, round(score, 6) AS score FROM scored WHERE NOT (type_l = 'Agent' AND type_r = 'Agent') ORDER BY abs(round(score, 9) - 0.5), id_l, id_r LIMIT 25""")
def uncertain_pairs(spark, sf):
    scored = durable(_scored(spark, sf).select("id_l", "id_r", "type_l", "type_r", "score"), "scored")  # read twice
    done = scored.where("type_l = 'Agent' AND type_r = 'Agent'")
    return L.uncertain_pairs(scored, done, 25).select("id_l", "id_r", F.round("score", 6).alias("score"))


@query("label_ledger", """
WITH log AS (SELECT l_partkey AS id_l, l_suppkey AS id_r, l_shipdate AS made, CASE WHEN l_linenumber = 7 THEN 'remove' WHEN l_returnflag = 'R' THEN 'unsure' WHEN l_returnflag = 'A' THEN 'match' ELSE 'distinct' END AS label FROM lineitem),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_l, id_r ORDER BY made DESC, label) AS rn FROM log) WHERE rn = 1)
SELECT id_l, id_r, unnest(CASE WHEN label = 'unsure' THEN ['match', 'distinct'] ELSE [label] END) AS pair_label FROM last WHERE label <> 'remove'""")
def label_ledger(spark, sf):
    label = (F.when(F.col("l_linenumber") == 7, "remove").when(F.col("l_returnflag") == "R", "unsure")
             .when(F.col("l_returnflag") == "A", "match").otherwise("distinct"))
    log = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id_l"), F.col("l_suppkey").alias("id_r"), F.col("l_shipdate").alias("at"), label.alias("label"))
    return L.label_ledger(log)


@query("eval_ledger", """
WITH ev AS (SELECT l_partkey AS id, l_shipdate AS made, CASE WHEN l_quantity < 15 THEN 'yes' WHEN l_quantity < 30 THEN 'no' ELSE 'unsure' END AS evaluation FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate < TIMESTAMP '1998-01-01'),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY made DESC, evaluation) AS rn FROM ev) WHERE rn = 1),
g AS (SELECT p_type AS type, count(*) AS n_pairs, count(evaluation) AS n_evaluated, count(*) FILTER (evaluation = 'yes') AS n_yes, count(*) FILTER (evaluation = 'no') AS n_no, count(*) FILTER (evaluation = 'unsure') AS n_unsure FROM part LEFT JOIN last ON id = p_partkey GROUP BY 1)
SELECT *, round(n_yes / nullif(n_yes + n_no, 0), 6) AS precision, n_pairs - n_evaluated AS remaining FROM g""")
def eval_ledger(spark, sf):
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R' AND l_shipdate < timestamp'1998-01-01'")
    ev = li.select(F.col("l_partkey").alias("id"), F.col("l_shipdate").alias("at"), F.when(F.col("l_quantity") < 15, "yes").when(F.col("l_quantity") < 30, "no").otherwise("unsure").alias("evaluation"))
    pairs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"))
    return L.eval_ledger(ev, pairs).withColumn("precision", F.round("precision", 6))


HITS_SQL = """m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, generate_series(1, 64) s(i) GROUP BY 1, 2),
nrm AS (SELECT label, sqrt(sum(x * x)) AS z FROM m GROUP BY 1), c AS (SELECT m.label, list(x / z ORDER BY i) AS v FROM m JOIN nrm ON m.label = nrm.label GROUP BY 1),
hits AS (SELECT * FROM (SELECT c.label AS query_id, vec_id AS corpus_id, round(list_dot_product(c.v, embedding::DOUBLE[]), 12) AS score,
   row_number() OVER (PARTITION BY c.label ORDER BY round(list_dot_product(c.v, embedding::DOUBLE[]), 12) DESC, vec_id) AS rank FROM c, embeddings) WHERE rank <= 20)"""


def label_queries(spark, sf):
    """One unit-length query vector per label: the mean of its vectors, so the work follows the table."""
    c = centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select(F.col("label").alias("query_id"), l2_normalize("vector").alias("vector"))


def vector_corpus(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("corpus_id"), F.col("embedding").alias("vector"), "label")


@query("name_candidates", f"""WITH {HITS_SQL} SELECT query_id, corpus_id, round(score, 6) AS score, round(cut, 6) AS cutoff, score >= cut AS in_context
FROM (SELECT *, greatest(max(score) OVER (PARTITION BY query_id), 0.8::DOUBLE) * 0.7::DOUBLE AS cut FROM hits)""")
def name_candidates(spark, sf):
    hits = knn_exact(label_queries(spark, sf), vector_corpus(spark, sf), 20)
    return L.name_candidates(hits).select("query_id", "corpus_id", F.round("score", 6).alias("score"), F.round("cutoff", 6).alias("cutoff"), "in_context")


_BARE = r"regexp_replace({c}, '\([^)]*\)|\b[bd]\.\s*\d{{4}}|\d{{4}}\s*-?\s*(\d{{4}})?|[.]', ' ', 'g')"


def _parts_sql(c, s):
    bare = _BARE.format(c=c)
    return rf"""lower(trim(regexp_extract({bare}, '^([^,]*)', 1), ' ')) AS surname_{s},
  list_filter(string_split_regex(lower(regexp_extract({bare}, '^[^,]*,([^,]*)', 1)), '\s+'), lambda x: x <> '') AS fore_{s}, regexp_extract_all({c}, '\b(\d{{4}})\b', 1) AS years_{s}"""


_RULES_SQL = rf"""{PERSON_NAMES_SQL}, np AS (SELECT p.id, p.name AS target, f.id AS candidate_id, f.name AS candidate FROM person_names p JOIN person_names f ON split_part(p.name, ',', 1) = split_part(f.name, ',', 1) AND p.id <> f.id),
q AS (SELECT *, {_parts_sql('target', 't')}, {_parts_sql('candidate', 'c')} FROM np),
z AS (SELECT *, len(list_intersect(years_t, years_c)) > 0 AS shared, len(years_t) = 0 OR len(years_c) = 0 AS undated,
   len(list_filter(fore_t, lambda x: length(x) = 1)) > 0 OR len(list_filter(fore_c, lambda x: length(x) = 1)) > 0 AS short, list_transform(fore_t, lambda x: x[1]) = list_transform(fore_c, lambda x: x[1]) AS ini FROM q),
judged AS (SELECT id, target, candidate_id, candidate, CASE WHEN surname_t <> surname_c OR surname_t = '' OR len(fore_t) = 0 OR len(fore_c) = 0 THEN 'none' WHEN fore_t = fore_c AND NOT short THEN CASE WHEN shared THEN 'high' WHEN undated THEN 'medium' ELSE 'none' END
  WHEN ini AND short THEN CASE WHEN shared THEN 'medium' ELSE 'low' END ELSE 'none' END AS degree FROM z),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE degree WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, candidate_id) AS rn FROM judged WHERE degree <> 'none') WHERE rn = 1),
graded AS (SELECT p.id, p.name AS target, candidate_id, candidate, coalesce(degree, 'none') AS degree FROM person_names p LEFT JOIN best ON p.id = best.id)"""


def _graded(spark, sf):
    """Every name with the best of all others."""
    return L.reconcile_names(person_names(spark, sf), "id", "name")


@query("reconcile_rules", f"WITH {_RULES_SQL} SELECT id, target, candidate_id, candidate, degree, degree IN ('high', 'medium') AS reconciled FROM graded")
def reconcile_rules(spark, sf):
    return _graded(spark, sf)


@query("reconcile_record", f"""WITH {HITS_SQL} SELECT query_id, 'label ' || query_id AS label, coalesce(string_agg(CASE WHEN score >= 0.5 THEN 'vec ' || corpus_id END, ';' ORDER BY rank), '') AS reconciled_labels,
  string_agg(corpus_id || ':' || rank, ';' ORDER BY rank) AS candidates FROM hits GROUP BY 1""")
def reconcile_record(spark, sf):
    hits = knn_exact(label_queries(spark, sf), vector_corpus(spark, sf), 20).select(
        "query_id", F.concat(F.lit("label "), "query_id").alias("label"), "rank", F.col("corpus_id").alias("idx"),
        F.concat(F.lit("vec "), "corpus_id").alias("candidate"), "score", (F.col("score") >= 0.5).alias("reconciled"))
    out = L.reconcile_record(hits)
    return out.select("query_id", "label", F.array_join("reconciled_labels", ";").alias("reconciled_labels"),
                      F.array_join(F.transform("candidates", lambda c: F.concat(c["idx"], F.lit(":"), c["rank"])), ";").alias("candidates"))


@query("exact_dup_docs", "SELECT sha256(text) AS text_hash, min(doc_id) AS canon_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_docs(spark, sf):
    return L.exact_dup_docs(table(spark, sf, "documents"), "doc_id", "text")


_SHINGLES_SQL = r"""dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\W+'), lambda x: length(x) >= 1) AS t FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, CASE WHEN len(t) < 5 THEN array_to_string(t, ' ') ELSE array_to_string(t[i:i+4], ' ') END AS s FROM (SELECT doc_id, t, unnest(range(1, greatest(len(t) - 4, 1) + 1)) AS i FROM dt WHERE len(t) > 0))),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
ov AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (SELECT x, y, c::DOUBLE / (p.n + q.n - c) AS similarity FROM ov JOIN sz p ON p.doc_id = x JOIN sz q ON q.doc_id = y WHERE c::DOUBLE / (p.n + q.n - c) >= 0.8 - 1e-9)"""


@query("near_dup_docs", f"""WITH RECURSIVE {_SHINGLES_SQL}, {_components_sql("SELECT x AS a, y AS b FROM near UNION ALL SELECT y, x FROM near")}
SELECT id, canon_id FROM comp""")
def near_dup_docs(spark, sf):
    return L.near_dup_docs(texts(spark, sf, "doc_id", "text"), "doc_id", "text")
