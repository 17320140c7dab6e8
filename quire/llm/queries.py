"""Thin queries over whole tables, one per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.llm import chat, debruijn, decontaminate, mixing, multi_index, packing, periodic, pii, sharding, simhash, token_store, toxicity, whitening
from quire.llm.registry import LLM_CATALOG, llm_query, table


def load() -> dict:
    return LLM_CATALOG


@llm_query("op1_hash_tree_shards")
def op1_hash_tree_shards(spark, sf):
    tree = sharding.balanced_tree()
    return sharding.shard_documents(table(spark, sf, "documents"), tree, sharding.with_shard(tree))


CONTAINED_SQL = r"""
WITH lowered AS (SELECT doc_id AS id, 'd' AS side, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT item_id, 'i', translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id IS NOT NULL),
worded AS (SELECT id, side, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM lowered),
grams AS (SELECT DISTINCT id, side, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM worded WHERE len(w) > 0),
sizes AS (SELECT id AS item_id, count(*) AS n FROM grams WHERE side = 'i' GROUP BY 1)
SELECT d.id AS doc_id, i.id AS item_id, CAST(count(*) AS INTEGER) AS shared, CAST(any_value(n) AS INTEGER) AS item_shingles,
  count(*) / any_value(n)::DOUBLE AS containment
FROM grams d JOIN grams i ON d.side = 'd' AND i.side = 'i' AND d.g = i.g JOIN sizes ON sizes.item_id = i.id
GROUP BY 1, 2 HAVING count(*) >= 0.8 * any_value(n)"""


@llm_query("op2_minhash_containment", CONTAINED_SQL)
def op2_minhash_containment(spark, sf):
    return decontaminate.contained_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@llm_query("op3_covering_simhash")
def op3_covering_simhash(spark, sf):
    return simhash.simhash_components(table(spark, sf, "documents"))


@llm_query("op4_pii_spans")
def op4_pii_spans(spark, sf):
    return pii.pii_digests(table(spark, sf, "documents"))


@llm_query("op5_debruijn_repeats")
def op5_debruijn_repeats(spark, sf):
    kept = debruijn.remove_repeats(table(spark, sf, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


HAMMING_SQL = """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0),
met AS (SELECT q.vec_id AS query_id, b.vec_id AS id,
    CAST(list_sum(list_transform(list_zip(q.c, b.c), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM codes q, codes b WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM met) WHERE rank <= 10"""


@llm_query("op6_multi_index_top_k", HAMMING_SQL)
def op6_multi_index_top_k(spark, sf):
    base = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), multi_index.sign_code(F.col("embedding"), 64).alias("code"))
    return multi_index.hamming_top_k(base, base.where(F.col("id") % 100 == 0), k=10)


@llm_query("op7_cnn_toxicity")
def op7_cnn_toxicity(spark, sf):
    return toxicity.toxicity_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@llm_query("op8_prefix_targets")
def op8_prefix_targets(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(rows.unionByName(more))


_FIRST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_REST = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
MIX_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents),
k AS (SELECT *, length(bin(size)) AS size_class FROM d),
s AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source),
s1 AS (SELECT *, 3::DOUBLE * ss / w AS ratio FROM s),
s2 AS (SELECT *, (sum(ss) OVER () - 3::DOUBLE * coalesce(sum(ss) OVER (ORDER BY ratio, source IS NULL, source {_FIRST}), 0))
    / sum(w) OVER (ORDER BY ratio, source IS NULL, source {_REST}) AS share FROM s1),
lvl AS (SELECT ratio AS lr, share AS ls FROM s2 WHERE share <= ratio ORDER BY ratio, share LIMIT 1),
t AS (SELECT source, ss, CASE WHEN ratio >= lr THEN least(ls, ratio) * w ELSE 3::DOUBLE * ss END AS target FROM s2, lvl),
c AS (SELECT k.source, size_class, CAST(sum(size) AS DOUBLE) AS cs, 1::DOUBLE / (1::DOUBLE + 0.05::DOUBLE * size_class) AS cw, any_value(ss) AS ss, any_value(target) AS target
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
c1 AS (SELECT *, (target - 3::DOUBLE * coalesce(sum(cs) OVER (PARTITION BY source ORDER BY size_class {_FIRST}), 0))
    / sum(cw * cs) OVER (PARTITION BY source ORDER BY size_class {_REST}) AS a FROM c WHERE ss > 0),
c2 AS (SELECT *, min(CASE WHEN a * cw <= 3 THEN {{'i': size_class, 'a': a}} END) OVER (PARTITION BY source) AS f FROM c1),
c3 AS (SELECT source, size_class, cs, ss, target, CASE WHEN size_class >= f.i THEN f.a * cw ELSE 3 END AS copies FROM c2),
c4 AS (SELECT *, floor(copies + 1e-12::DOUBLE) AS whole FROM c3),
c5 AS (SELECT *, greatest(copies - whole, 0) AS p, target - sum(whole * cs) OVER (PARTITION BY source) AS missing FROM c4),
j AS (SELECT rid, doc_id, k.source, size, u, t.ss, t.target, coalesce(missing, 0) AS missing, coalesce(whole, 0) AS whole,
    CASE WHEN p > 0 AND size > 0 THEN least(floor(u * (1 - p) / (u * (1 - p) + (1 - u) * p) * 4503599627370496::DOUBLE), 4503599627370495) END AS rank
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
  LEFT JOIN c5 ON k.source IS NOT DISTINCT FROM c5.source AND k.size_class = c5.size_class),
x AS (SELECT *, CASE WHEN rank IS NOT NULL AND coalesce(sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, u, doc_id, size, rid {_FIRST}), 0) + size / 2 <= missing
    THEN 1 ELSE 0 END AS extra FROM j),
m AS (SELECT source, any_value(target) - CAST(sum((whole + extra) * size) AS DOUBLE) AS miss FROM x GROUP BY 1),
e AS (SELECT x.source, arg_min(rid, {{'g': abs(miss - size * (1 - 2 * extra)), 'r': rank, 'u': u, 'd': doc_id, 's': size, 'i': rid}}) AS changed
  FROM x JOIN m ON x.source IS NOT DISTINCT FROM m.source WHERE rank IS NOT NULL AND abs(miss - size * (1 - 2 * extra)) < abs(miss) GROUP BY 1)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, target,
  CAST(size * (whole + CASE WHEN changed IS NOT DISTINCT FROM rid THEN 1 - extra ELSE extra END) AS BIGINT) AS taken
FROM x LEFT JOIN e ON x.source IS NOT DISTINCT FROM e.source"""


@llm_query("op9_pareto_mix", MIX_SQL)
def op9_pareto_mix(spark, sf):
    return mixing.mix_documents(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@llm_query("op10_rank_coded_ids")
def op10_rank_coded_ids(spark, sf):
    import public_tokenizers
    return token_store.token_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2).drop("shard")


@llm_query("op11_dominance_packing")
def op11_dominance_packing(spark, sf):
    import public_tokenizers
    return packing.packed_pieces(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


@llm_query("op12_spectrum_slicing")
def op12_spectrum_slicing(spark, sf):
    return whitening.whitened_rows(table(spark, sf, "embeddings"), components=32)


@llm_query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    docs = table(spark, sf, "documents")
    planted = docs.select("doc_id", periodic.repeat_tails(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.run_digests(periodic.collapse_runs(planted, min_length=24, min_exponent=3))
