"""Wall time of the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores,
BENCH_KEYS (comma separated) other keys. The first query runs once to warm up the session; then
each query runs BENCH_RUNS times (default 1) and the median counts. Results go to the no-op sink, so every row is computed and none is collected.
``value`` sums the headline keys; ``queries`` also has the other slow keys. With BENCH_GROWTH set to a folder of a smaller
scale, ``growth`` has the time of each key over that at the smaller scale.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from quire.plans import load
from quire.session import build_session

HEADLINE = [
    "works_term_counts", "works_text_flattened", "explode_multi_level", "child_table_project", "exists_nested",
    "boolean_query_search", "avg_compare_join", "self_join_pairs", "summary_stats", "percentiles", "iqr_outliers",
    "top_n_plus_others", "correlation_matrix", "latest_per_key", "global_index", "trailing_count", "fixed_size_shards",
    "text_stats", "term_counts", "bigrams", "doc_term_matrix", "readability", "sentence_split", "chunk_recursive",
    "chunk_fixed", "spell_ratio", "spell_suggest", "sentiment_lexicon", "entity_mentions", "language_id",
    "dedupe_input", "candidate_pairs", "cluster_pairs", "exact_dup_docs", "near_dup_docs", "knn_exact", "bm25_search",
    "centroid_stats", "stream_first_wins",
]

ALSO = ["hybrid_rrf", "rag_context", "knn_ann", "candidate_pairs_all_kinds", "cluster_refine", "lda_topics", "word2vec_doc_vectors"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k] or HEADLINE + ALSO
    small = os.environ.get("BENCH_GROWTH")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    catalog = load()
    spark = build_session("bench", cores, int(cores))
    spark.sparkContext.setLogLevel("ERROR")

    def once(key: str, folder: str = sf_dir) -> float:
        start = time.perf_counter()
        catalog[key].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once(keys[0])
    times = {key: round(statistics.median(once(key) for _ in range(runs)), 3) for key in keys}
    found = re.search(r"sf([0-9.]+)", sf_dir)
    growth = {"growth": {key: round(times[key] / once(key, small), 2) for key in keys}} if small else {}
    value = sum(t for key, t in times.items() if key not in ALSO)
    print(json.dumps({"metric": "headline_total", "value": round(value, 3), "unit": "sec",
                      "queries": times, "sf": float(found.group(1)) if found else sf_dir} | growth))
    spark.stop()


if __name__ == "__main__":
    main()
