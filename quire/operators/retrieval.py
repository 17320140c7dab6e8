"""Keyword ranking and hybrid search where the documents are: narrow passes, only kept rows leave a task.

The terms of a block of queries go to the tasks with, for each term, its weight and who asked for it. A batch of documents is
looked up in that list at once (Arrow), its term counts and scores are sparse numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions import text as X
from quire.runtime import scratch_path

MAX_ASKED = 1_000_000  # (query, term) pairs of a block of queries, some 30 MB
MAX_QUERIES = 1_000    # queries of a block in hybrid search, whose lists of ``c + 2k`` go through the driver
SLICE = 512            # documents scored at once
SCORE_DECIMALS = 9     # scores are compared at this precision, so summation order cannot change a rank


class _Terms:
    """What the tasks need of a block of queries: its sorted terms and, per term, the numbers of the queries that ask for it."""

    def __init__(self, asked: list[tuple[int, str]], n_queries: int):
        self.n = n_queries
        self.terms = sorted({t for _, t in asked})
        number = {t: i for i, t in enumerate(self.terms)}
        pairs = sorted((number[t], q) for q, t in set(asked))
        self.who = np.array([q for _, q in pairs], dtype=np.int64)
        self.many = np.bincount([t for t, _ in pairs], minlength=len(self.terms)).astype(np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.weight = np.zeros(len(self.terms))
        self.mean_len, self.saturation = 1.0, None

    def found(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, frequency) of the asked terms, by document and term, and the lengths of the documents."""
        length = np.asarray(tokens.value_lengths().fill_null(0)).astype(np.int64)
        code = pc.index_in(tokens.flatten(), value_set=pa.array(self.terms, pa.string()))
        hit = np.asarray(code.is_valid())
        doc = np.repeat(np.arange(len(length)), length)[hit]
        keys, frequency = np.unique(doc * max(1, len(self.terms)) + np.asarray(code.drop_null()).astype(np.int64), return_counts=True)
        return keys // max(1, len(self.terms)), keys % max(1, len(self.terms)), frequency, length

    def scores(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, query, score) of every pair that shares a term: BM25, or shared terms without ``saturation``."""
        doc, term, frequency, length = self.found(tokens)
        value = np.ones(len(doc))
        if self.saturation:
            k1, b = self.saturation
            value = self.weight[term] * frequency * (k1 + 1) / (frequency + k1 * (1 - b + b * length[doc] / self.mean_len))
        many = self.many[term]
        at = np.repeat(np.arange(len(doc)), many)
        asked = self.who[self.first[term][at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)]
        pairs, which = np.unique(doc[at] * self.n + asked, return_inverse=True)
        return pairs // self.n, pairs % self.n, np.round(np.bincount(which, value[at], minlength=len(pairs)), SCORE_DECIMALS)


def _order(names: np.ndarray) -> np.ndarray:
    """Numbers that sort as the names do."""
    return names if names.dtype.kind == "i" else np.unique(names, return_inverse=True)[1]


class _Best:
    """The ``k`` best (query, score, name) of each query, by falling score and then by name."""

    def __init__(self, k: int, n_queries: int):
        self.k, self.room, self.held = k, 200_000 + 2 * k * n_queries, []
        self.size = 0

    def add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        self.held.append((query, score, name))
        self.size += len(query)
        if self.size > self.room:
            self.prune()

    def prune(self) -> None:
        if not self.held:
            return
        query, score, name = (np.concatenate(c) for c in zip(*self.held))
        by = np.lexsort((_order(name), -score, query))
        query, score, name = query[by], score[by], name[by]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.held = [(query[keep], score[keep], name[keep])]
        self.size = int(keep.sum())


def _names(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), dtype=object)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _table(columns: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.tolist() if c.dtype == object else c, t) for c, t in zip(columns, types)], names=names)


def _statistics(tokenised: DataFrame, terms: _Terms, saturation: tuple[float, float] | None) -> _Terms:
    """``terms`` with the weights of the corpus: one narrow pass, whose tasks send a number per asked term."""
    terms.saturation = saturation
    if not saturation:
        return terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(len(terms.terms), dtype=np.int64), 0, 0
        for part in _parts(batches):
            _, term, _, length = terms.found(part.column(1))
            df += np.bincount(term, minlength=len(df))
            n, total = n + part.num_rows, total + int(length.sum())
        some = np.flatnonzero(df)
        yield _table([np.append(some, [-1, -2]), np.append(df[some], [n, total])], [pa.int32(), pa.int64()], ["term", "n"])

    seen = {r["term"]: r["n"] for r in tokenised.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = seen.pop(-1, 0), seen.pop(-2, 0)
    df = np.zeros(len(terms.terms))
    df[list(seen)] = list(seen.values())
    terms.weight = np.log(1 + (n - df + 0.5) / (df + 0.5))
    terms.mean_len = max(total, 1) / max(n, 1)
    return terms


def _blocks(queries: DataFrame, min_len: int, max_queries: int) -> Iterator[tuple[list, _Terms, DataFrame]]:
    """(query ids, terms, the block's queries), one block at a time: all that the driver holds of the queries."""
    size = F.size(F.array_distinct(X.tokens("text", min_len)))
    n, asked = queries.agg(F.count("*"), F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0))).first()
    blocks = max(1, -(-n // max_queries), -(-asked // MAX_ASKED))
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else queries
        rows = some.select("query_id", F.array_distinct(X.tokens("text", min_len)).alias("t")).collect()
        ids: dict = {}
        for r in rows:
            ids.setdefault(r["query_id"], len(ids))
        pairs = [(ids[r["query_id"]], t) for r in rows for t in r["t"] or ()]
        yield list(ids), _Terms(pairs, max(1, len(ids))), some


def _each_block(queries: DataFrame, min_len: int, max_queries: int, search: Callable[[list, _Terms, DataFrame], DataFrame]) -> DataFrame:
    """The union of ``search`` over blocks of queries. Several are written one after the other, so that one is alive at a time."""
    found, path = [], None
    for ids, terms, some in _blocks(queries, min_len, max_queries):
        found.append(search(ids, terms, some))
        if len(found) == 2 or path:
            path = path or scratch_path(queries.sparkSession, "search")
            for df in found:
                df.write.mode("append").parquet(path)
                schema = df.schema
            found = []
    return queries.sparkSession.read.schema(schema).parquet(path) if path else found[0]


def _top_by_terms(queries: DataFrame, docs: DataFrame, k: int, min_len: int, saturation: tuple[float, float] | None) -> DataFrame:
    spark = docs.sparkSession
    tokenised = docs.select("doc_id", X.tokens("text", min_len).alias("t"))
    kinds = [queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType, T.DoubleType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(("query_id", "doc_id", "score"), kinds)])
    arrow = [to_arrow_type(t) for t in kinds]

    def search(ids: list, terms: _Terms, _: DataFrame) -> DataFrame:
        shipped = spark.sparkContext.broadcast((np.array(ids), _statistics(tokenised, terms, saturation)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, terms = shipped.value
            best = _Best(k, terms.n)
            for part in _parts(batches):
                doc, query, score = terms.scores(part.column(1))
                best.add(query, score, _names(part.column(0))[doc])
            best.prune()
            for query, score, name in best.held:
                yield _table([names[query], name, score], arrow, ["query_id", "doc_id", "score"])

        return tokenised.mapInArrow(run, schema)

    found = _each_block(queries, min_len, 1 << 40, search)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_search(queries: DataFrame, docs: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, min_len: int = 2) -> DataFrame:
    """(query_id, doc_id, score, rank): keyword ranking of ``docs(doc_id, text)`` for ``queries(query_id, text)``.

    Ties go by doc_id. Each task keeps ``k`` rows per query, so tasks x queries x k rows are shuffled, whatever the number of matches.
    """
    return _top_by_terms(queries, docs, k, min_len, (k1, b))


def shared_term_search(queries: DataFrame, docs: DataFrame, k: int, min_len: int = 2) -> DataFrame:
    """(query_id, doc_id, score, rank): ranking by the number of distinct terms a document shares with the query."""
    return _top_by_terms(queries, docs, k, min_len, None)


def fuse_ranks(a: DataFrame, b: DataFrame, k: int, c: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): two given lists fused by the sum of 1 / (c + rank)."""
    both = a.select("query_id", "doc_id", "rank").unionByName(b.select("query_id", "doc_id", "rank"))
    fused = both.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (F.lit(c) + F.col("rank"))), 12).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- hybrid search

def _ahead(query: np.ndarray, score: np.ndarray, name: np.ndarray, asked: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each asked (query, score, name), how many of the scored rows of its query rank before it."""
    n = len(query)
    names = np.concatenate([name, asked[2]])
    q, s = np.concatenate([query, asked[0]]), np.concatenate([score, asked[1]])
    real = np.arange(len(q)) < n
    by = np.lexsort((real, _order(names), -s, q))  # an asked row comes before the row it stands for
    seen = np.cumsum(real[by])
    q = q[by]
    first = np.searchsorted(q, q)
    before = seen - np.where(first > 0, seen[first - 1], 0)
    out = np.zeros(len(asked[0]), dtype=np.int64)
    out[by[~real[by]] - n] = before[~real[by]]
    return out


def hybrid_rrf(queries: DataFrame, docs: DataFrame, k: int, c: int = 60, k1: float = 1.2, b: float = 0.75, min_len: int = 2) -> DataFrame:
    """(query_id, doc_id, score, rank): the full BM25 list and the full vector list of each query, fused by the sum of 1 / (c + rank).

    ``queries`` is (query_id, text, vector), ``docs`` (doc_id, text, vector); a document without a shared term has no rank in
    the keyword list, one without a vector none in the other. This is a threshold algorithm. Sorted access: the ``k`` best of one
    list score at least ``1 / (c + k)`` each, and what is in neither list down to depth ``d`` scores at most ``2 / (c + d + 1)``; at ``d = c + 2k``
    that is less, so no document below both lists can be among the best, and the fusion is that of the full lists. Random access:
    a document seen in one list only is looked up in the other, first its score, then how many documents rank before it.
    Three narrow passes over the documents after the one for the statistics; only lists of that depth and counts leave the tasks.
    Ties go by doc_id, in each list and in the end. Queries are taken in blocks of ``MAX_QUERIES``.
    """
    spark, depth = docs.sparkSession, c + 2 * k
    corpus = docs.select("doc_id", X.tokens("text", min_len).alias("t"), F.col("vector").cast("array<double>").alias("v"))
    q_type, d_type = queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType
    d_arrow = to_arrow_type(d_type)
    kinds = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("query", T.IntegerType()), T.StructField("doc_id", d_type), T.StructField("score", T.DoubleType())])

    def search(ids: list, terms: _Terms, some: DataFrame) -> DataFrame:
        vectors = {r["query_id"]: r["v"] for r in some.select("query_id", F.col("vector").cast("array<double>").alias("v")).collect()}
        with_vector = [i for i, name in enumerate(ids) if vectors[name] and None not in vectors[name]]
        matrix = np.array([vectors[ids[i]] for i in with_vector], dtype=np.float64)
        shipped = spark.sparkContext.broadcast((_statistics(corpus.select("doc_id", "t"), terms, (k1, b)), np.array(with_vector, dtype=np.int64), matrix))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list]]:
            """(names, [keyword (query, score, row), vector (query, score, row)]) of a slice of documents."""
            terms, numbers, matrix = shipped.value
            for part in _parts(batches):
                doc, query, score = terms.scores(part.column(1))
                rows = [i for i, v in enumerate(part.column(2)) if v.is_valid and len(v) and not v.values.null_count] if len(numbers) else []
                near = np.zeros((len(numbers), 0))
                if rows:
                    held = part.column(2).take(pa.array(rows))
                    near = np.round(matrix @ np.asarray(held.flatten()).reshape(len(rows), -1).T, SCORE_DECIMALS)
                yield _names(part.column(0)), [(query, score, doc), (np.repeat(numbers, len(rows)), near.ravel(), np.tile(np.array(rows, dtype=np.int64), len(numbers)))]

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [_Best(depth, terms.n), _Best(depth, terms.n)]
            for names, lists in scored(batches):
                for held, (query, score, row) in zip(best, lists):
                    held.add(query, score, names[row])
            for n, held in enumerate(best):
                held.prune()
                for query, score, name in held.held:
                    yield _table([np.full(len(query), n), query, name, score], [pa.int32(), pa.int32(), d_arrow, pa.float64()], ["list", "query", "doc_id", "score"])

        w = Window.partitionBy("list", "query").orderBy(F.desc("score"), "doc_id")
        lists = corpus.mapInArrow(top, kinds).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)
        ranks: dict = {}
        for r in lists.select("list", "query", "doc_id", "rank").collect():  # at most two lists of the depth per query
            ranks.setdefault((r["query"], r["doc_id"]), [None, None])[r["list"]] = r["rank"]

        # what is seen in one list and could still reach the k-th of the scores known so far is looked up in the other
        value = lambda rank: 1.0 / (c + rank) if rank else 0.0
        floor = {}
        for (q, _), (x, y) in ranks.items():
            floor.setdefault(q, []).append(value(x) + value(y))
        floor = {q: sorted(s)[-k] if len(s) >= k else 0.0 for q, s in floor.items()}
        wanted: list[dict] = [{}, {}]
        for (q, d), (x, y) in ranks.items():
            if (x is None or y is None) and value(x) + value(y) + 1.0 / (c + depth + 1) >= floor[q] - 1e-12:
                wanted[0 if x is None else 1].setdefault(d, []).append(q)
        asked = spark.sparkContext.broadcast(wanted)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for names, lists in scored(batches):
                for n, (query, score, row) in enumerate(lists):
                    places = [i for i, name in enumerate(names.tolist()) if name in asked.value[n]]
                    if places:
                        at = np.flatnonzero(np.isin(row, places))
                        keep = [i for i in at.tolist() if int(query[i]) in asked.value[n][names[row[i]]]]
                        if keep:
                            yield _table([np.full(len(keep), n), query[keep], names[row[keep]], score[keep]], [pa.int32(), pa.int32(), d_arrow, pa.float64()], ["list", "query", "doc_id", "score"])

        found = [[], []]
        for r in (corpus.mapInArrow(own, kinds).distinct().collect() if any(wanted) else []):  # at most what was asked
            found[r["list"]].append((r["query"], r["score"], r["doc_id"]))
        columns = []
        for rows in found:
            q, s, d = zip(*rows) if rows else ((), (), ())
            columns.append((np.array(q, dtype=np.int64), np.array(s, dtype=np.float64), np.array(d, dtype=np.int64 if pa.types.is_integer(d_arrow) else object)))
        looked_up = spark.sparkContext.broadcast(columns)

        def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(len(a[0]), dtype=np.int64) for a in looked_up.value]
            for names, lists in scored(batches):
                for n, (query, score, row) in enumerate(lists):
                    if len(total[n]):
                        total[n] += _ahead(query, score, names[row], looked_up.value[n])
            for n, counts in enumerate(total):
                yield _table([np.full(len(counts), n), np.arange(len(counts)), counts], [pa.int32(), pa.int32(), pa.int64()], ["list", "at", "n"])

        if any(found):
            counts = corpus.mapInArrow(ahead, "list int, at int, n long").groupBy("list", "at").agg(F.sum("n").alias("n"))
            for r in counts.collect():
                q, _, d = found[r["list"]][r["at"]]
                ranks[q, d][r["list"]] = r["n"] + 1
        rows = [(ids[q], d, round(value(x) + value(y), 12)) for (q, d), (x, y) in ranks.items() if value(x) + value(y) >= floor[q] - 1e-12]
        return spark.createDataFrame(rows, T.StructType([T.StructField("query_id", q_type), T.StructField("doc_id", d_type), T.StructField("score", T.DoubleType())]))

    fused = _each_block(queries, min_len, MAX_QUERIES, search)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
