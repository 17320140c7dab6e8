"""Toxicity by a convolutional text classifier, trained in numpy by tasks whose parameters are averaged.

Words and their beginnings are hashed into an embedding table, a word's embedding is the sum of its entries; filters
of one, two and three words slide over a text, each is max-pooled over the whole text, and a logistic layer scores the pools. Languages differ in how scores are spread, so thresholds
are calibrated per language on rows kept out of training; scores never see a language.

All labelled rows are fitted on, whole. They are dealt to blocks by a hash and written once as word numbers. In a round each
block's task goes on from the common parameters for some epochs; the filters and the output layer become the mean over the
blocks, an embedding moves by the mean change of the blocks that met its feature. Through the driver go the vocabulary and
the parameters, both bounded by the constants below, and the thresholds.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.registry import free_name
from quire.runtime import discard, durable

BUCKETS = 1 << 20       # values of the feature hash; 0 stands for none
PREFIXES = (4, 5, 6, 7, 8)  # bytes of the beginnings of longer words that are features beside the whole word
WIDTH = 1 + len(PREFIXES)
SIZE = 16               # length of an embedding
FILTERS = {1: 12, 2: 8, 3: 8}
MAX_FEATURES = 60_000   # features with an embedding at most, the most frequent
LEAST_TEXTS = 4         # fitting texts a feature must occur in
BLOCK_BYTES = 16 << 20  # bytes of labelled text that one task fits on
EPOCHS = 8
ROUNDS = 4              # averages of the blocks' parameters; the epochs are spread over them
SLICE = 1 << 19         # bytes of text hashed at once: the temporaries are some forty times as large
MERGED = 1024           # embeddings averaged by one task at once
SMALL = 200_000         # labelled documents, some 10 MB, up to which their ids are sent to the tasks; a longer list is joined by shuffle
BATCH = 64
DROP = 0.25             # share of distinct words, and of pools, left out of a fitting step

_BREAK = np.zeros(256, dtype=bool)  # white space, controls and ASCII punctuation part words here
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True


@dataclass
class Network:
    """Row of each feature (0: none), embeddings, filters per width, their biases, and the output layer."""

    row: np.ndarray
    embed: np.ndarray
    filters: dict[int, np.ndarray]   # width -> (width, SIZE, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float

    def tables(self) -> dict[int, np.ndarray]:
        """Per width, (rows, width, filters): what each feature adds at each place under each filter."""
        return {w: np.einsum("be,wef->bwf", self.embed, f).astype(np.float32) for w, f in self.filters.items()}


def hashed_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): (words, WIDTH) feature hashes of whole texts (A-Z lower-cased), and the first word of each text.

    The whole word comes first, then its beginnings where it is longer than they are.
    """
    data, offsets = W.text_bytes(col, lower=True)
    start, end, first = W.word_bounds(data, offsets, _BREAK)
    out = np.zeros((len(start), WIDTH), dtype=np.int32)
    for i, size in enumerate((None, *PREFIXES)):
        use = slice(None) if size is None else np.flatnonzero(end - start > size)
        stop = end if size is None else start[use] + size
        hashes = W.mix(W.word_hashes(data, start[use], stop) + np.uint64(i > 0))
        out[use, i] = 1 + (hashes % np.uint64(BUCKETS - 1)).astype(np.int32)
    return out, first


def _padded(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers with two padding words (the last number) behind each text, so that a filter never reaches into the next."""
    counts = np.diff(first)
    starts = np.concatenate([[0], np.cumsum(counts + 2)])
    out = np.full(starts[-1], words.max(initial=-1) + 1, dtype=np.int64)
    out[np.arange(len(words)) + 2 * np.repeat(np.arange(len(counts)), counts)] = words
    return out, starts[:-1], counts + 2


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, number of each row), with a padding row of zeros behind."""
    key = np.zeros(len(rows), dtype=np.uint64)
    for i in range(rows.shape[1]):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += rows[:, i].astype(np.uint64)
    key = W.mix(key)
    _, at, number = np.unique(key, return_index=True, return_inverse=True)
    return np.concatenate([rows[at], np.zeros((1, WIDTH), rows.dtype)]), number


def _pools(tables: dict[int, np.ndarray], bias: dict[int, np.ndarray], rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, filters): each filter's largest response over the whole text."""
    own, number = _distinct(rows)
    place, starts, _ = _padded(number, first)
    out = []
    for w, table in tables.items():
        parts = table[own[:, 0]]
        for i in range(1, WIDTH):
            parts = parts + table[own[:, i]]
        response = parts[:, 0][place]
        for j in range(1, w):
            response[:-j] += parts[:, j][place[j:]]
        out.append(np.maximum.reduceat(response, starts, axis=0) + bias[w])
    return np.maximum(np.concatenate(out, axis=1), 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, name, value: np.ndarray, grad: np.ndarray) -> None:
        m = self.m.setdefault(name, np.zeros_like(value))
        v = self.v.setdefault(name, np.zeros_like(value))
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= self.rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


class _Fit:
    """A network being fitted: its parameters and the state of their steps."""

    def __init__(self, seen_in: np.ndarray, seed: int):
        """The random start. ``seen_in`` has the number of fitting texts of each feature."""
        rng = np.random.default_rng(seed)
        often = np.argsort(-seen_in, kind="stable")[:MAX_FEATURES]
        often = often[seen_in[often] >= LEAST_TEXTS]
        row = np.zeros(BUCKETS, dtype=np.int32)
        row[often] = np.arange(1, len(often) + 1)
        self.net = Network(row, rng.normal(0, 0.1, (len(often) + 1, SIZE)).astype(np.float32),
                           {w: rng.normal(0, (w * SIZE) ** -0.5, (w, SIZE, n)).astype(np.float32) for w, n in FILTERS.items()},
                           {w: np.zeros(n) for w, n in FILTERS.items()}, rng.normal(0, 0.3, sum(FILTERS.values())), 0.0)
        self.net.embed[0] = 0
        self.adam, self.out_bias, self.moved = _Adam(0.005), np.zeros(1), np.zeros(len(self.net.embed))

    def _named(self) -> list[tuple]:
        net = self.net
        return [*((("f", w), f) for w, f in net.filters.items()), *((("b", w), b) for w, b in net.bias.items()), ("out", net.out), ("bias", self.out_bias)]

    def head(self) -> np.ndarray:
        """Everything but the embeddings: number of steps, then values and both averages of the steps of filters and output layer."""
        parts = [np.array([float(self.adam.t)])]
        for name, value in self._named():
            parts += [value.ravel(), *(state.get(name, np.zeros(value.shape)).ravel() for state in (self.adam.m, self.adam.v))]
        return np.concatenate(parts).astype(np.float64)

    def set_head(self, head: np.ndarray) -> None:
        self.adam.t, at = float(head[0]), 1
        for name, value in self._named():
            own = head[at:at + 3 * value.size].reshape(3, *value.shape)
            at += 3 * value.size
            value[...] = own[0]
            self.adam.m[name], self.adam.v[name] = own[1].astype(value.dtype), own[2].astype(value.dtype)

    def epochs(self, known: np.ndarray, numbers: np.ndarray, lengths: np.ndarray, labels: np.ndarray, share: float, epochs: int, seed) -> None:
        """Go on for some epochs. A text is an array of numbers into the distinct words ``known``, which are rows of the embeddings.

        The rarer label weighs as much as the other, by the ``share`` of label 1. Max-pooling passes a gradient to one place per filter.
        """
        net, adam, out_bias, moved, rng = self.net, self.adam, self.out_bias, self.moved, np.random.default_rng(seed)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        numbers = np.split(numbers, np.cumsum(lengths)[:-1]) if len(lengths) else []
        for _ in range(epochs if len(lengths) else 0):
            for batch in np.array_split(rng.permutation(len(lengths)), -(-len(lengths) // BATCH)):
                own, number = np.unique(np.concatenate([numbers[i] for i in batch]), return_inverse=True)
                words = np.concatenate([known[own], np.zeros((1, WIDTH), known.dtype)])
                words[rng.random(len(words)) < DROP] = 0
                place, starts, counts = _padded(number, np.concatenate([[0], np.cumsum(lengths[batch])]))
                vectors = net.embed[words[:, 0]]
                for i in range(1, WIDTH):
                    vectors += net.embed[words[:, i]]
                pooled, where = [], {}
                for w, f in net.filters.items():
                    response = (vectors @ f[0])[place]
                    for j in range(1, w):
                        response[:-j] += (vectors @ f[j])[place[j:]]
                    where[w] = np.stack([a + response[a:a + c].argmax(axis=0) for a, c in zip(starts, counts)])
                    pooled.append(response[where[w], np.arange(f.shape[2])] + net.bias[w])
                pre = np.concatenate(pooled, axis=1)
                kept = (rng.random(pre.shape) >= DROP) / (1 - DROP)
                hidden = np.maximum(pre, 0) * kept
                score = _sigmoid(hidden @ net.out + out_bias[0])
                err = (score - labels[batch]) * weight[batch] / len(batch)
                back = np.outer(err, net.out) * (pre > 0) * kept
                adam.t += 1
                grad, at = np.zeros_like(vectors), 0
                for w, f in net.filters.items():
                    g = back[:, at:at + f.shape[2]]
                    at += f.shape[2]
                    grad_f = np.zeros_like(f)
                    for j in range(w):
                        spot = place[np.minimum(where[w] + j, len(place) - 1)]       # (texts, filters)
                        grad_f[j] = np.einsum("tfe,tf->ef", vectors[spot], g)
                        np.add.at(grad, spot, g[:, :, None] * f[j].T[None])
                    adam.step(("f", w), f, grad_f)
                    adam.step(("b", w), net.bias[w], g.sum(axis=0))
                adam.step("out", net.out, hidden.T @ err + 1e-3 * net.out)
                adam.step("bias", out_bias, np.array([err.sum()]))
                # embeddings change where a word was met: adaptive steps by row
                touched = np.flatnonzero(np.abs(grad).sum(axis=1))
                rows, spread = np.unique(words[touched], return_inverse=True)
                total = np.zeros((len(rows), SIZE))
                np.add.at(total, spread.reshape(len(touched), WIDTH), grad[touched][:, None, :])
                moved[rows] += (total * total).mean(axis=1)
                net.embed[rows] -= 0.05 * total / (np.sqrt(moved[rows]) + 1e-8)[:, None]
                net.embed[0] = 0
        net.out_bias = float(out_bias[0])


def _share(toxic: float, rows: int) -> float:
    return float(np.clip(toxic / rows if rows else 0.5, 1e-3, 1 - 1e-3))


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 7, epochs: int = EPOCHS) -> Network:
    """Fit the network on feature hashes of texts that one process holds."""
    seen_in = np.zeros(BUCKETS, dtype=np.int32)
    for t in texts:
        seen_in[np.unique(t)] += 1
    seen_in[0] = 0
    fit = _Fit(seen_in, seed)
    known, numbers = _distinct(np.concatenate(texts) if len(texts) else np.zeros((0, WIDTH), np.int32))
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    fit.epochs(fit.net.row[known], numbers, lengths, labels, _share(labels.sum(), len(labels)), epochs, seed)
    return fit.net


_BLOCKS = "part int, toxic binary, langs array<string>, lengths binary, known binary, numbers binary"


def _block(table: pa.Table) -> pa.Table:
    """One row of a group of labelled texts, in an order that is always the same: its words as numbers into its distinct words."""
    table = table.sort_by([("draw", "ascending"), ("lang", "ascending")])
    known, numbers, lengths, held = [], [], [], 0
    for batch in W.slices(iter(table.select(["draw", "text"]).to_batches()), size=SLICE):
        features, first = hashed_words(batch.column(1))
        own, number = _distinct(features)
        known.append(own[:-1])
        numbers.append(number + held)
        lengths.append(np.diff(first))
        held += len(own) - 1
    own, number = _distinct(np.concatenate(known))
    numbers = number[np.concatenate(numbers)]
    column = lambda x, kind: pa.array([np.asarray(x).astype(kind).tobytes()], pa.binary())
    return pa.table([table.column("part")[:1].cast(pa.int32()), column(table.column("toxic"), "u1"), pa.array([table.column("lang").to_pylist()], pa.list_(pa.string())),
                     column(np.concatenate(lengths), "<i8"), column(own[:-1], "<i4"), column(numbers, "<i4")], names=["part", "toxic", "langs", "lengths", "known", "numbers"])


def _texts(row: dict, for_net: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, word numbers, lengths, places) of a block's texts that fit the network, four of five, or of those that fit the thresholds."""
    lengths, numbers = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["numbers"], "<i4")
    use = (np.arange(len(lengths)) % 5 != 0) == for_net
    return np.frombuffer(row["known"], "<i4").reshape(-1, WIDTH), numbers[np.repeat(use, lengths)], lengths[use], np.flatnonzero(use)


def _view(col: pa.Array, i: int) -> pa.Buffer:
    """A binary value as a part of its column: a copy would hold a block's words twice."""
    a, b = np.frombuffer(col.buffers()[1], "<i4")[col.offset + i:col.offset + i + 2].tolist()
    return col.buffers()[2].slice(a, b - a)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: _view(c, i) if pa.types.is_binary(c.type) else c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)}


def _some(lengths: np.ndarray, words: int = 1 << 17) -> Iterator[tuple[slice, np.ndarray]]:
    """Texts of these lengths cut into stretches of at most ``words`` words, or one text: (place of their words, first word of each there and the end)."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(first, first[at] + words, "right")) - 1)
        yield slice(first[at], first[end]), first[at:end + 1] - first[at]
        at = end


def training_blocks(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All labelled rows, whole, in blocks of some ``block_bytes`` of text (or one text): labels, languages, and words as numbers.

    Rows whose crc32 of the id modulo 5 is 0 are never among them, nor rows without an id. Conflicting labels of a document count as toxic.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marked = durable(marked, "labelled")
    few = F.broadcast(marked) if marked.count() <= SMALL else marked
    size = docs.select("doc_id", F.octet_length("text").alias("bytes")).join(few, "doc_id").agg(F.sum("bytes").alias("n")).first()["n"]
    parts = max(1, -(-(size or 0) // block_bytes))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang").join(few, "doc_id")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("draw"), "text", "lang", "toxic").withColumn("part", F.pmod("draw", F.lit(parts)).cast("int"))
    blocks = durable(rows.groupBy("part").applyInArrow(_block, _BLOCKS), "labelled-blocks")
    discard(marked)
    return blocks


def _seen_in(blocks: DataFrame) -> tuple[np.ndarray, int, float]:
    """(number of fitting texts of each feature that some have, of fitting texts, share of label 1 among them)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            known, numbers, lengths, places = _texts(row, True)
            total = np.zeros(BUCKETS, dtype=np.int64)
            for some, first in _some(lengths):
                text = np.repeat(np.arange(len(first) - 1), np.diff(first))
                text, word = np.divmod(np.unique(text * len(known) + numbers[some]), max(len(known), 1))
                total += np.bincount(np.unique((text[:, None] * BUCKETS + known[word]).ravel()) % BUCKETS, minlength=BUCKETS)
            features = np.flatnonzero(total)
            n = total[features]
            # feature 0 is none; its place tells the texts, and -1 the toxic ones
            toxic = int(np.frombuffer(row["toxic"], "u1")[places].sum())
            keep = features > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[0, -1], features[keep]]), pa.int64()), pa.array(np.concatenate([[len(lengths), toxic], n[keep]]), pa.int64())],
                                             names=["feature", "n"])

    counts = durable(blocks.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")), "features")
    totals = {r["feature"]: r["n"] for r in counts.where("feature <= 0").collect()}
    often = counts.where((F.col("feature") > 0) & (F.col("n") >= LEAST_TEXTS)).orderBy(F.desc("n"), "feature").limit(MAX_FEATURES).toArrow()
    discard(counts)
    seen_in = np.zeros(BUCKETS, dtype=np.int64)
    seen_in[often["feature"].to_numpy()] = often["n"].to_numpy()
    n = totals.get(0, 0)
    return seen_in, n, _share(totals.get(-1, 0), n)


def _average(table: pa.Table) -> pa.Table:
    """The mean of the blocks' changes to some embeddings, each over the blocks that changed it; or of their heads."""
    table = table.sort_by("part")
    chunk = table.column("chunk")[0].as_py()
    if chunk < 0:
        heads = np.stack([np.frombuffer(x.as_buffer(), "<f8") for x in table.column("change")])
        rows, mean = np.zeros(0, dtype="<i4"), heads.mean(axis=0)
    else:
        total, times = np.zeros((MERGED, SIZE + 1)), np.zeros(MERGED)
        for at, change in zip(table.column("rows"), table.column("change")):
            at = np.frombuffer(at.as_buffer(), "<i4") - chunk * MERGED
            total[at] += np.frombuffer(change.as_buffer(), "<f4").reshape(-1, SIZE + 1)
            times[at] += 1
        rows = np.flatnonzero(times)
        mean = (total[rows] / times[rows, None]).astype("<f4")
        rows = (rows + chunk * MERGED).astype("<i4")
    return pa.table([pa.array([chunk], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([mean.tobytes()], pa.binary())], names=["chunk", "rows", "change"])


def train_blocks(blocks: DataFrame, seed: int = 7, epochs: int = EPOCHS, rounds: int = ROUNDS) -> Network:
    """Fit the network on all blocks; see the head of this module."""
    seen_in, n, share = _seen_in(blocks)
    fit = _Fit(seen_in, seed)
    sc = blocks.sparkSession.sparkContext
    for turn in range(rounds if n else 0):
        shared = sc.broadcast(fit)  # at most 13 MB, by the constants above
        some = epochs * (turn + 1) // rounds - epochs * turn // rounds

        def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                fit = copy.deepcopy(shared.value)
                known, numbers, lengths, places = _texts(row, True)
                if not len(lengths):
                    continue
                embed, moved = fit.net.embed.copy(), fit.moved.copy()
                fit.epochs(fit.net.row[known], numbers, lengths, np.frombuffer(row["toxic"], "u1")[places].astype(float), share, some, (seed, turn, row["part"]))
                rows = np.flatnonzero((fit.moved != moved) | (fit.net.embed != embed).any(axis=1)).astype("<i4")
                change = np.concatenate([fit.net.embed[rows] - embed[rows], (fit.moved[rows] - moved[rows])[:, None]], axis=1).astype("<f4")
                out = [(-1, b"", fit.head().astype("<f8").tobytes())]
                bounds = np.searchsorted(rows, np.arange(0, len(embed) + MERGED, MERGED))
                out += [(c, rows[a:b].tobytes(), change[a:b].tobytes()) for c, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())) if a < b]
                chunks, at, changes = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([row["part"]] * len(out), pa.int32()), pa.array(at, pa.binary()), pa.array(changes, pa.binary())],
                                                 names=["chunk", "part", "rows", "change"])

        changes = blocks.mapInArrow(go_on, "chunk int, part int, rows binary, change binary")
        for r in changes.groupBy("chunk").applyInArrow(_average, "chunk int, rows binary, change binary").collect():
            if r["chunk"] < 0:
                fit.set_head(np.frombuffer(r["change"], "<f8"))
            else:
                rows, change = np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["change"], "<f4").reshape(-1, SIZE + 1)
                fit.net.embed[rows] += change[:, :SIZE]
                fit.moved[rows] += change[:, SIZE]
        shared.destroy()
    fit.net.out_bias = float(fit.out_bias[0])
    return fit.net


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    if not texts:
        return np.zeros(0)
    return _sigmoid(_pools(net.tables(), net.bias, net.row[np.concatenate(texts)], first) @ net.out + net.out_bias)


def _cut(scores: np.ndarray, rows: np.ndarray, toxic: np.ndarray) -> float:
    """Of the cuts between two of these different scores, with their numbers of rows and of toxic ones, whose F1 is the best to within 0.02, that nearest to 0.5."""
    order = np.argsort(-scores, kind="stable")
    s, hit, seen = scores[order], np.cumsum(toxic[order]), np.cumsum(rows[order])
    f1 = 2 * hit / (seen + toxic.sum())
    cuts = (s + np.append(s[1:], 0)) / 2
    good = np.flatnonzero(f1 >= f1.max() - 0.02)
    return float(cuts[good[np.abs(cuts[good] - 0.5).argmin()]])


def calibrate(blocks: DataFrame, net: Network, least: int = 40) -> dict:
    """Threshold per language (key None: all rows), by ``_cut`` on all rows that did not fit the network; their scores count to four decimals.

    A language of fewer than ``least`` rows, or without a toxic one, takes the threshold of all rows; without a toxic row that is 0.5.
    """
    shared = blocks.sparkSession.sparkContext.broadcast((net.row, net.tables(), net.bias, net.out, net.out_bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, tables, bias, out, out_bias = shared.value
        for row in _rows(batches):
            known, numbers, lengths, places = _texts(row, False)
            known, langs, toxic = row_of[known], row["langs"], np.frombuffer(row["toxic"], "u1")
            at = 0
            for some, first in _some(lengths):
                own = places[at:at + len(first) - 1]
                at += len(own)
                scores = _sigmoid(_pools(tables, bias, known[numbers[some]], first) @ out + out_bias)
                yield pa.RecordBatch.from_arrays([pa.array([langs[i] or None for i in own], pa.string()), pa.array(np.round(scores, 4)), pa.array(toxic[own].astype(np.int64))],
                                                 names=["lang", "score", "toxic"])

    def cut(table: pa.Table) -> pa.Table:
        scores, rows, toxic = (table.column(c).to_numpy() for c in ("score", "n", "toxic"))
        lang = table.column("key")[0].as_py()
        found = _cut(scores, rows, toxic) if toxic.any() and (lang is None or rows.sum() >= least) else None
        return pa.table([pa.array([lang], pa.string()), pa.array([found], pa.float64())], names=["lang", "threshold"])

    scored = blocks.mapInArrow(score, "lang string, score double, toxic long").groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    # every language by itself, and all rows under null; at most 10,001 scores in a group
    keys = F.array(F.lit(None).cast("string"), "lang")
    scored = scored.select("*", F.explode(F.when(F.col("lang").isNull(), F.slice(keys, 1, 1)).otherwise(keys)).alias("key"))
    scored = scored.groupBy("key", "score").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    found = {r["lang"]: r["threshold"] for r in scored.groupBy("key").applyInArrow(cut, "lang string, threshold double").collect()}
    return {None: 0.5} | {lang: t for lang, t in found.items() if t is not None}


@dataclass
class Classifier:
    net: Network
    thresholds: dict


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7, block_bytes: int = BLOCK_BYTES) -> Classifier:
    """A classifier from all labelled rows of ``docs``: four of five rows of each block fit the network, the others the thresholds.

    Without labelled rows the network is the random start and thresholds are 0.5.
    """
    blocks = training_blocks(docs, labels, block_bytes)
    net = train_blocks(blocks, seed)
    thresholds = calibrate(blocks, net)
    discard(blocks)
    return Classifier(net, thresholds)


def score_documents(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text", score_col: str = "_score") -> DataFrame:
    """All columns of ``docs`` with ``score_col``, a name that none of them has: the score of every whole text in one narrow pass.

    Null and empty texts score as a text without words; null ids and repeated rows are kept; an empty table gives no rows.
    """
    net = classifier.net
    tables = net.tables()
    # at most 17 MB, by the constants above, whatever the corpus
    shared = docs.sparkSession.sparkContext.broadcast((net.row, tables, net.bias, net.out, net.out_bias))
    names = docs.columns
    at = names.index(text_col)
    schema = docs.select("*").schema.add(score_col, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, tables, bias, out, out_bias = shared.value
        for part in W.slices(batches, text=at, size=SLICE):
            features, first = hashed_words(part.column(at))
            score = _sigmoid(_pools(tables, bias, row[features], first) @ out + out_bias)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*names, score_col])

    return docs.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; ``predicted`` is 1 from a score of 0.5."""
    classifier = fit(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), classifier)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, classifier: Classifier, lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` below the threshold of their language (an unknown or null language: that of all rows), with their own columns whatever their names."""
    score = free_name(docs, "score")
    scored = score_documents(docs, classifier, score_col=score)
    limit = F.lit(classifier.thresholds[None])
    for lang, t in sorted((k, v) for k, v in classifier.thresholds.items() if k is not None):
        limit = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(limit)
    return scored.where(F.col(score) < limit).select(docs.columns)
