"""Word vectors by skip-gram with hierarchical softmax, trained by tasks on blocks of text.

A block holds whole records of some ``BLOCK_TOKENS`` tokens, and its task only the vectors of the words and tree nodes that these meet. Every block starts
from the same vectors, which follow from the words, and a word's vector is the mean over the blocks, weighted by its steps there. Neither the vocabulary nor
the vectors ever lie in one process; the driver sees how many words have which count, from which the Huffman tree follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import discard, durable

BLOCK_TOKENS = 1 << 21  # the more, the fewer blocks that a word's vector is sent from and to
SENTENCE = 1000         # known words after which a text is cut; windows do not reach over a cut
WINDOW = 5
RATE = 0.025
STEP = 16               # words stepped at once: more of them move the tree's upper nodes too far
LARGEST = 6.0           # products beyond it are learnt already
MERGE_BYTES = 16 << 20  # vectors averaged by one task at once
DEALS = 64              # in which words of one count are numbered

_BLOCKS = "block long, rows array<long>, lengths binary, numbers binary, words array<string>, counts array<long>"


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        rows, texts, lengths, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays(texts).dictionary_encode()
            numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype("<i4")
            counts = np.bincount(numbers[numbers >= 0], minlength=len(coded.dictionary))
            return pa.RecordBatch.from_arrays([
                pa.array([part << 32 | made], pa.int64()), pa.array([np.concatenate(rows)], pa.list_(pa.int64())), pa.array([np.concatenate(lengths).astype("<i4").tobytes()], pa.binary()),
                pa.array([numbers.tobytes()], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), coded.dictionary),
                pa.array([counts], pa.list_(pa.int64()))], names=["block", "rows", "lengths", "numbers", "words", "counts"])

        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends, at = np.cumsum(sizes, dtype=np.int64), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + block_tokens - held, "right")))
                rows.append(batch.column(0)[at:end].to_numpy())
                texts.append(batch.column(1)[at:end].flatten())
                lengths.append(sizes[at:end])
                held, at = held + int(sizes[at:end].sum()), end
                if held >= block_tokens or at < batch.num_rows:
                    yield flush()
                    made, rows, texts, lengths, held = made + 1, [], [], [], 0
        if rows:
            yield flush()
    return run


def token_blocks(df: DataFrame, row: str, tokens: str, partitions: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """All records in blocks of at most ``block_tokens`` tokens, or one record: their words, and their tokens as numbers of these.

    Records are dealt by what they hold (all columns but maps and ``row``, a number), so equal tables give equal blocks.
    """
    total = df.agg(F.sum(F.greatest(F.size(tokens), F.lit(0)).cast("long"))).first()[0] or 0
    parts = max(partitions, -(-5 * total // (4 * block_tokens)))  # a part is somewhat less than a block, else most would make two
    dealt = df.select(row, tokens, F.xxhash64(*[c for c, kind in df.dtypes if c != row and "map<" not in kind]).alias("deal"))
    return durable(dealt.repartition(parts, "deal").sortWithinPartitions("deal", row).select(row, tokens).mapInArrow(_blocks(block_tokens), _BLOCKS), "token-blocks")


def huffman(counts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The Huffman tree of ``words[i]`` words of ``counts[i]`` (ascending), as stretches of places: (first place, origin, base).

    Places number the words by count and then the inner nodes as they are made, the root last. The parent of a place in a
    stretch is at base + (place - origin) // 2, and the bit of that step is (place - origin) % 2.
    """
    leaves = [[int(c), int(a), int(a + n)] for c, n, a in zip(counts, words, np.cumsum(words) - words)]
    nodes: list[list[int]] = []
    made, leaf, node, found = int(words.sum()), 0, 0, []

    def least() -> list[int]:
        nonlocal leaf, node
        while leaf < len(leaves) and leaves[leaf][1] == leaves[leaf][2]:
            leaf += 1
        while node < len(nodes) and nodes[node][1] == nodes[node][2]:
            node += 1
        heads = [*leaves[leaf:leaf + 1], *nodes[node:node + 1]]
        return min(heads, key=lambda x: x[0]) if heads else None

    while True:
        a = least()
        pairs = (a[2] - a[1]) // 2 if a else 0
        if pairs:
            found.append((a[1], a[1], made))
            a[1] += 2 * pairs
            nodes.append([2 * a[0], made, made + pairs])
            made += pairs
            continue
        if a is None:
            break
        place, a[1] = a[1], a[1] + 1
        b = least()
        if b is None:  # the root
            break
        found += [(place, place, made), (b[1], b[1] - 1, made)]
        b[1] += 1
        nodes.append([a[0] + b[0], made, made + 1])
        made += 1
    found = np.array(sorted(found), dtype=np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def paths(places: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray], root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, place of an inner node above it, bit of the step below that node), by word."""
    first, origin, base = tree
    own, at = np.arange(len(places), dtype=np.int32), places.astype(np.int64)
    kind = np.int32 if root < 1 << 31 else np.int64
    out = [(own[:0], at[:0].astype(kind), at[:0].astype(np.int8))]
    while True:
        below = at < root
        own, at = own[below], at[below]
        if not len(own):
            break
        stretch = np.searchsorted(first, at, "right") - 1
        up, bit = np.divmod(at - origin[stretch], 2)
        at = base[stretch] + up
        out.append((own, at.astype(kind), bit.astype(np.int8)))
    own, node, bit = (np.concatenate(x) for x in zip(*out))
    del out
    order = np.argsort(own, kind="stable")
    return own[order], node[order], bit[order]


def start_vectors(keys: np.ndarray, size: int) -> np.ndarray:
    """Even in (-0.5, 0.5) / ``size``, by a hash of the word."""
    out = np.zeros((len(keys), size), dtype=np.float32)
    for i in range(size):
        x = keys.astype(np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = (((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float64) / (1 << 24) - 0.5) / size
    return out


def train(tokens: np.ndarray, sentence: np.ndarray, vectors: np.ndarray, path: tuple[np.ndarray, np.ndarray, np.ndarray], seed) -> np.ndarray:
    """Fit ``vectors`` of the words on a text of word numbers; the number of steps that each word made."""
    own, node, bit = path
    node = np.unique(node, return_inverse=True)[1].astype(np.int32)
    first = np.searchsorted(own, np.arange(len(vectors) + 1))
    up = (1 - bit).astype(np.float32)
    inner = np.zeros((node.max(initial=-1) + 1, vectors.shape[1]), dtype=np.float32)
    times = np.zeros(len(vectors))
    reach = np.random.default_rng(seed).integers(1, WINDOW + 1, len(tokens))
    for p in range(0, len(tokens), STEP):
        q = min(p + STEP, len(tokens))
        lo, hi = max(0, p - WINDOW), min(len(tokens), q + WINDOW)
        away = np.abs(np.arange(lo, hi)[:, None] - np.arange(p, q))
        near = (away <= reach[p:q]) & (away > 0) & (sentence[lo:hi, None] == sentence[p:q])
        words, which = np.unique(tokens[lo:hi], return_inverse=True)
        same = np.zeros((len(words), hi - lo), dtype=np.float32)
        same[which, np.arange(hi - lo)] = 1
        near = same @ near.astype(np.float32)                       # (words around, words stepped)
        begin, end = first[tokens[p:q]], first[tokens[p:q] + 1]
        length = end - begin
        at = np.repeat(end - np.cumsum(length), length) + np.arange(length.sum())
        above, place = np.unique(node[at], return_inverse=True)
        on = np.zeros((2, q - p, len(above)), dtype=np.float32)     # whether a node is above a word, and its wanted answer
        spot = np.repeat(np.arange(q - p), length)
        on[0, spot, place] = 1
        on[1, spot, place] = up[at]
        x, y = vectors[words], inner[above]
        f = x @ y.T
        rate = RATE * max(1e-4, 1 - p / len(tokens))
        g = (near @ on[1] - (near @ on[0]) / (1 + np.exp(-f))) * np.float32(rate)
        g[np.abs(f) >= LARGEST] = 0
        vectors[words] = x + g @ y
        inner[above] = y + g.T @ x
        times[words] += near.sum(axis=1)
    return times


def vocabulary(blocks: DataFrame, min_count: int, seed: int) -> tuple[DataFrame, tuple, int]:
    """(word, place, key) of the words that occur ``min_count`` times, the tree above them, and its root's place."""
    spark = blocks.sparkSession
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    counted = each.where(F.col("n") >= min_count).withColumn("key", F.xxhash64("word", F.lit(seed)))
    counted = durable(counted.withColumn("deal", F.pmod("key", F.lit(DEALS))), "word-counts")
    # at most as many counts as the square root of twice the tokens, DEALS times each
    tally = counted.groupBy("n", "deal").agg(F.count("*").alias("words")).orderBy("n", "deal").toArrow()
    if not tally.num_rows:
        raise ValueError(f"no token occurs {min_count} times")
    words = tally.column("words").to_numpy()
    counts, at = np.unique(tally.column("n").to_numpy(), return_index=True)
    before = spark.createDataFrame(tally.select(["n", "deal"]).append_column("before", pa.array(np.cumsum(words) - words)))
    number = F.row_number().over(Window.partitionBy("n", "deal").orderBy("key", "word"))
    placed = counted.select("word", "key", "n", "deal", number.alias("number")).join(F.broadcast(before), ["n", "deal"])
    placed = durable(placed.select("word", (F.col("before") + F.col("number") - 1).alias("place"), "key"), "vocabulary")
    discard(counted)
    return placed, huffman(counts, np.add.reduceat(words, at)), 2 * int(words.sum()) - 2


def _known(block: pa.Table, words: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers, lengths of the records) of a block; numbers are of the rows of ``words``, -1 for the others."""
    numbers, lengths = (np.frombuffer(block.column(c)[0].as_buffer(), "<i4") for c in ("numbers", "lengths"))
    row = np.full(numbers.max(initial=-1) + 2, -1)
    row[words.column("at").to_numpy()] = np.arange(words.num_rows)
    return row[numbers], lengths


def word_vectors(blocks: DataFrame, block_words: DataFrame, tree: tuple, root: int, size: int, seed: int) -> DataFrame:
    """(place, vector) of every word of the vocabulary."""
    spark = blocks.sparkSession
    width = max(1, MERGE_BYTES // (4 * size * max(1, blocks.count())))
    shared = spark.sparkContext.broadcast(tree)

    def fit(block: pa.Table, words: pa.Table) -> pa.Table:
        words = words.sort_by("place")
        out = {"chunk": [], "block": [], "places": [], "vectors": [], "times": []}
        if block.num_rows and words.num_rows:
            number, lengths = _known(block, words)
            record = np.repeat(np.arange(len(lengths)), lengths)[number >= 0]
            number = number[number >= 0]
            within = np.arange(len(record)) - np.searchsorted(record, record)
            sentence = np.cumsum(np.diff(record, prepend=0).astype(bool) | (within % SENTENCE == 0))
            places = words.column("place").to_numpy()
            vectors = start_vectors(words.column("key").to_numpy(), size)
            times = train(number, sentence, vectors, paths(places, shared.value, root), (seed, block.column("block")[0].as_py()))
            chunks, first = np.unique(places // width, return_index=True)
            for chunk, a, b in zip(chunks.tolist(), first.tolist(), [*first[1:].tolist(), len(places)]):
                for c, x in zip(out, (chunk, block.column("block")[0].as_py(), places[a:b].astype("<i8").tobytes(), vectors[a:b].astype("<f4").tobytes(), times[a:b].astype("<f8").tobytes())):
                    out[c].append(x)
        return pa.table(out, schema=pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("vectors", pa.binary()), ("times", pa.binary())]))

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        low = table.column("chunk")[0].as_py() * width
        total, steps, begun = np.zeros((width, size)), np.zeros(width), np.zeros((width, size), dtype=np.float32)
        seen = np.zeros(width, dtype=bool)
        for places, vectors, times in zip(*(table.column(c) for c in ("places", "vectors", "times"))):
            at = np.frombuffer(places.as_buffer(), "<i8") - low
            own, n = np.frombuffer(vectors.as_buffer(), "<f4").reshape(-1, size), np.frombuffer(times.as_buffer(), "<f8")
            total[at] += own * n[:, None]
            steps[at] += n
            begun[at], seen[at] = own, True  # a word without any step has the vector it began with
        at = np.flatnonzero(seen)
        found = np.where(steps[at, None] > 0, total[at] / np.maximum(steps[at, None], 1), begun[at]).astype("<f4")
        return pa.table([pa.array(at + low, pa.int64()), pa.array([v.tobytes() for v in found], pa.binary())], names=["place", "vector"])

    fitted = blocks.select("block", "lengths", "numbers").groupBy("block").cogroup(block_words.groupBy("block")).applyInArrow(
        fit, "chunk long, block long, places binary, vectors binary, times binary")
    return fitted.groupBy("chunk").applyInArrow(mean, "place long, vector binary")


def mean_vectors(blocks: DataFrame, block_words: DataFrame, vectors: DataFrame, size: int, row: str, out: str) -> DataFrame:
    """(row, out): the sum of the vectors of a record's words over the number of its tokens; zeros without tokens."""
    def mean(block: pa.Table, words: pa.Table) -> pa.Table:
        number, lengths = _known(block, words)
        own = np.zeros((words.num_rows + 1, size), dtype=np.float32)  # the last one is that of unknown words
        for i, v in enumerate(words.column("vector")):
            own[i] = np.frombuffer(v.as_buffer(), "<f4")
        total = np.zeros((len(lengths), size))
        record = np.repeat(np.arange(len(lengths)), lengths)
        for a in range(0, len(number), 1 << 15):
            records, first = np.unique(record[a:a + (1 << 15)], return_index=True)
            total[records] += np.add.reduceat(own[number[a:a + (1 << 15)]], first, axis=0, dtype=np.float64)
        found = (total / np.maximum(lengths, 1)[:, None]).astype(np.float32)
        return pa.table([block.column("rows").combine_chunks().flatten(), pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), size).cast(pa.list_(pa.float32()))], names=[row, out])

    placed = block_words.join(vectors, "place").select("block", "at", "vector")
    return blocks.select("block", "rows", "lengths", "numbers").groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(mean, f"`{row}` long, `{out}` array<float>")


def fit_mean_vectors(df: DataFrame, row: str, tokens: str, size: int, min_count: int, seed: int, partitions: int, out: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(row, out): the mean word vector of each record, by vectors trained on all records."""
    blocks = token_blocks(df, row, tokens, partitions, block_tokens)
    words, tree, root = vocabulary(blocks, min_count, seed)
    block_words = blocks.select("block", F.posexplode("words").alias("at", "word")).join(words, "word").select("block", "at", "place", "key")
    block_words = durable(block_words, "block-words")
    discard(words)
    vectors = durable(word_vectors(blocks, block_words, tree, root, size, seed), "word-vectors")
    found = durable(mean_vectors(blocks, block_words, vectors, size, row, out), "mean-vectors")
    discard(blocks, block_words, vectors)
    return found
