"""SimHash near-duplicates with covering locality-sensitive hashing.

A covering family for radius ``r`` gives every bit position a non-zero vector of ``r + 1`` bits; table ``v`` keeps the
positions whose vector has an odd product with ``v``. Any ``r`` differing positions span at most ``r`` dimensions, so
some ``v`` is orthogonal to all of them and the pair agrees in that table: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.components import components
from quire.llm.registry import free_name
from quire.runtime import discard, durable

_ROWS = 1 << 15  # shingles whose bits are unpacked at once


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per bit of the last axis' bytes, 1 if set in over half of the rows, as packed bytes (lowest bit first).

    ``hashes`` is a (rows, bytes) array; no rows give zeros.
    """
    total = np.zeros(8 * hashes.shape[1], dtype=np.int64)
    for at in range(0, len(hashes), _ROWS):
        bits = np.unpackbits(hashes[at:at + _ROWS], axis=1, bitorder="little")
        for b in range(0, len(bits), 255):  # 255 rows at a time fit in a byte per bit
            total += bits[b:b + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little")


def text_fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a whole text over the XXH64 of its space-joined word shingles, as a signed integer."""
    tokens = (text or "").encode().translate(W.LOWER_BYTES).split()  # the white space of bytes.split is 0x20, 0x09-0x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle_words, len(tokens))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:len(tokens) - k + 1].tolist(), ends[k - 1:].tolist())], dtype="<u8")
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the signed 64-bit fingerprint of the whole text, 0 for null or no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([text_fingerprint(t.as_py(), shingle_words, seed) for t in part.column(1)], pa.int64())],
                names=["doc_id", "fp"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """The bit masks of a covering family over the given positions: ``2 ** (radius + 1) - 1`` of them."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(len(positions))]
    return [sum(1 << p for p, a in zip(positions, vectors) if (a & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks(radii: list[int], bits: int) -> list[list[int]]:
    """The covering masks of each part's radius; radius 0 is the one mask of all bits."""
    return [covering_masks(list(range(bits)), r) for r in radii]


def _bucket_rows(nodes: DataFrame, masks: list[list[int]]) -> DataFrame:
    """(bucket, part, mask, id): each node under every mask of every part of its signature."""
    most = max(map(len, masks))
    # a bucket is a 64-bit hash of part, mask and masked value; two that fall together only add tests
    entries = [F.struct(F.xxhash64(F.lit(p * most + t), F.col("sigs")[p].bitwiseAND(F.lit(signed(m)))).alias("bucket"), F.lit(p).alias("part"), F.lit(t).alias("mask"))
               for p, several in enumerate(masks) for t, m in enumerate(several)]
    carried = [c for c in nodes.columns if c != "sigs"]
    return nodes.select(*carried, F.explode(F.array(*entries)).alias("e")).select("e.bucket", "e.part", "e.mask", *carried)


def _differing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def covered_components(nodes: DataFrame, radii: list[int], bits: int = 64, wide_radius: int = 0, size_ratio: float = 0.0,
                       confirm: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(id, canon_id) for ids linked to another: components of all pairs within a part's radius in that part that ``confirm`` keeps.

    ``nodes`` is (id, sigs, wide, slack, n, few): distinct ids, arrays of one signature of ``bits`` bits per entry of ``radii``, a
    longer signature (an empty array for none) in which a pair may differ in ``wide_radius`` plus ``slack`` bits, a size (the
    smaller of a pair must reach ``size_ratio`` of the larger), and the set itself as 32-bit hashes where it is small (else an empty
    array), whose pairs must have ``size_ratio`` as their similarity. First every member of a bucket is tested against one of them, the one whose
    buckets hold most members in all: linear, and where many texts were made from one, that one leads and links them. Then, in buckets of over two members that are not one component yet, members of different components
    are tested against each other: the smaller component of a pair is written out member by member and meets the members of the
    larger one in a join that lets only pairs within all bounds leave. Every pair within the radius is thus tested or
    already connected, and a group of many near copies, connected by the first pass, is never expanded into its
    pairs. ``confirm`` gets (id_l, id_r), distinct, and returns those that hold.
    """
    confirm = confirm or (lambda pairs: pairs)
    masks = _masks(radii, bits)
    keys = _bucket_rows(nodes.select("id", "sigs"), masks)
    sizes = durable(keys.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "covering-sizes", few=True)
    central = keys.join(sizes, "bucket").groupBy("id").agg(F.sum("size").alias("weight"))  # ids that share no bucket end here
    central = durable(nodes.select("id", "sigs").join(central, "id"), "covering-central")
    keys = _bucket_rows(central, masks)
    lead = keys.groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "id"))["id"].alias("lead"), F.count("*").alias("n")).where("n > 1")
    lead = durable(lead, "covering-leads", few=True)  # so that the join deals both sides itself and can split a hot bucket
    keys = keys.drop("weight")
    met = durable(keys.join(lead, "bucket"), "covering-buckets")
    pairs = met.where("id <> lead").select(F.least("lead", "id").alias("id_l"), F.greatest("lead", "id").alias("id_r")).distinct()

    def alike(a: str, b: str) -> Column:
        return ((F.least(f"{a}.n", f"{b}.n") >= size_ratio * F.greatest(f"{a}.n", f"{b}.n"))
                & (_differing(f"{a}.wide", f"{b}.wide") <= wide_radius + F.greatest(f"{a}.slack", f"{b}.slack")))

    def alike_in_full(a: str, b: str) -> Column:
        """Sets that travel along are compared themselves; one shared entry is allowed for hashes that fall together."""
        both = (F.size(f"{a}.few") > 0) & (F.size(f"{b}.few") > 0)
        shared = F.size(F.array_intersect(f"{a}.few", f"{b}.few")) + 1
        return alike(a, b) & (~both | (shared * (1 + size_ratio) >= size_ratio * (F.col(f"{a}.n") + F.col(f"{b}.n"))))

    apart = F.zip_with("a.sigs", "b.sigs", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    gap = F.array_min(F.zip_with(apart, F.array(*[F.lit(r) for r in radii]), lambda d, r: d - r))
    slim = nodes.drop("few")
    near = durable(pairs.join(slim.alias("a"), F.col("id_l") == F.col("a.id"))
                   .join(slim.alias("b"), [F.col("id_r") == F.col("b.id"), gap <= 0, alike("a", "b")])
                   .select("id_l", "id_r"), "covering-near", few=True)
    links = durable(confirm(near).select("id_l", "id_r"), "covering-links", few=True)
    groups = components(links)

    # buckets that hold several components, and their members by component; a bucket of two has met already
    placed = met.where("n > 2").select("bucket", "part", "mask", "id").alias("k").join(groups.alias("g"), F.col("k.id") == F.col("g.id"), "left") \
        .select("k.*", F.coalesce("g.canon_id", "k.id").alias("canon_id"))
    open_ = durable(placed, "covering-open")
    discard(sizes, central, met)
    held = durable(open_.groupBy("bucket", "canon_id").agg(F.count("*").alias("m"), F.min("id").alias("id"), F.first("part").alias("part"), F.first("mask").alias("mask")), "covering-components")
    several = durable(held.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket"), "covering-several")
    signed_ = lambda rows: rows.join(nodes, "id").withColumn("sig", F.expr("sigs[part]")).drop("sigs", "part")
    ones = durable(signed_(held.where("m = 1").join(several, "bucket")), "covering-ones", few=True)

    def within(a: str, b: str) -> Column:
        """All bounds hold, and of the masks under which the two agree in this part, this bucket's is the first: a pair is met once a part."""
        xor = F.col(f"{a}.sig").bitwiseXOR(F.col(f"{b}.sig"))
        most = max(masks, key=len)
        first = F.lit(len(most))
        for t in reversed(range(len(most))):
            first = F.when(xor.bitwiseAND(F.lit(signed(most[t]))) == 0, F.lit(t)).otherwise(first)
        return (F.bit_count(xor) <= max(radii)) & (first == F.col(f"{a}.mask")) & alike_in_full(a, b)

    # components of one member each meet directly
    alone = ones.alias("a").join(ones.alias("b"), [F.col("a.bucket") == F.col("b.bucket"), F.col("a.id") < F.col("b.id"), within("a", "b")]) \
        .select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    # of others the smaller one's members meet the larger one's
    some = held.join(several, "bucket").select("bucket", "canon_id", "m")
    size = lambda x: F.struct(f"{x}.m", f"{x}.canon_id")
    facing = durable(some.alias("a").join(some.where("m > 1").alias("b"), [F.col("a.bucket") == F.col("b.bucket"), size("a") < size("b")])
                     .select("a.bucket", F.col("a.canon_id").alias("small"), F.col("b.canon_id").alias("large")), "covering-facing")
    wanted = facing.select("bucket", F.col("small").alias("canon_id")).unionByName(facing.select("bucket", F.col("large").alias("canon_id"))).distinct()
    members = durable(signed_(open_.join(wanted, ["bucket", "canon_id"])), "covering-members", few=True)
    left = facing.alias("p").join(members.alias("m"), [F.col("p.bucket") == F.col("m.bucket"), F.col("p.small") == F.col("m.canon_id")]) \
        .select("p.bucket", "p.large", "m.id", "m.sig", "m.mask", "m.wide", "m.slack", "m.n", "m.few")
    crossed = (left.alias("l").join(members.alias("m"), [F.col("l.bucket") == F.col("m.bucket"), F.col("l.large") == F.col("m.canon_id"), within("l", "m")])
               .select(F.col("l.id").alias("id_a"), F.col("m.id").alias("id_b")))
    crossed = alone.unionByName(crossed).select(F.least("id_a", "id_b").alias("id_l"), F.greatest("id_a", "id_b").alias("id_r")).distinct()
    crossed = durable(crossed.join(near, ["id_l", "id_r"], "left_anti"), "covering-near", few=True)
    more = durable(confirm(crossed).select("id_l", "id_r"), "covering-links", few=True)
    discard(lead, near, open_, held, several, ones, facing, members, crossed)
    if more.isEmpty():
        discard(links, more)
        return groups
    groups = components(links.unionByName(more))
    discard(links, more)
    return groups


def simhash_components(docs: DataFrame, radius: int = 2, shingle_words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Rows whose fingerprints are at most ``radius`` bits apart are linked; ``component_id`` is the smallest doc_id
    reachable. Null and empty texts have fingerprint 0 and are linked like any other; repeated rows are kept; a null id
    takes part in links but is nobody's smallest id unless its component has no other (then null); other columns are
    ignored; an empty table gives no rows. Equal fingerprints are one node, so copies are never paired.
    """
    rows = durable(fingerprints(docs, shingle_words, seed), "fingerprints")
    nodes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    # the fingerprint itself is the node: unique, also where ids repeat or are null
    groups = covered_components(nodes.select(F.col("fp").alias("id"), F.array("fp").alias("sigs"), F.array().cast("array<bigint>").alias("wide"), F.lit(0).alias("slack"), F.lit(1).alias("n"), F.array().cast("array<int>").alias("few")), [radius])
    groups = nodes.alias("n").join(groups.alias("g"), F.col("n.fp") == F.col("g.id"), "left") \
        .select("fp", "least", F.coalesce("canon_id", "fp").alias("canon"))
    least = groups.groupBy("canon").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "canon").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near-duplicate texts: covering SimHash and, for pairs beyond its radius, MinHash bands propose, a long SimHash rules out far pairs, exact shingle sets decide

RADIUS = 2           # of the covering tables of the 64-bit SimHash: 7 masks
PARTS, BAND = 41, 5  # all five minima of a part agree with chance J ** 5, whatever was edited: at 0.8 all 41 parts miss with 1 in 12 million
WIDE = 2048       # bits of a fingerprint of the shingles that are compared in the end
FEW, FEW_SLACK = 64, 0.06  # texts of fewer shingles, whose majorities tie more often, may differ in this share more
EXACT = 192       # shingles up to which a set goes along into the pair joins, 768 bytes
SLACK = 0.04      # added to the share of bits in which sets of the wanted similarity differ (0.152 at 0.8): five times its deviation
SMALL = 200_000   # rows of a list of keys, some 10 MB, up to which it is sent to the tasks; a longer one is joined by shuffle
_MULTIPLIERS = W.mix(np.arange(2001, 2001 + PARTS * BAND, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_WIDE_SALTS = W.mix(np.arange(1001, 1001 + WIDE // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _wide_radius(threshold: float) -> int:
    """Bits of ``WIDE`` in which sets of Jaccard similarity ``threshold`` or more differ, but for 1 in 3 million."""
    share = float(np.arccos(2 * threshold / (1 + threshold))) / np.pi
    return int((share + SLACK) * WIDE)


def _bands(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets, ``PARTS``): a hash of each part's minima of the sets ``values[bounds[i]:bounds[i + 1]]``, none of them empty."""
    out = np.empty((len(bounds) - 1, PARTS), dtype=np.uint64)
    for p in range(PARTS):
        band = np.zeros(len(bounds) - 1, dtype=np.uint64)
        for m in _MULTIPLIERS[p * BAND:(p + 1) * BAND]:
            band = W.mix(band ^ np.minimum.reduceat(values * m, bounds[:-1])) + m
        out[:, p] = band
    return out.view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A 64-bit SimHash and ``PARTS`` band hashes of a text's ``k``-word shingles (none for a text without words), their SimHash of ``WIDE`` bits and their number."""
    for part in W.slices(batches, text=2, size=W.CHUNK_BYTES // 2):
        data, offsets = W.text_bytes(part.column(2), lower=True)
        start, end, first = W.word_bounds(data, offsets)
        grams, bounds = W.shingles(W.word_hashes(data, start, end), first, k)
        counts = np.diff(bounds)
        some = np.flatnonzero(counts)
        sigs = _bands(grams, np.append(bounds[some], len(grams))) if len(some) else np.zeros((0, PARTS), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum((counts > 0) * (1 + PARTS))]).astype(np.int32)
        sets = [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:])]
        wide = [_fingerprint(x, _WIDE_SALTS).view("<i8") for x in sets]
        sigs = np.hstack([np.array([wide[i][:1] for i in some], dtype=np.int64).reshape(-1, 1), sigs])  # 64 of the bits are the short SimHash
        distinct = np.array([len(x) for x in sets], dtype=np.int32)
        few = pa.array([x.astype(np.uint32).view(np.int32) if len(x) <= EXACT else x[:0].astype(np.int32) for x in sets], pa.list_(pa.int32()))
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(sigs.ravel())),
                 pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (WIDE // 64)), pa.array(np.concatenate(wide)))]
        slack = np.where(counts < FEW, int(FEW_SLACK * WIDE), 0).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*part.columns[:2], *lists, pa.array(slack), pa.array(distinct), few], names=["doc_id", "text_key", "sigs", "wide", "slack", "n", "few"])


def _fingerprint(values: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """64 independent bits of each value for each salt, their majority as bytes."""
    total = np.zeros(64 * len(salts), dtype=np.int64)
    rows = _ROWS // len(salts)
    for at in range(0, len(values), rows):
        wide = W.mix(values[at:at + rows, None] ^ salts).view(np.uint8)
        for b in range(0, len(wide), 255):
            total += np.unpackbits(wide[b:b + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(values), bitorder="little")


def _shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches):
        data, offsets = W.text_bytes(part.column(1), lower=True)
        start, end, first = W.word_bounds(data, offsets)
        values, bounds = W.shingles(W.word_hashes(data, start, end), first, k)
        sets = [np.unique(values[a:b]).tobytes() for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "grams"])


def _similar(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for part in batches:
        keep = []
        for x, y in zip(part.column(2), part.column(3)):
            a, b = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
            small, large = min(len(a), len(b)), max(len(a), len(b))
            shared = len(np.intersect1d(a, b, assume_unique=True)) if small >= threshold * large else 0
            keep.append(shared >= threshold * (len(a) + len(b) - shared) and shared > 0)
        yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def near_duplicate_groups(docs: DataFrame, threshold: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, group_id, keeper) for every row: groups of texts connected by near-duplicate links.

    Two texts are linked when the sets of their ``shingle_words``-word shingles (A-Z lower-cased) have a Jaccard similarity
    of ``threshold`` or more. Equal texts are one unit before. Covering SimHash proposes every pair whose 64-bit fingerprints differ in at
    most two bits. Pairs at 0.8 mostly differ in more, so those whose five minima of one of 41 parts agree are proposed too; exact
    sets confirm. A minimum agrees with a chance equal to the similarity itself, so it does not matter whether words were
    replaced or blocks added, cut or replaced: a pair at similarity 0.8 is not proposed with chance 8e-8, a more similar one with less. A SimHash of 2,048 bits of the same
    sets rules out proposals that are too far apart before sets are compared; it takes away a pair at 0.8 with chance 3e-7.
    ``keeper`` is true for one row of each group, that of the smallest doc_id (nulls last, then by text).
    Null and empty texts are equal texts. Rows that repeat id and text cannot be told apart: all carry the flag of the first.
    """
    source = _keyed(docs, id_col, text_col)
    rows = source.mapInArrow(lambda b: W.tidied(_signatures(b, shingle_words)), "doc_id long, text_key string, sigs array<long>, wide array<long>, slack int, n int, few array<int>")
    units = rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs"), F.first("wide").alias("wide"), F.first("slack").alias("slack"), F.first("n").alias("n"), F.first("few").alias("few"))
    # a unit's number comes from the text alone: ids may be null or belong to several texts
    units = durable(units.withColumn("unit", -1 - F.pmod(F.xxhash64("text_key"), F.lit((1 << 62) - 1))), "dedup-units")
    nodes = units.where(F.size("sigs") > 0).select(F.col("unit").alias("id"), "sigs", "wide", "slack", "n", "few")

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("id_l").alias("unit")).unionByName(pairs.select(F.col("id_r").alias("unit"))).distinct()
        wanted = wanted.join(units, "unit").select("unit", "text_key", "least")
        wanted = _checked(durable(wanted, "dedup-wanted", few=True))
        texts = source.alias("s").join(wanted.alias("w"), [F.col("s.text_key") == F.col("w.text_key"), F.col("s.doc_id").eqNullSafe(F.col("w.least"))]) \
            .select("w.unit", "s.text")
        sets = durable(texts.mapInArrow(lambda b: W.tidied(_shingle_sets(b, shingle_words)), "id long, grams binary").dropDuplicates(["id"]), "dedup-sets")
        both = (pairs.join(sets.select(F.col("id").alias("id_l"), F.col("grams").alias("grams_l")), "id_l")
                .join(sets.select(F.col("id").alias("id_r"), F.col("grams").alias("grams_r")), "id_r").select("id_l", "id_r", "grams_l", "grams_r"))
        return both.mapInArrow(lambda b: W.tidied(_similar(b, threshold)), "id_l long, id_r long")

    groups = covered_components(nodes, [RADIUS] + PARTS * [0], 64, _wide_radius(threshold), threshold, confirm)
    named = units.alias("u").join(groups.alias("g"), F.col("u.unit") == F.col("g.id"), "left") \
        .select("text_key", "least", F.coalesce("canon_id", "unit").alias("group_id"))
    first = named.groupBy("group_id").agg(F.min(F.struct(F.col("least").isNull().alias("no"), "least", "text_key")).alias("first"))
    marked = named.join(first, "group_id").select("text_key", "least", "group_id", (F.col("text_key") == F.col("first.text_key")).alias("one"))
    return source.select("doc_id", "text_key").alias("s").join(marked.alias("m"), F.col("s.text_key") == F.col("m.text_key")).select(
        "s.doc_id", "s.text_key", "group_id", (F.col("one") & F.col("s.doc_id").eqNullSafe(F.col("least"))).alias("keeper"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text.cast("binary")).alias("text_key"), text.alias("text"))


def _checked(keys: DataFrame) -> DataFrame:
    """``keys`` to be broadcast if they are few enough, else as they are."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their near-duplicate group: one row of each group, with all its columns.

    Of rows that repeat id and text any one stays. An empty table gives an empty table. What goes is listed, and a
    list that is short enough is sent to the tasks, so that the texts need not be shuffled.
    """
    groups = durable(near_duplicate_groups(docs, threshold, shingle_words, id_col, text_col), "dedup-groups", few=True)
    key = free_name(docs, "text_key")
    marked = docs.withColumn(key, F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    listed = [F.col(f"d.{key}") == F.col("g.text_key"), F.col(f"d.{id_col}").cast("long").eqNullSafe(F.col("g.doc_id"))]
    gone = _checked(groups.where("not keeper").select("doc_id", "text_key").distinct())
    left = marked.alias("d").join(gone.alias("g"), listed, "left_anti")
    again = groups.where("keeper").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key")
    if not again.isEmpty():
        again = _checked(durable(again, "dedup-again"))
        first = left.alias("d").join(again.alias("g"), listed, "left_semi").dropDuplicates([key, id_col])
        left = left.alias("d").join(again.alias("g"), listed, "left_anti").unionByName(first)
    return left.select(docs.columns)
