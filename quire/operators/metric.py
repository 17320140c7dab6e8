"""Exact similarity join of vectors: pivots, cells and ghosts instead of all pairs.

Unit vectors are dealt to the cell of their nearest pivot. Two vectors with a cosine above ``t`` are less than
``sqrt(2 - 2t)`` apart, so a vector needs to meet another cell only if it is that close to the plane between the two
pivots, and only if the angle to the other pivot is within the cell's range of angles, widened by ``acos(t)``. It goes
there as a ghost, from the cell with the smaller number to the larger only, so each pair meets once. Cells and
their ghosts are cut into blocks of bounded size; a pair of blocks is one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.vectors import l2_normalize
from quire.runtime import discard, durable

PIVOT_SAMPLE = 20_000  # rows, by a hash of their ids, among which pivots are chosen in the driver
MAX_PIVOTS = 512
BLOCK = 2_000          # rows of a block, so that a pair of blocks has a score matrix of 32 MB
GHOSTS = 8_192         # ghost rows made at once
DECIMALS = 12          # scores are compared at this precision, so summation order cannot change a result
_ROOM = 1e-9           # bounds are widened by this, far above the error of a double


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` unit vectors of ``sample``, each the farthest from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < min(count, len(sample)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:  # only copies of pivots are left
            break
        chosen.append(far)
        near = np.maximum(near, sample @ sample[far])
    return sample[chosen]


def equal_vectors(df: DataFrame, id: str, vec: str) -> DataFrame:
    """(id, representative) for every row with a usable vector: the smallest id with the same vector."""
    usable = _usable(df, id, vec)
    first = usable.groupBy("v").agg(F.min("id").alias("rep"))
    return usable.join(first, "v").select(F.col("id").alias(id), F.col("rep").alias(f"{id}_rep"))


def _usable(df: DataFrame, id: str, vec: str) -> DataFrame:
    v = F.col(vec)
    return df.where(F.col(id).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)) \
        .select(F.col(id).alias("id"), v.cast("array<double>").alias("v"))


class MetricJoin:
    """The prepared join: vectors in cells, and how many rows each cell has of its own and as ghosts.

    Through the driver go the sample that pivots are chosen from (``PIVOT_SAMPLE`` rows), the pivots (``MAX_PIVOTS``) and counts per
    cell. Vectors are written with their cells and read from there; replicas of a row number its cell's blocks.
    """

    def __init__(self, df: DataFrame, id: str, vec: str, t: float, pivots: int | None = None):
        if not 0 < t < 1:
            raise ValueError("the threshold is a cosine between 0 and 1")
        self.spark, self.name, self.t = df.sparkSession, id, t
        self.id_type = df.schema[id].dataType
        distinct = _usable(df, id, vec).groupBy("v").agg(F.min("id").alias("id"))
        points = durable(distinct.select("id", l2_normalize("v").alias("v")), "metric-points")
        n, dim, dims = points.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v"))).first()
        if n and dim != dims:
            raise ValueError(f"vectors of one dimension are needed, found {dims} to {dim}")
        self.n, self.dim = n, dim or 0
        # cells of about a block each, up to the bound
        count = pivots or max(1, min(MAX_PIVOTS, -(-n // BLOCK)))
        rows = points.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("v").collect() if n else []
        self.pivots = choose_pivots(np.array([r["v"] for r in rows], dtype=np.float64), count) if rows else np.zeros((0, self.dim))
        self.homes = durable(points.mapInArrow(self._home(), self._schema("id", "cell", "v", "cosine")), "metric-homes")
        discard(points)
        own = {r["cell"]: r for r in self.homes.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("low"), F.max("cosine").alias("high")).collect()}
        k = len(self.pivots)
        self.own = np.array([own[c]["n"] if c in own else 0 for c in range(k)], dtype=np.int64)
        self.range = np.array([[own[c]["low"], own[c]["high"]] if c in own else [2.0, 2.0] for c in range(k)]).reshape(k, 2)
        self.ghosts = durable(self.homes.mapInArrow(self._ghost(), self._schema("id", "cell", "v")), "metric-ghosts")
        met = {r["cell"]: r["count"] for r in self.ghosts.groupBy("cell").count().collect()}
        self.met = np.array([met.get(c, 0) for c in range(k)], dtype=np.int64)

    def _schema(self, *names: str) -> T.StructType:
        kinds = {"id": self.id_type, "cell": T.IntegerType(), "v": T.ArrayType(T.DoubleType()), "cosine": T.DoubleType()}
        return T.StructType([T.StructField(n, kinds[n]) for n in names])

    @property
    def compared(self) -> int:
        """Pairs that meet."""
        return int((self.own * (self.own - 1) // 2 + self.own * self.met).sum())

    def _home(self):
        pivots, dim = self.pivots, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cosine = _rows(batch.column(1), dim) @ pivots.T
                    cell = cosine.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), batch.column(1), pa.array(cosine[np.arange(len(cell)), cell])],
                                                     names=["id", "cell", "v", "cosine"])
        return run

    def _ghost(self):
        pivots, dim, t = self.pivots, self.dim, self.t
        between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-300))  # distances of the pivots
        reach, angle = np.sqrt(2 - 2 * t) + _ROOM, np.arccos(t) + 1e-7
        widest, nearest = np.arccos(np.clip(self.range[:, 0], -1, 1)), np.arccos(np.clip(self.range[:, 1], -1, 1))
        there = self.own > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    cosine = _rows(part.column(2), dim) @ pivots.T
                    home = np.asarray(part.column(1))
                    own = cosine[np.arange(len(home)), home]
                    plane = (own[:, None] - cosine) / between[home]  # distance to the plane between the pivots
                    theta = np.arccos(np.clip(cosine, -1, 1))
                    go = (np.arange(len(pivots)) > home[:, None]) & there & (plane <= reach) & (theta <= widest + angle) & (theta >= nearest - angle)
                    row, cell = np.nonzero(go)
                    for some in range(0, len(row), GHOSTS):  # a row can be a ghost of every cell
                        take = part.take(pa.array(row[some:some + GHOSTS]))
                        yield pa.RecordBatch.from_arrays([take.column(0), pa.array(cell[some:some + GHOSTS], pa.int32()), take.column(2)], names=["id", "cell", "v"])
        return run

    def pairs(self) -> DataFrame:
        """(id_l, id_r, score) of representatives with a cosine above the threshold, id_l < id_r."""
        own, ghosts = -(-self.own // BLOCK), -(-self.met // BLOCK)  # blocks of each cell
        cells = self.spark.createDataFrame([(c, int(a), int(b)) for c, (a, b) in enumerate(zip(own, ghosts)) if a], "cell int, own int, ghosts int")
        block = lambda count: F.pmod(F.xxhash64("id"), F.greatest(count, F.lit(1))).cast("int")
        # one's own block b meets the blocks from b on, and every block of ghosts; blocks of ghosts are numbered after one's own
        mine = self.homes.select("id", "cell", "v").join(cells, "cell").withColumn("b", block(F.col("own")))
        mine = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("own") + F.col("ghosts") - 1)))
        ghost = F.col("o") >= F.col("own")
        mine = mine.select("id", "v", "cell", "b", F.when(ghost, F.col("b")).otherwise(F.least("b", "o")).alias("x"),
                           F.when(ghost, F.col("o")).otherwise(F.greatest("b", "o")).alias("y"))
        theirs = self.ghosts.join(cells, "cell").withColumn("b", F.col("own") + block(F.col("ghosts")))
        theirs = theirs.select("id", "v", "cell", "b", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("x"), F.col("b").alias("y"))
        t, dim = self.t, self.dim
        kind = T.StructType([T.StructField("id_l", self.id_type), T.StructField("id_r", self.id_type), T.StructField("score", T.DoubleType())])

        def meet(table: pa.Table) -> pa.Table:
            ids, v, b = table.column("id").combine_chunks(), _rows(table.column("v").combine_chunks(), dim), np.asarray(table.column("b"))
            x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
            left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
            out = ([], [], [])
            for at in range(0, len(left), 500):
                some = left[at:at + 500]
                scores = np.round(v[some] @ v[right].T, DECIMALS)
                hit = scores > t
                if x == y:
                    hit &= some[:, None] < right
                i, j = np.nonzero(hit)
                for held, found in zip(out, (some[i], right[j], scores[i, j])):
                    held.append(found)
            i, j, s = (np.concatenate(h) if h else np.zeros(0, dtype=np.int64) for h in out)
            return pa.table([ids.take(pa.array(i, pa.int64())), ids.take(pa.array(j, pa.int64())), pa.array(s, pa.float64())], names=["id_l", "id_r", "score"])

        found = mine.unionByName(theirs).groupBy("cell", "x", "y").applyInArrow(meet, kind)
        return found.select(F.least("id_l", "id_r").alias(f"{self.name}_l"), F.greatest("id_l", "id_r").alias(f"{self.name}_r"), "score")


def similarity_threshold_pairs(df: DataFrame, id: str, vec: str, t: float, pivots: int | None = None) -> DataFrame:
    """(id_l, id_r, score): pairs of different vectors with a cosine above ``t``, exactly.

    Equal vectors are one, named by their smallest id; ``equal_vectors`` lists who belongs to whom. Vectors that are
    null, hold nulls or other than finite numbers, or are all zero have no pairs, nor have null ids. How many pairs meet depends on how well the vectors cluster:
    on unrelated directions of many dimensions no exact bound parts them.
    """
    return MetricJoin(df, id, vec, t, pivots).pairs()
