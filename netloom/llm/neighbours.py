"""Approximate nearest neighbours by low-dimensional stable projections.

Every vector is projected on PROJECTED Gaussian directions. A kd-tree over the projections, fitted on a sample
of SAMPLE rows, divides space into cells; every row is indexed in its cell, and a cell of more than BLOCK rows is
split into blocks by a hash. A task holds one block at a time and indexes it by a kd-tree of its own.

A query visits the leaves of that tree in order of their projected distance and, inside a leaf, verifies the
points in order of theirs by the exact distance. A squared projected distance over the squared distance follows
a chi-square law, so the search stops where a vector nearer than the k-th found would have a projection this far
away with a probability below 1 - STOP: of true neighbours, about that share is lost at most.

Queries go to their own cell first; with the k-th distance found there, they go to those other cells whose box
the same test doesn't rule out. Candidates are dealt once and never copied; the queries are streamed past them.
Vectors without structure (all distances alike) make every query visit every cell, and verify most rows.

Of equal vectors only the k + 1 least identifiers can be among the k nearest of any row, so others are no
candidates; equal queries are searched once. Vectors that are null, zero or hold null or non-finite components
take no part, nor do rows with a null identifier or a length other than the most frequent one. Of rows that
repeat an identifier the least vector counts. Ties go to the lesser identifier. An empty table gives no rows.
Other columns are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from . import _common

PROJECTED, LEAF, STOP = 16, 32, 0.97
#: Rows of a block, rows that the cells are fitted on, and rows of the sample that a cell needs at least.
BLOCK, SAMPLE, PER_CELL = 16_384, 50_000, 8


def chi_square_cdf(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """For even m."""
    half = np.asarray(x, dtype=np.float64) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for k in range(1, m // 2):
        term = term * half / k
        total += term
    return 1 - np.exp(-half) * total


#: Squared projected over squared distance at which the stopping test holds.
RATIO = next(float(x) for x in np.arange(0, 200, 0.01) if chi_square_cdf(x) >= STOP)


def axes(width: int) -> np.ndarray:
    return np.random.default_rng(5).normal(size=(width, PROJECTED))


def kd_leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Leaves of a kd-tree split at the median of the widest side."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= most:
            leaves.append(at)
            continue
        side = int(np.ptp(points[at], axis=0).argmax())
        half = np.argpartition(points[at, side], len(at) // 2)
        todo += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return leaves


class Cells:
    """A kd-tree over the space of projections; boxes without bounds at the outside."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.sides: list[int] = []
        self.cuts: list[float] = []
        self.below: list[tuple[int, int]] = []  # children of a node; a cell c is -1 - c
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        every = np.full(PROJECTED, np.inf)
        self.root = self._split(sample, cells, -every, every)

    def _split(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        side = int(np.ptp(points, axis=0).argmax()) if len(points) else 0
        ordered = np.sort(points[:, side]) if len(points) else points
        cut = float(ordered[len(points) * (cells // 2) // cells]) if cells > 1 and len(points) >= 2 * PER_CELL else 0.0
        if cells < 2 or len(points) < 2 * PER_CELL or not ordered[0] < cut:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        node = len(self.sides)
        self.sides.append(side)
        self.cuts.append(cut)
        self.below.append((0, 0))
        left, right = high.copy(), low.copy()
        left[side] = right[side] = cut
        on_left = points[:, side] < cut
        a = self._split(points[on_left], cells // 2, low, left)
        b = self._split(points[~on_left], cells - cells // 2, right, high)
        self.below[node] = (a, b)
        return node

    def __len__(self) -> int:
        return len(self.low)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), dtype=np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
            elif len(at):
                left = points[at, self.sides[node]] < self.cuts[node]
                todo += [(self.below[node][0], at[left]), (self.below[node][1], at[~left])]
        return out

    def within(self, point: np.ndarray, squared: float) -> list[int]:
        """Cells whose box is at most this squared distance away."""
        out, todo = [], [(self.root, np.zeros(PROJECTED))]
        while todo:
            node, gap = todo.pop()
            if node < 0:
                out.append(-1 - node)
                continue
            side, cut = self.sides[node], self.cuts[node]
            near, far = self.below[node] if point[side] < cut else self.below[node][::-1]
            todo.append((near, gap))
            beyond = gap.copy()
            beyond[side] = point[side] - cut
            if (beyond * beyond).sum() <= squared:
                todo.append((far, beyond))
        return out


class Index:
    """The vectors of one block under a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.axes = axes(vectors.shape[1])
        low = vectors @ self.axes
        leaves = kd_leaves(low, LEAF)
        order = np.concatenate(leaves)
        self.ids, self.vectors, self.low = ids[order], vectors[order], low[order]
        self.starts = np.cumsum([0, *map(len, leaves)])
        self.floor = np.minimum.reduceat(self.low, self.starts[:-1])
        self.ceiling = np.maximum.reduceat(self.low, self.starts[:-1])
        self.verified = 0

    def search(self, query: np.ndarray, k: int, bound: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Distances and identifiers of the k nearest found, none farther than the bound."""
        at = query @ self.axes
        gap = np.maximum(np.maximum(self.floor - at, at - self.ceiling), 0)
        near = (gap * gap).sum(axis=1)
        ids, far = np.empty(0, dtype=np.int64), np.empty(0)
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > RATIO * bound**2:
                break
            rows = np.arange(self.starts[leaf], self.starts[leaf + 1])
            if bound < math.inf:
                off = self.low[rows] - at
                off = (off * off).sum(axis=1)
                rows = rows[off <= RATIO * bound**2]
            self.verified += len(rows)
            d = self.vectors[rows] - query
            d = np.sqrt((d * d).sum(axis=1))
            ids, far = np.concatenate([ids, self.ids[rows]]), np.concatenate([far, d])
            best = np.lexsort((ids, far))[:k]
            ids, far = ids[best], far[best]
            if len(far) == k:
                bound = min(bound, float(far[-1]))
        inside = far <= bound
        return far[inside], ids[inside]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col("_id").isNotNull() & F.col("_v").isNotNull() & finite & F.exists("_v", lambda x: x != 0))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


_HITS = StructType([StructField("_query", LongType()), StructField("_id", LongType()), StructField("score", DoubleType())])


def _searched(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """blocks: (block, _id, _v); asked: (block, _query, _v, bound). The hits of each query in the block."""
    none = F.lit(None).cast("double")
    rows = blocks.select("block", F.lit(False).alias("asks"), "_id", "_v", none.alias("bound"))
    rows = rows.unionByName(asked.select("block", F.lit(True).alias("asks"), F.col("_query").alias("_id"), "_v", "bound"))

    def run(batches):
        _common.worker_memory("neighbours")
        now, held, index = None, [], None
        for batch in batches:
            block, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(block)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                part = batch.slice(i, j - i)
                if block[i] != now:
                    now, held, index = block[i], [], None
                if not asks[i]:
                    held.append((part.column(2).to_numpy(), _matrix(part.column(3), j - i).copy()))
                    continue
                if index is None and held:
                    index = Index(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held = []
                if index is None:
                    continue
                bounds = part.column(4).to_numpy(zero_copy_only=False)
                found = [index.search(v, k, math.inf if np.isnan(b) else b) for v, b in zip(_matrix(part.column(3), j - i), bounds)]
                queries = np.repeat(part.column(2).to_numpy(), [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(np.concatenate([x for _, x in found])), pa.array(np.concatenate([x for x, _ in found]))], _HITS.names)

    return rows.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("_query").orderBy("score", "_id"))
    return hits.withColumn("_rank", rank).where(F.col("_rank") <= k)


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, queries: Column | None = None, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest. `queries`: condition on `_id`; all rows without it."""
    spark = vectors.sparkSession
    _common.shipped(spark)
    where = _common.work_dir(spark)
    rows = _common.written(_usable(vectors, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v")), f"{where}/vectors")
    width = rows.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    rows = rows.where(F.size("_v") == (width[0] if width else 0))

    # The window's group limit leaves k + 1 rows of each vector in a partition before the shuffle.
    first = F.row_number().over(Window.partitionBy("_v").orderBy("_id"))
    points = _common.written(rows.withColumn("_n", first).where(F.col("_n") <= k + 1).select("_id", "_v"), f"{where}/points")
    of = rows.where(queries if queries is not None else F.lit(True))
    # A query stands for all of its vector: it is searched for k + 1, of which each row leaves itself out.
    asked = _common.written(of.groupBy("_v").agg(F.min("_id").alias("_query")), f"{where}/asked")

    total = points.count()
    share = min(1.0, sample / max(1, total))
    drawn = points.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(F.xxhash64("_id")).limit(sample).select("_v").toArrow()
    if drawn.num_rows == 0:
        drawn = points.limit(1).select("_v").toArrow()
    fit = _matrix(drawn.column(0).combine_chunks(), drawn.num_rows) @ axes(width[0] if width else 1) if drawn.num_rows else np.empty((0, PROJECTED))
    cells = spark.sparkContext.broadcast(Cells(fit, max(1, math.ceil(total / block))))  # SAMPLE / PER_CELL cells at most

    def with_cell(batches):
        _common.worker_memory("neighbours")
        for batch in batches:
            low = _matrix(batch.column(1), batch.num_rows) @ axes(width[0]) if batch.num_rows else np.empty((0, PROJECTED))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.value.of(low))], [*batch.schema.names, "cell"])

    def others(batches):
        _common.worker_memory("neighbours")
        for batch in batches:
            if batch.num_rows:
                low = _matrix(batch.column(1), batch.num_rows) @ axes(width[0])
                bound = batch.column(2).to_numpy(zero_copy_only=False)
                home = cells.value.of(low)
                more = [[c for c in cells.value.within(x, math.inf if np.isnan(b) else RATIO * b * b) if c != h] for x, b, h in zip(low, bound, home)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(more, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    def placed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(with_cell, StructType([*df.schema.fields, StructField("cell", IntegerType())]))

    homes = _common.written(placed(points), f"{where}/cells")
    sizes = homes.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # a row a cell
    sizes = _common.written(sizes, f"{where}/sizes")
    part = F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int")
    blocks = homes.join(F.broadcast(sizes), "cell").select(F.struct("cell", part.alias("part")).alias("b"), "_id", "_v").select(_block("b").alias("block"), "_id", "_v")

    def to_blocks(df: DataFrame) -> DataFrame:
        every = df.join(F.broadcast(sizes), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return every.select(_block(F.struct("cell", "part")).alias("block"), "_query", "_v", "bound")

    own = placed(asked.select("_query", "_v")).withColumn("bound", F.lit(None).cast("double"))
    home_hits = _common.written(_searched(blocks, to_blocks(own), k + 1), f"{where}/home")
    kth = _best(home_hits, k + 1).groupBy("_query").agg(F.max(F.when(F.col("_rank") == k + 1, F.col("score"))).alias("bound"))
    bounded = asked.join(kth, "_query", "left").select("_query", "_v", "bound")
    routed = bounded.mapInArrow(others, StructType([*bounded.schema.fields, StructField("cells", ArrayType(IntegerType()))]))
    away = _searched(blocks, to_blocks(routed.withColumn("cell", F.explode("cells"))), k + 1)
    found = _best(home_hits.unionByName(away), k + 1).select("_query", "_id", "score")

    # Each row of a vector takes the hits of that vector's query, less itself.
    names = of.withColumnRenamed("_id", "query_id").join(asked, "_v").select("query_id", "_query")
    hits = names.join(found, "_query").where(F.col("query_id") != F.col("_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias("vec_id"), "score")


def _block(cell_and_part) -> Column:
    pair = F.col(cell_and_part) if isinstance(cell_and_part, str) else cell_and_part
    return F.shiftleft(pair["cell"].cast("long"), 32) + pair["part"]


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("_id") % 100 == 0)
