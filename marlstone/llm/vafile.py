"""Exact top-k search of stated queries against all vectors with vector-approximation files.

Each dimension is cut into 2**8 cells between its least and greatest value, so a vector's approximation is one byte a dimension. The approximations are
a table of their own. A vector is nowhere farther from the middle of its cell than half the cell's diagonal, which bounds
its distance to a query from below and above.

1. The scan. Queries are taken in blocks of about BLOCK, each broadcast to a scan of all approximations. It runs over portions of the table, the first of
   about FIRST vectors, each next one GROW times the size of those before: after each, a query's kth least upper bound is known and the next portion
   sends on only what is nearer by its lower bound. So a query keeps about k * GROW candidates a portion, however large the table is.
2. The reading. Candidates of a query are put in the order of their lower bounds and their exact vectors are read k at a time, for all queries at once. A query
   is done when its next lower bound is above its kth exact distance: then the result is certain. Vectors that no round asks for are not read.

Answers are rows of other ids, ordered by (squared distance to 9 decimals, id). Defined cases: see vectors.py for rows that take no part; with
fewer than k other vectors all are answers; equal vectors are at distance 0 and ordered by id; a query need not be in the table; an empty table or
no queries give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, slices
from .vectors import checked, matrix, squares, top

K = 10
BLOCK = 4096
FIRST = 8192
GROW = 16
STEP = 1024  # vectors compared at a time
EPSILON = 1e-6  # so that ties to 9 decimals are still read


def _ranges(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    def run(batches):
        low, high, n = np.full(dim, np.inf), np.full(dim, -np.inf), 0
        for b in batches:
            x = matrix(b.column(1), np.float32, dim)
            if len(x):
                low, high, n = np.minimum(low, x.min(0)), np.maximum(high, x.max(0)), n + len(x)
        yield pa.record_batch([pa.array([low.tolist()]), pa.array([high.tolist()]), pa.array([n])], names=["low", "high", "n"])

    found = vectors.mapInArrow(run, "low array<double>, high array<double>, n long")
    r = found.select(*[F.min(F.col("low")[i]).alias(f"l{i}") for i in range(dim)], *[F.max(F.col("high")[i]).alias(f"h{i}") for i in range(dim)], F.sum("n").alias("n")).first()
    return np.array(r[:dim]), np.array(r[dim : 2 * dim]), r.n


def _candidates(portions: list[DataFrame], queries: DataFrame, low: np.ndarray, width: np.ndarray, radius: float, k: int) -> list[DataFrame]:
    """Tables (q, x, low, high) of what may be among the k nearest of the queries, which fit in memory."""
    spark = queries.sparkSession
    rows = queries.orderBy("id").collect()
    own, y = np.array([r.id for r in rows], np.int64), np.array([np.frombuffer(r.vec, np.float32) for r in rows], np.float64)
    bound = np.full(len(rows), np.inf)
    found: list[DataFrame] = []
    for portion in portions:
        shared = spark.sparkContext.broadcast((own, y, bound))

        def scan(batches, shared=shared):
            own, y, bound = shared.value
            best = np.full((len(y), k), np.inf)  # the least upper bounds in this partition
            for b in slices(batches, STEP):
                ids = b.column("id").to_numpy()
                d = np.sqrt(squares(y, low + (matrix(b.column("cells"), np.uint8, y.shape[1]) + 0.5) * width))
                d[own[:, None] == ids[None]] = np.inf
                near = np.take_along_axis(d, top(d, k), 1) + radius
                both = np.concatenate([best, near], 1)
                best = np.take_along_axis(both, top(both, k), 1)
                limit = np.minimum(bound, best.max(1))
                at, column = np.nonzero(np.isfinite(d) & (d - radius <= limit[:, None]))
                d = d[at, column]
                yield pa.record_batch([pa.array(own[at]), pa.array(ids[column]), pa.array(np.maximum(0, d - radius)), pa.array(d + radius)], names=["q", "x", "low", "high"])

        found.append(as_table(portion.mapInArrow(scan, "q long, x long, low double, high double"), "va-candidates"))
        kth = Window.partitionBy("q").orderBy("high")
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        for r in every.select("q", "high").withColumn("rank", F.row_number().over(kth)).where(F.col("rank") == k).collect():  # a number for each query of the block
            bound[np.searchsorted(own, r.q)] = r.high
    limit = spark.createDataFrame([(int(q), float(b)) for q, b in zip(own, bound)], "q long, bound double")
    return [f.join(F.broadcast(limit), "q").where("low <= bound").select("q", "x", "low") for f in found]


def top_k(table: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """vec_id, rank (from 1), neighbour, distance (6 decimals), and how many exact vectors the query read. queries: rows of the same columns; all of the table if None."""
    spark = table.sparkSession
    result = "vec_id long, rank int, neighbour long, distance double, reads int"
    vectors, dim = checked(table, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], result)
    vectors = as_table(vectors, "va-vectors")
    low, high, n = _ranges(vectors, dim)
    width = np.where(high > low, (high - low) / 256, 0.0)
    radius = 0.5 * math.sqrt(float((width * width).sum())) * (1 + 1e-9) + 1e-9

    def approximate(batches):
        for b in batches:
            x = matrix(b.column("vec"), np.float32, dim).astype(np.float64)
            cells = np.clip(np.floor(np.divide(x - low, width, out=np.zeros_like(x), where=width > 0)), 0, 255).astype(np.uint8)
            yield pa.record_batch([b.column("id"), pa.array([c.tobytes() for c in cells], pa.binary()), b.column("portion")], names=["id", "cells", "portion"])

    edges, size = [], first
    while size < n:
        edges.append(size / n)
        size *= GROW + 1
    place = F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) / float(1 << 30)
    portion = sum((F.when(place >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int").alias("portion")
    file = as_table(vectors.select("id", "vec", portion).mapInArrow(approximate, "id long, cells binary, portion int"), "va-file", "portion")
    portions = [file.where(F.col("portion") == p).select("id", "cells") for p in range(len(edges) + 1)]
    asked = vectors if queries is None else as_table(checked(queries, id_col, vector_col, dim)[0], "va-queries")
    blocks = math.ceil(asked.count() / block)
    if not blocks:
        return spark.createDataFrame([], result)
    of_block = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(blocks))
    parts = [f for b in range(blocks) for f in _candidates(portions, asked.where(of_block == b), low, width, radius, k)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    return _read(as_table(found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("low", "x"))), "va-found"), vectors, asked, dim, k)


def _read(found: DataFrame, vectors: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    def measure(batches):
        for b in batches:
            x, q = (matrix(b.column(c), np.float32, dim).astype(np.float64) for c in ("xv", "qv"))
            yield pa.record_batch([b.column("q"), b.column("x"), pa.array(((x - q) ** 2).sum(1))], names=["q", "x", "d2"])

    of_query = Window.partitionBy("q").orderBy("near", "x")
    best, begin = None, 0
    wanted = found.where(F.col("place") <= k)
    while True:
        pairs = wanted.select("q", "x").join(vectors.select(F.col("id").alias("x"), F.col("vec").alias("xv")), "x").join(asked.select(F.col("id").alias("q"), F.col("vec").alias("qv")), "q")
        now = pairs.mapInArrow(measure, "q long, x long, d2 double").withColumn("reads", F.lit(1))
        if best is not None:
            now = now.unionByName(best.select("q", "x", "d2", "reads"))
        now = now.select("q", "x", "d2", F.round("d2", 9).alias("near"), F.sum("reads").over(Window.partitionBy("q")).alias("total"))
        now = now.withColumn("rank", F.row_number().over(of_query)).where(F.col("rank") <= k)
        # the count of all reads is carried by the best
        best = as_table(now.select("q", "x", "d2", "rank", F.when(F.col("rank") == 1, F.col("total")).otherwise(0).alias("reads")), "va-best")
        begin += k
        kth = best.where(F.col("rank") == k).select("q", F.sqrt("d2").alias("kth"))
        wanted = as_table(found.where((F.col("place") > begin) & (F.col("place") <= begin + k)).join(kth, "q").where(F.col("low") <= F.col("kth") + EPSILON).select("q", "x"), "va-wanted")
        if wanted.isEmpty():
            break
    total = F.max("reads").over(Window.partitionBy("q"))
    return best.select(F.col("q").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("x").alias("neighbour"), F.round(F.sqrt("d2"), 6).alias("distance"), total.cast("int").alias("reads"))


SQL = f"""
WITH d AS (
  SELECT a.vec_id, b.vec_id AS neighbour, list_sum([(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2 for i in range(1, len(a.embedding) + 1)]) AS d2
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), neighbour) AS rank FROM d
)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(sqrt(d2), 6) AS distance FROM r WHERE rank <= {K}
"""
