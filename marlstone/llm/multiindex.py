"""Approximate nearest neighbours of stated queries among all vectors with an inverted multi-index.

Vectors are cut into two halves, each quantised by its own K centroids; the K * K pairs are the cells, and a vector is an entry of the cell
of its two centroids. A query's distance to a cell is the sum of its halves' squared distances to the cell's two centroids.

1. A heap walks the pairs in ascending order of that sum (a pair is pushed when the pairs before it in its row and column have been popped), until
   the cells passed hold LEAST times k entries. Reranking those by exact distance gives a first kth distance.
2. The same walk goes on to the last cell whose sum is at most that distance plus `slack`. Entries of the cells that it passes are reranked too, and
   the k nearest of all are the answer.

`slack` is what a neighbour's cell is farther off than the neighbour: the QUANTILE of that difference between SAMPLE_QUERIES vectors and their k nearest in
the whole table, found by one exact scan. So recall follows QUANTILE whether vectors cluster (few cells are passed) or not (most are), and however large the table is.
The index is fitted on a bounded sample (SAMPLE rows, those of least hashed id) and holds every row; the SAMPLE_QUERIES are the rows that follow it, or its last in a
table no larger, as vectors that the codebooks were trained on are nearer to them than others. K grows with the fourth root of the number of
vectors, to MOST_K, so the table of cell sizes stays broadcastable; beyond that cells hold more.

Entries lie in groups of about `block`, whole cells or shares of one cell that holds more; a query is sent only to groups where it passes a cell, and entries are never
copied. Defined cases: see vectors.py for rows that take no part; a row is not its own neighbour; a query need not be in the table; with fewer than k others all
entries passed are answers; ties go to the lower id; an empty table, one vector or no queries give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_table, slices
from .vectors import block_join, checked, matrix, squares, top

K = 10
SAMPLE = 8192
SAMPLE_QUERIES = 256
QUANTILE = 0.97
LEAST = 20
MOST_K = 1024
BLOCK = 16384
STEP = 1024
NEAR = 1e-9  # of rounding in squared distances


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of Lloyd's iterations from k rows drawn with a fixed seed. An empty cluster keeps its centroid."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        nearest = squares(x, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def walk(first: np.ndarray, second: np.ndarray, sizes: list[list[int]], least: int, limit: float | None = None) -> list[tuple]:
    """Cells in ascending order of first[i] + second[j]: those that it takes to hold `least` entries; or, given a limit, the ones after those whose sum is
    at most the limit. A list of (i, j)."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap, out, held = [(x[0] + y[0], 0, 0)], [], 0
    reached = [0] * len(x)  # how many columns of a row have been popped
    while heap and (held < least if limit is None else heap[0][0] <= limit or held < least):
        _, i, j = heapq.heappop(heap)
        n = sizes[a[i]][b[j]]
        if n and (limit is None or held >= least):
            out.append((a[i], b[j]))
        held += n
        reached[i] = j + 1
        if j + 1 < len(y) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if i + 1 < len(x) and reached[i + 1] == j:
            heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
    return out


class Index:
    """Two codebooks."""

    def __init__(self, sample: np.ndarray, n: int):
        self.half = sample.shape[1] // 2
        wanted = min(MOST_K, max(1, 2 ** round(math.log2(max(1.0, math.sqrt(n / 12))))))
        self.books = [codebook(sample[:, : self.half], wanted), codebook(sample[:, self.half :], wanted)]

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squares(x[:, : self.half], self.books[0]), squares(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.sums(x)
        return a.argmin(1), b.argmin(1)


def fitted_slack(entries: DataFrame, index, queries: np.ndarray, own: np.ndarray, k: int) -> float:
    """The QUANTILE of (sum of a neighbour's cell - squared distance) over the k nearest entries of each query, all entries being compared. index is
    a broadcast Index."""
    shared = entries.sparkSession.sparkContext.broadcast((queries, own))

    def scan(batches):
        y, own = shared.value
        a, c = index.value.sums(y)
        rows = np.arange(len(y))[:, None]
        best_d, best_x, best_s = np.full((len(y), 0), np.inf), np.zeros((len(y), 0), np.int64), np.zeros((len(y), 0))
        for b in slices(batches, STEP):
            ids = b.column("id").to_numpy()
            x = matrix(b.column("vec"), np.float32, y.shape[1]).astype(np.float64)
            d = squares(y, x)
            d[own[:, None] == ids[None]] = np.inf
            pick = top(d, k)
            cells = a[rows, b.column("i").to_numpy()[pick]] + c[rows, b.column("j").to_numpy()[pick]]
            best_d, best_x, best_s = np.concatenate([best_d, d[rows, pick]], 1), np.concatenate([best_x, ids[pick]], 1), np.concatenate([best_s, cells], 1)
            pick = top(best_d, k)
            best_d, best_x, best_s = best_d[rows, pick], best_x[rows, pick], best_s[rows, pick]
        q, at = np.nonzero(np.isfinite(best_d))
        yield pa.record_batch([pa.array(q), pa.array(best_x[q, at]), pa.array(best_d[q, at]), pa.array(best_s[q, at] - best_d[q, at])], names=["q", "x", "d2", "further"])

    found = entries.mapInArrow(scan, "q long, x long, d2 double, further double").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("d2", "x")))
    further = [r.further for r in found.where(F.col("rank") <= k).select("further").collect()]  # at most QUERIES * k numbers
    return float(np.quantile(further, QUANTILE)) if further else math.inf


class Groups:
    """Which groups of about `block` entries the cells are in: a run of whole cells, or for a larger cell a run of groups that share it."""

    def __init__(self, sizes: np.ndarray, block: int):
        flat = sizes.ravel()
        self.shares = np.maximum(1, -(-flat // block))
        first = np.zeros(len(flat), np.int64)
        now = held = 0
        for c in np.flatnonzero(flat).tolist():
            n, s = int(flat[c]), int(self.shares[c])
            if held and (held + n > block or s > 1):
                now, held = now + 1, 0
            first[c] = now
            if s > 1:
                now, held = now + s, 0
            else:
                held += n
        self.first, self.count = first, now + bool(held)

    def of_entries(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[cells] + (ids % self.shares[cells])

    def of_cells(self, cells: list[int]) -> dict[int, list[int]]:
        """The cells to look into, by group."""
        out: dict[int, list[int]] = {}
        for c in cells:
            for g in range(int(self.first[c]), int(self.first[c] + self.shares[c])):
                out.setdefault(g, []).append(c)
        return out


def neighbours(table: DataFrame, queries: DataFrame | None = None, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, rank (from 1), neighbour, distance (6 decimals). queries: rows of the same columns; all of the table if None."""
    spark = table.sparkSession
    result = "vec_id long, rank int, neighbour long, distance double"
    vectors, dim = checked(table, id_col, vector_col)
    if not dim:
        return spark.createDataFrame([], result)
    vectors = as_table(vectors, "imi-vectors")
    n = vectors.count()
    if n < 2:
        return spark.createDataFrame([], result)
    picked = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE + SAMPLE_QUERIES).collect()
    index = Index(np.array([np.frombuffer(r.vec, np.float32) for r in picked[:SAMPLE]], np.float64), n)
    shared = spark.sparkContext.broadcast(index)

    def assign(batches):
        for b in batches:
            i, j = shared.value.cells(matrix(b.column(1), np.float32, dim).astype(np.float64))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32))], names=["id", "vec", "i", "j"])

    entries = as_table(vectors.mapInArrow(assign, "id long, vec binary, i int, j int"), "imi-entries")
    sample = picked[-SAMPLE_QUERIES:]
    slack = fitted_slack(entries, shared, np.array([np.frombuffer(r.vec, np.float32) for r in sample], np.float64), np.array([r.id for r in sample], np.int64), k)
    width = len(index.books[1])
    sizes = np.zeros((len(index.books[0]), width), np.int64)
    for r in entries.groupBy("i", "j").count().collect():  # at most MOST_K ** 2 numbers
        sizes[r.i, r.j] = r["count"]
    groups = Groups(sizes, max(1, min(block, math.ceil(n / 12))))
    known = spark.sparkContext.broadcast((sizes, groups))
    tasks = max(1, min(groups.count, 4 * spark.sparkContext.defaultParallelism))
    side = "key int, id long, vec binary, cell int, lim double, cells binary"

    def place(batches):
        for b in batches:
            cell = b.column("i").to_numpy().astype(np.int64) * width + b.column("j").to_numpy()
            key = known.value[1].of_entries(cell, b.column("id").to_numpy())
            yield pa.record_batch([pa.array(key.astype(np.int32)), b.column("id"), b.column("vec"), pa.array(cell.astype(np.int32)), pa.nulls(len(b), pa.float64()), pa.nulls(len(b), pa.binary())], names=["key", "id", "vec", "cell", "lim", "cells"])

    held = entries.mapInArrow(place, side)

    def send(batches):
        """Queries to the groups of the cells that the walk passes; lim, the kth squared distance so far, is null in the first round."""
        sizes, groups = known.value[0].tolist(), known.value[1]
        for b in slices(batches, STEP):
            a, c = shared.value.sums(matrix(b.column("vec"), np.float32, dim).astype(np.float64))
            at, keys, lists = [], [], []
            for q, lim in enumerate(b.column("lim").to_pylist()):
                passed = walk(a[q], c[q], sizes, LEAST * k + 1, None if lim is None else lim + slack)
                for g, cells in groups.of_cells([i * width + j for i, j in passed]).items():
                    at.append(q)
                    keys.append(g)
                    lists.append(np.array(cells, np.int32).tobytes())
            rows = pa.array(at, pa.int64())
            yield pa.record_batch([pa.array(keys, pa.int32()), b.column("id").take(rows), b.column("vec").take(rows), pa.nulls(len(at), pa.int32()), b.column("lim").take(rows), pa.array(lists, pa.binary())], names=["key", "id", "vec", "cell", "lim", "cells"])

    def rerank(key, entries, queries):
        cell, ids = entries.column("cell").to_numpy(), entries.column("id").to_numpy()
        order = np.lexsort((ids, cell))
        cell, ids, x = cell[order], ids[order], matrix(entries.column("vec"), np.float32, dim)[order].astype(np.float64)
        for s in range(0, len(queries), STEP):
            part = queries.slice(s, STEP)
            own, y = part.column("id").to_numpy(), matrix(part.column("vec"), np.float32, dim).astype(np.float64)
            limits = part.column("lim").to_numpy(zero_copy_only=False)
            lists = [np.frombuffer(c.as_buffer(), np.int32) for c in part.column("cells")]
            who, which = np.repeat(np.arange(len(lists)), [len(c) for c in lists]), np.concatenate(lists)
            order = np.argsort(which, kind="stable")
            who, which = who[order], which[order]
            edges = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
            start, stop = np.searchsorted(cell, which[edges[:-1]]), np.searchsorted(cell, which[edges[:-1]], "right")
            best_d, best_x = np.full((len(part), k), np.inf), np.full((len(part), k), np.iinfo(np.int64).max, np.int64)
            kth = np.where(np.isnan(limits), np.inf, limits)  # no answer is farther than the kth of the first round
            for e, u, v in zip(range(len(edges) - 1), start.tolist(), stop.tolist()):
                q = who[edges[e] : edges[e + 1]]
                d = squares(y[q], x[u:v])
                d[own[q][:, None] == ids[u:v][None]] = np.inf
                nearer = (d <= kth[q][:, None] + NEAR).any(1)
                if not nearer.any():
                    continue
                q, d = q[nearer], d[nearer]
                pick = top(d, k)
                near = ((x[u:v][pick] - y[q][:, None]) ** 2).sum(2)
                near[~np.isfinite(np.take_along_axis(d, pick, 1))] = np.inf
                all_d, all_x = np.concatenate([best_d[q], near], 1), np.concatenate([best_x[q], ids[u:v][pick]], 1)
                order = np.lexsort((all_x, all_d), axis=1)[:, :k]
                best_d[q], best_x[q] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_x, order, 1)
                kth[q] = np.minimum(kth[q], best_d[q, -1])
            r, c = np.nonzero(np.isfinite(best_d))
            yield pa.record_batch([pa.array(own[r]), pa.array(best_x[r, c]), pa.array(best_d[r, c])], names=["q", "x", "d2"])

    ranked = Window.partitionBy("q").orderBy("d2", "x")

    def round_of(queries: DataFrame, before: DataFrame | None = None) -> DataFrame:
        found = block_join(held, queries.repartition(4 * spark.sparkContext.defaultParallelism, "id").mapInArrow(send, side), rerank, "q long, x long, d2 double", tasks)
        if before is not None:
            found = found.unionByName(before.select("q", "x", "d2"))
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    asked = entries.select("id", "vec") if queries is None else as_table(checked(queries, id_col, vector_col, dim)[0], "imi-queries")
    one = as_table(round_of(asked.withColumn("lim", F.lit(None).cast("double"))), "imi-first")
    bound = one.groupBy(F.col("q").alias("id")).agg(F.when(F.count("*") >= k, F.max("d2")).otherwise(F.lit(float("inf"))).alias("lim"))
    two = round_of(asked.join(bound, "id", "left").select("id", "vec", F.coalesce("lim", F.lit(float("inf"))).alias("lim")), one)
    return two.select(F.col("q").alias("vec_id"), F.col("rank").cast("int").alias("rank"), F.col("x").alias("neighbour"), F.round(F.sqrt("d2"), 6).alias("distance"))
