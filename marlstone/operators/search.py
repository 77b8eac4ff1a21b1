"""Search over an index: filters, ranking of one query or of many, retrieval and reranking.

An index is a table with an array<float> column `vector`, columns `ord` and `idx`, and what else its rows carry. The score is the cosine (0 for
a vector without length), to 9 decimals; of equal scores the earlier (ord, idx) comes first.
"""

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine

#: Queries of a batch that are sent to every task; more are joined with the index in blocks.
MOST_BROADCAST = 4096
BLOCK_ROWS = 65_536
BLOCK_VALUES = 1 << 22
LEAST_BLOCK = 4096
#: Queries and rows that are scored at once, and how far apart two ways of computing a score may be, with its rounding to 9 decimals.
TILE = (256, 4096)
SLACK = 2e-9
CROSS_ENCODER = "/".join(("cross-encoder", "ms-marco-MiniLM-L-6-v2"))

_COMPARE = {"$eq": lambda c, v: c == v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}


def condition(spec: Mapping, columns: Sequence[str], metadata: str = "metadata") -> Column:
    """A filter as {field: value} or with $eq $ne $gt $gte $lt $lte $in $nin $exists $and $or $not. A field is a column, or a key of the JSON metadata.
    A missing field equals nothing; $ne and $nin hold for it."""

    def of(name: str, value) -> Column:
        if name in columns:
            return F.col(f"`{name}`")
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"
        text = F.get_json_object(metadata, "$['" + name.replace("'", "\\'") + "']")
        return text if kind == "string" else text.try_cast(kind)

    def one(name: str, rule) -> Column:
        if not isinstance(rule, Mapping) or not any(str(k).startswith("$") for k in rule):
            rule = {"$eq": rule}
        out = F.lit(True)
        for op, value in rule.items():
            if op == "$exists":
                there = of(name, "").isNotNull()
                out &= there if value else ~there
            elif op == "$not":
                out &= ~one(name, value)
            elif op in ("$in", "$nin"):
                inside = F.coalesce(of(name, value[0]).isin(list(value)), F.lit(False)) if value else F.lit(False)
                out &= inside if op == "$in" else ~inside
            elif op == "$ne":
                out &= ~F.coalesce(of(name, value) == value, F.lit(False))
            elif op in _COMPARE:
                found = of(name, value).isNull() if value is None and op == "$eq" else F.coalesce(_COMPARE[op](of(name, value), value), F.lit(False))
                out &= found
            else:
                raise ValueError(f"unknown operator {op!r} in a filter")
        return out

    total = F.lit(True)
    for key, value in spec.items():
        if key == "$and":
            for s in value:
                total &= condition(s, columns, metadata)
        elif key == "$or":
            either = F.lit(False)
            for s in value:
                either |= condition(s, columns, metadata)
            total &= either
        elif key == "$not":
            total &= ~condition(value, columns, metadata)
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key!r} in a filter")
        else:
            total &= one(key, value)
    return total


def filtered(index: DataFrame, spec: Mapping | None) -> DataFrame:
    return index.where(condition(spec, index.columns)) if spec else index


def top_k(index: DataFrame, vector: Sequence[float], limit: int = 10, filter: Mapping | None = None) -> DataFrame:
    """The best rows for one query vector, with score and rank (from 1). The filter comes before the ranking, so it reaches the scan."""
    query = F.lit([float(x) for x in vector]).cast("array<double>")
    scored = filtered(index, filter).withColumn("score", F.round(cosine(F.col("vector"), query), 9))
    best = scored.orderBy(F.desc("score"), "ord", "idx").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "ord", "idx")))


def _lengths(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the vectors over them; a vector without length, or of an endless one, becomes zeros."""
    size = np.linalg.norm(vectors, axis=1)
    unit = np.divide(vectors, size[:, None], out=np.zeros_like(vectors), where=((size > 0) & np.isfinite(size))[:, None])
    return size, unit


def _vectors(column, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width) if len(column) else np.zeros((0, width))


def _best(ids: pa.Array, queries: np.ndarray, b, limit: int):
    """For each query the best `limit` rows of a batch: query_id, key, ord, idx, score. Scores are made in tiles of TILE; a tile's rows count if they reach
    the score that the query's limit-th row had in the tiles before, so few of them are held."""
    rows = _vectors(b.column("vector"), queries.shape[1])
    order, idx = (b.column(c).fill_null(np.iinfo(kind).min).to_numpy() for c, kind in (("ord", np.int64), ("idx", np.int32)))
    at_q, at_r, scores = [], [], []
    for i in range(0, len(queries), TILE[0]):
        asked, asked_unit = _lengths(queries[i : i + TILE[0]])
        asked_rows = queries[i : i + TILE[0]]
        least = np.full(len(asked), -np.inf)
        q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(rows), TILE[1]):
            part = rows[j : j + TILE[1]]
            sizes, part_unit = _lengths(part)
            near = asked_unit @ part_unit.T
            if not j and len(part) > limit:  # rounding keeps the order, so no row below the limit-th can be rounded above it
                least = np.partition(near, len(part) - limit, axis=1)[:, len(part) - limit]
            more_q, more_r = np.nonzero(near >= (least - SLACK)[:, None])
            found, both = np.empty(len(more_q)), asked[more_q] * sizes[more_r]
            for k in range(0, len(found), TILE[1]):
                n = slice(k, k + TILE[1])
                found[n] = np.einsum("ij,ij->i", asked_rows[more_q[n]], part[more_r[n]])
            found = np.round(np.divide(found, both, out=np.zeros(len(found)), where=both > 0), 9)
            q, r, s = np.concatenate([q, more_q]), np.concatenate([r, more_r + j]), np.concatenate([s, found])
            by = np.lexsort((idx[r], order[r], -s, q))
            place = np.arange(len(by)) - np.searchsorted(q[by], q[by])
            by = by[place < limit]
            q, r, s = q[by], r[by], s[by]
            last = np.flatnonzero(place[place < limit] == limit - 1)
            least[q[last]] = np.maximum(least[q[last]], s[last])
        at_q.append(q + i)
        at_r.append(r)
        scores.append(s)
    q, r, s = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((at_q, np.int64), (at_r, np.int64), (scores, np.float64)))
    return pa.record_batch([ids.take(pa.array(q)), *(b.column(c).take(pa.array(r)) for c in ("key", "ord", "idx")), pa.array(s)], names=["query_id", "key", "ord", "idx", "score"])


def batch_top_k(index: DataFrame, queries: DataFrame, limit: int = 10, key: str = "segment_id", filter: Mapping | None = None) -> DataFrame:
    """query_id, key, ord, idx, score, rank for every row of queries (query_id, vector). Few queries (up to MOST_BROADCAST, counted) are sent to all tasks of the
    scan; more are joined with the index block by block, so neither side has to fit anywhere as a whole. Blocks are as many as keep all cores busy, and of at most
    BLOCK_ROWS rows and BLOCK_VALUES numbers, so a task's memory has a bound."""
    rows = filtered(index, filter).where("vector is not null").select(F.col(key).cast("string").alias("key"), F.col("ord").cast("long").alias("ord"), F.col("idx").cast("int").alias("idx"), "vector")
    queries = queries.where("vector is not null").select(F.col("query_id").cast("string").alias("query_id"), "vector")
    result = "query_id string, key string, ord long, idx int, score double"
    few = queries.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:
        ids, matrix = [r.query_id for r in few], np.array([r.vector for r in few], np.float64)
        if not ids:
            return queries.sparkSession.createDataFrame([], result + ", rank int")

        def scan(batches):
            for b in batches:
                if len(b):
                    yield _best(pa.array(ids, pa.string()), matrix, b, limit)

        found = rows.mapInArrow(scan, result)
    else:
        n_rows, n_queries = rows.count(), queries.count()
        most = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, len(few[0].vector))))
        busy = math.ceil((4 * rows.sparkSession.sparkContext.defaultParallelism) ** 0.5)
        blocks = lambda n: max(-(-n // most), min(busy, -(-n // LEAST_BLOCK)), 1)
        across, down = blocks(n_rows), blocks(n_queries)
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = rows.withColumns({"r": block("key", across)}).withColumn("q", each(down))
        right = queries.withColumns({"q": block("query_id", down)}).withColumn("r", each(across))

        def join(own, asked):
            if not len(own) or not len(asked):
                return pa.table({n: pa.array([], t) for n, t in zip(("query_id", "key", "ord", "idx", "score"), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.float64()))})
            vectors = asked.column("vector").combine_chunks()
            matrix = _vectors(vectors, len(vectors[0]))
            return pa.Table.from_batches([_best(asked.column("query_id").combine_chunks(), matrix, own.combine_chunks().to_batches()[0], limit)])

        found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(join, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord", "idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def with_source(hits: DataFrame) -> DataFrame:
    """Hits as segments: no score, and the source's id in the metadata unless that has one."""
    has = F.get_json_object("metadata", "$.source").isNotNull() | F.col("source_id").isNull()
    given = F.to_json(F.struct(F.col("source_id").alias("source")))
    joined = F.when(F.coalesce(F.col("metadata"), F.lit("{}")) == "{}", given).otherwise(F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(","), F.expr("substring(to_json(named_struct('source', source_id)), 2)")))
    return hits.withColumn("metadata", F.when(has, F.col("metadata")).otherwise(joined)).drop("score")


def rerank(hits: DataFrame, scorer: Callable[[str, list[str]], Sequence[float]] | Column, query: str | None = None, limit: int | None = None, by: str | None = None) -> DataFrame:
    """Hits in descending order of a new score, equal ones in the order of their rank; rerank_score is added and rank made anew. The scorer is an expression, or
    a function of (query, texts), which is called on all hits of a query at once: `by` names the column of the query's id, if there are several."""
    if isinstance(scorer, Column):
        scored = hits.withColumn("rerank_score", scorer.cast("double"))
    else:
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema.fields), "rerank_score double"])

        def run(table):
            asked = table.column("query")[0].as_py() if query is None else query
            scores = list(scorer(asked, table.column("text").to_pylist()))
            if len(scores) != len(table):
                raise ValueError(f"{len(table)} segments, {len(scores)} scores")
            own = table.drop_columns(["__all"]) if by is None else table
            return own.append_column("rerank_score", pa.array([float(s) for s in scores], pa.float64()))

        together = hits if by else hits.withColumn("__all", F.lit(0))
        scored = together.groupBy(by or "__all").applyInArrow(run, schema)
    order = Window.partitionBy(*([by] if by else [F.lit(0)])).orderBy(F.desc("rerank_score"), "rank")
    out = scored.withColumn("__place", F.row_number().over(order))
    if limit is not None:
        out = out.where(F.col("__place") <= limit)
    return out.withColumn("rank", F.col("__place")).drop("__place")


def with_reranker(retrieve: Callable[..., DataFrame], scorer, fetch_k: int = 50) -> Callable[..., DataFrame]:
    """A retriever that fetches more than it is asked for, reranks, and keeps the best."""

    def search(query: str, limit: int = 10, **options) -> DataFrame:
        return rerank(retrieve(query, limit=max(fetch_k, limit), **options), scorer, query=query, limit=limit)

    return search


def cross_encoder_reranker(model_name=CROSS_ENCODER, **options) -> Callable[[str, list[str]], list[float]]:
    """A scorer that runs a cross-encoder of the sentence-transformers package, loaded at its first call."""
    held: dict = {}

    def score(query: str, texts: list[str]) -> list[float]:
        if "model" not in held:
            try:
                from sentence_transformers import CrossEncoder
            except ImportError as e:
                raise ImportError("cross-encoders need the sentence-transformers package") from e
            held["model"] = CrossEncoder(model_name, **options)
        return [float(s) for s in held["model"].predict([(query, t) for t in texts])]

    return score
