"""What the vector searches share: checked vectors, a join of blocks, exact distances.

Checked vectors are those that take part, as queries and as answers: the id is not null, the vector is not null, holds no null, NaN or infinity
and has the commonest number of dimensions (of several, the least). Of rows that repeat an id, the one whose float32 bytes are least stands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checked(table: DataFrame, id_col: str, vector_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """(id, vec: float32 bytes; the number of dimensions, 0 if nothing takes part). dim: the number that is asked for, instead of the commonest."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("float"))))
    if dim is None:
        sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = sizes.n if sizes else 0

    def pack(batches):
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            flat = flat + np.float32(0)  # no negative zeros
            raw = pa.py_buffer(flat.tobytes())
            offsets = pa.py_buffer((np.arange(len(b) + 1) * (4 * dim)).astype(np.int32).tobytes())
            yield pa.record_batch([b.column(0), pa.Array.from_buffers(pa.binary(), len(b), [None, offsets, raw])], names=["id", "vec"])

    packed = rows.where(F.size("v") == dim).mapInArrow(pack, "id long, vec binary")
    return packed.groupBy("id").agg(F.min("vec").alias("vec")), dim


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The equally long binaries of a column as rows of an array."""
    if not len(column):
        return np.zeros((0, width), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def block_join(entries: DataFrame, queries: DataFrame, run: Callable, schema: str, tasks: int) -> DataFrame:
    """run(key, entries, parts of queries) for every key: both sides are DataFrames with an int column `key` first, and equal further columns. A key's
    entries are held in memory, so they must be a block of bounded size; its queries come in parts."""
    both = entries.withColumn("role", F.lit(0)).unionByName(queries.withColumn("role", F.lit(1)))
    both = both.repartition(tasks, "key").sortWithinPartitions("key", "role")

    def stream(batches):
        now, held = None, []
        for b in batches:
            keys, roles = b.column("key").to_numpy(), b.column("role").to_numpy()
            edges = np.flatnonzero((keys[1:] != keys[:-1]) | (roles[1:] != roles[:-1])) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(b)]):
                if i == j:
                    continue
                if keys[i] != now:
                    now, held = keys[i], []
                if roles[i] == 0:
                    held.append(b.slice(i, j - i))
                elif held:
                    if len(held) > 1:
                        held = [pa.Table.from_batches(held).combine_chunks().to_batches()[0]]
                    yield from run(int(now), held[0], b.slice(i, j - i))

    return both.mapInArrow(stream, schema)


def top(values: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least values of each row, in no order."""
    return np.argpartition(values, k - 1, axis=1)[:, :k] if values.shape[1] > k else np.broadcast_to(np.arange(values.shape[1]), values.shape)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T))
