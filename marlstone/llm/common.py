"""What the operators of this subpackage share: tables that cut lineage, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reaches. Where it is unset, a local
    master gets a temporary folder; any other master is refused, as a local folder would not do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def as_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and returns a read of it: lineage ends there, and a
    lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SLOTS = 24


def key_filter(keys: DataFrame, data: DataFrame, bits: int = SLOTS) -> DataFrame:
    """The rows of data whose long column `th` may be among the `th` of keys, decided by a bitmap of 2**bits slots. Meant to go before
    a join of large rows with few keys, so that few of them are shuffled; a bitmap that is full lets all rows pass."""
    chunks = 16
    per = (1 << bits) // chunks

    def mark(batches):
        held = np.zeros(1 << bits, bool)
        for b in batches:
            held[b.column(0).to_numpy() & ((1 << bits) - 1)] = True
        yield pa.record_batch({"chunk": pa.array(range(chunks), pa.int32()), "map": pa.array([np.packbits(held[k * per : (k + 1) * per]).tobytes() for k in range(chunks)], pa.binary())})

    def either(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                held[k] = held.get(k, np.uint8(0)) | np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.record_batch({"chunk": pa.array(held, pa.int32()), "map": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    kind = "chunk int, map binary"
    full = np.zeros(1 << bits, bool)
    for r in keys.select("th").mapInArrow(mark, kind).repartition(chunks // 4, "chunk").mapInArrow(either, kind).collect():
        full[r.chunk * per : (r.chunk + 1) * per] = np.unpackbits(np.frombuffer(r.map, np.uint8)).astype(bool)
    shared = data.sparkSession.sparkContext.broadcast(np.packbits(full))

    def keep(batches):
        for b in batches:
            at = b.column("th").to_numpy() & ((1 << bits) - 1)
            yield b.filter(pa.array((shared.value[at >> 3] >> (7 - (at & 7))).astype(bool)))

    return data.mapInArrow(keep, data.schema)


def identified(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """kid (the id, or the least long for a null one) and th (a hash of the text and of whether the id is null), which name a row up to
    repetitions and are never null; text; and what else is asked for."""
    own = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(own, F.lit(-(1 << 63))).alias("kid"), F.xxhash64(text, own.isNull()).alias("th"), text.alias("text"), *more)


def as_id(kid):
    return F.when(kid != -(1 << 63), kid)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Words and their hashes: a word is a longest run of ASCII letters or digits or of any characters beyond
# ASCII, in lower case. The hash of a word is a polynomial in its UTF-8 bytes modulo 2**64, mixed.
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(97, 123)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            full = np.full(size, base, np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that scatters near values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of a byte buffer; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and how many words each text has."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    buffer = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    word = np.zeros(len(buffer) + 1, bool)
    word[1:] = _WORD[buffer]
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum(np.array([len(p) + 1 for p in parts]))
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return span_hashes(buffer, starts, ends), counts


def slices(batches, rows: int = 512):
    """Arrow batches cut to few rows, so that few of their texts are Python objects at a time."""
    for b in batches:
        for k in range(0, len(b), rows):
            yield b.slice(k, rows)


def in_pieces(texts: list[str], most: int = 1 << 20):
    """Index ranges of texts that together have about `most` characters; one longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def forest(pairs: np.ndarray) -> np.ndarray:
    """Edges (node, least node of its tree) with the same components as the given edges."""
    names, flat = np.unique(pairs, return_inverse=True)
    parent = list(range(len(names)))
    flat = flat.reshape(-1, 2)
    for k in range(0, len(flat), 1 << 14):  # few edges are Python objects at a time
        for a, b in flat[k : k + (1 << 14)].tolist():
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            while parent[b] != b:
                parent[b] = parent[parent[b]]
                b = parent[b]
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]
    root = np.array(parent, np.int64) if parent else np.zeros(0, np.int64)
    keep = root != np.arange(len(names))
    return np.stack([names[keep], names[root[keep]]], axis=1)


def _local_forests(batches):
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1))
        size += len(held[-1])
        if size > 1 << 20:
            held = [forest(np.concatenate(held))]
            size = len(held[0])
            if size > 1 << 19:  # it no longer shrinks: pass it on
                yield pa.record_batch({"u": held[0][:, 0], "v": held[0][:, 1]})
                held, size = [], 0
    if held:
        out = forest(np.concatenate(held))
        yield pa.record_batch({"u": out[:, 0], "v": out[:, 1]})


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node reached. Each
    partition first reduces its edges to a spanning forest, then alternating large and small stars (a
    known MapReduce method) join the forests in a logarithmic number of rounds, each written to the
    shared folder. No edges: no rows. Edges with a null end are ignored; loops name a component of one."""
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null")
    now = as_table(edges.where("u <> v").mapInArrow(_local_forests, "u long, v long").distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == before:
            break
        before = seen
        both = now.union(now.select("v", "u"))
        of_u = Window.partitionBy("u")
        large = both.withColumn("m", F.least("u", F.min("v").over(of_u)))
        up = large.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.where("u <> m").select("u", F.col("m").alias("v"))
        low = up.union(kept).distinct().withColumn("m", F.min("v").over(of_u))
        small = low.select("u", F.col("m").alias("v")).union(low.select(F.col("v").alias("u"), F.col("m").alias("v")))
        small = small.where("u <> v").distinct()
        now = as_table(small, "edges")
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = edges.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return named.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
