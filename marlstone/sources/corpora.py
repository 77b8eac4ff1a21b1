"""Corpora as tables: source_id, ord (order of arrival), text, doc_id (a source's own id), metadata (canonical JSON), source_hash."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_json, content_hash, source_hash

SCHEMA = "source_id string, ord long, text string, doc_id string, metadata string, source_hash string"


def unpacked(source: str | bytes | Mapping) -> tuple[str | None, str | None, str]:
    """(text, own id, metadata as canonical JSON) of a source. Other top-level keys count as metadata and win over it."""
    if isinstance(source, (str, bytes)):
        return (source if isinstance(source, str) else None), None, "{}"
    if not isinstance(source, Mapping):
        raise TypeError(f"a source is text or a mapping, not {type(source).__name__}")
    text = source.get("text")
    if text is None:
        raise ValueError("a structured source needs a text")
    if not isinstance(text, str):
        raise TypeError("the text of a source must be a string")
    own = {k: source[k] for k in source.keys() - {"id", "metadata", "text"} if source[k] is not None}
    given = source.get("id")
    return text, None if given is None else str(given), canonical_json({**(source.get("metadata") or {}), **own})


def _frame(spark: SparkSession, items: Iterable[tuple[Any, Any]], content_keys: Iterable[str]) -> DataFrame:
    rows = []
    for k, (key, source) in enumerate(items):
        hashed = source_hash(source, content_keys)
        try:
            parts = unpacked(source)
        except ValueError:  # hashable as a whole, though not to be cut into segments
            parts = (None, None, canonical_json(dict(source)))
        rows.append((str(hashed if key is None else key), k, *parts, hashed))
    return spark.createDataFrame(rows, SCHEMA)


def collapse(rows: DataFrame) -> DataFrame:
    """Of rows of one source_id the last one's values at the first one's place."""
    rest = [c for c in rows.columns if c not in ("source_id", "ord")]
    one = rows.groupBy("source_id").agg(F.min("ord").alias("ord"), F.max_by(F.struct(*rest), "ord").alias("last"))
    return one.select("source_id", "ord", *[F.col(f"last.{c}").alias(c) for c in rest]).select(rows.columns)


def from_directory(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """One source for each text file below a folder; its id is the path below it."""
    if not os.path.isdir(path) and "://" not in path:
        raise TypeError(f"{path!r} is not a folder")
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    root = path.rstrip("/") + "/"
    name = F.expr("_metadata.file_path")
    named = files.select(F.substring_index(name, root, -1).alias("source_id"), F.col("value").alias("text"))
    return named.select("source_id", F.xxhash64("source_id").alias("ord"), "text", F.lit(None).cast("string").alias("doc_id"), F.lit("{}").alias("metadata"), content_hash(F.col("text")).alias("source_hash"))


def as_corpus(spark: SparkSession, x: Any = None, content_keys: Iterable[str] = ()) -> DataFrame:
    """A corpus from nothing, a corpus DataFrame, a mapping by id, a folder of text files, or any iterable of sources (named by their hashes)."""
    if x is None:
        return spark.createDataFrame([], SCHEMA)
    if isinstance(x, DataFrame):
        missing = {"source_id", "text"} - set(x.columns)
        if missing:
            raise ValueError(f"a corpus table needs the columns {sorted(missing)}")
        return from_table(x)
    if isinstance(x, Mapping):
        return _frame(spark, x.items(), content_keys)
    if isinstance(x, (str, os.PathLike)):
        return from_directory(spark, str(x))
    if isinstance(x, Iterable):
        return collapse(_frame(spark, ((None, s) for s in x), content_keys))
    raise TypeError(f"no corpus can be made of {type(x).__name__}")


def from_table(rows: DataFrame, source_id: str | Column = "source_id", text: str | Column = "text", order: str | Column | None = None, metadata: Column | None = None) -> DataFrame:
    """A corpus from a table; ids become strings, and the order is that of `order` (the hash of the id if there is none)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    have = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    place = col(order) if order is not None else have("ord", "long")
    out = rows.select(
        col(source_id).cast("string").alias("source_id"), place.cast("long").alias("ord"), col(text).cast("string").alias("text"), have("doc_id", "string").alias("doc_id"),
        (metadata if metadata is not None else F.coalesce(have("metadata", "string"), F.lit("{}"))).alias("metadata"), have("source_hash", "string").alias("source_hash"),
    )
    return out.withColumns({"ord": F.coalesce("ord", F.xxhash64("source_id")), "source_hash": F.coalesce("source_hash", content_hash(F.col("text")))})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's documents as a corpus, language and source as metadata."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return from_table(docs.withColumnRenamed("doc_id", "key"), "key", "text", "key", F.to_json(F.struct("lang", "source")))
