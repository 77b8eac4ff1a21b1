"""Tables in the folder that all executors share, which end a lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local master gets a temporary one; any other is refused, as a folder of one machine won't do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, written as Parquet and read again."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


PART_BYTES = 1 << 20
PART_ROWS = 1024


def in_parts(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to parts of at most PART_ROWS rows and about PART_BYTES of text, so that few texts are Python objects at a time; a longer text is a part of its own."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(b):
            before = int(ends[begin - 1]) if begin else 0
            stop = min(max(int(np.searchsorted(ends, before + PART_BYTES, "right")), begin + 1), begin + PART_ROWS, len(b))
            yield b.slice(begin, stop - begin)
            begin = stop
