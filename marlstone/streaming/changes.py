"""Change feeds: what a stream of source versions adds, modifies and deletes, as events, and their application to an index.

A feed has source_id, seq (ascending within a source) and source_hash, null for a deletion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "source_id string, seq long, kind string, old_hash string, new_hash string"


def _kind(old, new):
    return F.when(old.isNull() & new.isNotNull(), "added").when(old.isNotNull() & new.isNull(), "deleted").when(old.isNotNull() & new.isNotNull() & (old != new), "modified")


def change_events(feed: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Events of a whole feed, after `known` (source_id, source_hash), in no order: what leaves a source as it is gives none. Of rows with one
    (source_id, seq) the first by hash counts."""
    rows = feed.select("source_id", F.col("seq").cast("long").alias("seq"), "source_hash").groupBy("source_id", "seq").agg(F.min("source_hash").alias("source_hash"))
    if known is not None:
        rows = rows.unionByName(known.select("source_id", F.lit(-(1 << 63)).alias("seq"), "source_hash"))
    before = F.lag("source_hash").over(Window.partitionBy("source_id").orderBy("seq"))
    events = rows.withColumn("old_hash", before).where(F.col("seq") > -(1 << 63))
    return events.select("source_id", "seq", _kind(F.col("old_hash"), F.col("source_hash")).alias("kind"), "old_hash", F.col("source_hash").alias("new_hash")).where("kind is not null")


def latest(feed: DataFrame) -> DataFrame:
    """source_id, source_hash, seq of the last row of each source; deleted ones have a null hash."""
    last = feed.groupBy("source_id").agg(F.max(F.struct("seq", "source_hash")).alias("l"))
    return last.select("source_id", "l.source_hash", "l.seq")


def changed_files(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of files (source_id, modified, size) that a registry of the same columns doesn't hold alike: only those need hashing. A real edit that
    keeps both is missed, which is what a fingerprint means."""
    same = registry.select("source_id", "modified", "size")
    return files.join(same, ["source_id", "modified", "size"], "left_anti")


class _Versions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "source_hash string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        data = pd.concat(list(rows)).sort_values(["seq", "source_hash"], kind="stable").drop_duplicates("seq")
        held = self.last.get() if self.last.exists() else None
        old, seen = (held[0], held[1]) if held else (None, None)
        out = []
        for seq, new in zip(data["seq"], data["source_hash"]):
            new = None if pd.isna(new) else new
            if seen is not None and seq <= seen:  # late: a newer version is known
                continue
            seen = int(seq)
            if new != old:
                out.append((key[0], seen, "added" if old is None else "deleted" if new is None else "modified", old, new))
            old = new
        if seen is not None:
            self.last.update((old, seen))
        if out:
            yield pd.DataFrame(out, columns=["source_id", "seq", "kind", "old_hash", "new_hash"])

    def close(self) -> None:
        pass


def stream_events(feed: DataFrame) -> DataFrame:
    """The same events of a streaming feed, as they come; the last hash of each source is the state. Rows that come after a later one of their source are dropped,
    across micro-batches; a deletion keeps its number as state, so that it isn't undone by a late row."""
    feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = feed.select("source_id", F.col("seq").cast("long").alias("seq"), "source_hash")
    return rows.groupBy("source_id").transformWithStateInPandas(_Versions(), EVENTS, "Append", "none")


def deduplicated(feed: DataFrame, time_col: str, delay: str) -> DataFrame:
    """A streaming feed without repeated (source_id, seq) within the delay of a watermark."""
    return feed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["source_id", "seq"])


def refresh_on_change(feed: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, available_now: bool = False, **trigger) -> StreamingQuery:
    """Runs apply(last version of each changed source: source_id, source_hash, seq) for every micro-batch: one refresh, however many events a source has.
    A batch may come again after a failure, so apply must be idempotent; a refresh is."""

    def batch(rows: DataFrame, _: int) -> None:
        rows.persist()
        try:
            if not rows.isEmpty():
                apply(latest(rows))
        finally:
            rows.unpersist()

    writer = feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(**trigger) if trigger else writer).start()
