"""Keeping an index in step with its sources: differences, diagnosis, plans and their application, all by joins on source_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("full", "scoped_full", "incremental", "none")


def corpus_state(corpus: DataFrame) -> DataFrame:
    return corpus.select(F.col("source_id").cast("string").alias("source_id"), "source_hash")


def indexed_state(index: DataFrame) -> DataFrame:
    """source_id, doc_ids, source_hashes and config_hashes (sorted, without nulls), of rows that have a source."""
    sets = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("source_hash", "source_hashes"), ("config_hash", "config_hashes"))]
    return index.where("source_id is not null").groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.array_sort(F.collect_list("segment_id")).alias("doc_ids"), *sets)


def corpus_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """source_id, status (added, modified, deleted, unchanged), old_hash, new_hash, of two tables of (source_id, source_hash)."""
    both = old.select("source_id", F.col("source_hash").alias("old_hash")).join(new.select("source_id", F.col("source_hash").alias("new_hash")), "source_id", "full_outer")
    status = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return both.select("source_id", status.alias("status"), "old_hash", "new_hash")


def diagnose(corpus: DataFrame, index: DataFrame, config_hash: str) -> DataFrame:
    """source_id and five flags. A source in both is stale if its hashes are not just the current one, misconfigured if its configurations are not just the one
    asked about, possibly both; else fresh. The sets are reduced to counts, least and greatest, which an aggregation combines before its shuffle."""
    held = index.where("source_id is not null").groupBy(F.col("source_id").cast("string").alias("source_id")).agg(
        F.min("source_hash").alias("h1"), F.max("source_hash").alias("h2"), F.min("config_hash").alias("c1"), F.max("config_hash").alias("c2"), F.lit(True).alias("indexed")
    )
    both = corpus_state(corpus).withColumn("present", F.lit(True)).join(held, "source_id", "full_outer")
    present, indexed = F.coalesce("present", F.lit(False)), F.coalesce("indexed", F.lit(False))
    same = lambda a, b, x: F.coalesce((F.col(a) == x) & (F.col(b) == x), F.lit(False))
    stale = present & indexed & ~same("h1", "h2", F.col("source_hash"))
    wrong = present & indexed & ~same("c1", "c2", F.lit(config_hash))
    return both.select(
        "source_id", (indexed & ~present).alias("is_orphan"), (present & ~indexed).alias("is_missing"), stale.alias("is_stale"), wrong.alias("is_misconfigured"), (present & indexed & ~stale & ~wrong).alias("is_fresh")
    )


def is_clean(report: DataFrame) -> bool:
    return report.where("not is_fresh").isEmpty()


def plan_refresh(report: DataFrame, mode: str = "full", scope: DataFrame | None = None) -> DataFrame:
    """source_id, to_delete, to_materialize, of the sources for which either holds (within the scope, a table of source_id, if one is given)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    if scope is not None:
        report = report.join(scope.select("source_id").distinct(), "source_id", "left_semi")
    again = F.col("is_stale") | F.col("is_misconfigured")
    drop = {"none": F.lit(False), "incremental": again}.get(mode, again | F.col("is_orphan"))
    plan = report.select("source_id", drop.alias("to_delete"), (F.col("is_missing") | again).alias("to_materialize"))
    return plan.where("to_delete or to_materialize")


def without_sources(index: DataFrame, sources: DataFrame) -> DataFrame:
    """The index without the rows of these sources; doing it again changes nothing."""
    return index.join(sources.select("source_id").distinct(), "source_id", "left_anti")


def gc_orphans(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """The index without sources that the corpus no longer has; rows without a source stay."""
    return index.where("source_id is null").unionByName(index.join(corpus.select("source_id").distinct(), "source_id", "left_semi"))


def refresh(index: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index after a plan: rows of sources to delete are out, and so are earlier rows of the segments that `fresh` (made of the sources to materialise) brings."""
    kept = without_sources(index, plan.where("to_delete"))
    keys = ["config_hash", "source_id", "idx", "source_hash"]
    kept = kept.join(fresh.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh)


def refresh_report(plan: DataFrame, report: DataFrame) -> DataFrame:
    """source_id, action: added, updated or deleted."""
    rows = plan.join(report.select("source_id", "is_missing"), "source_id")
    action = F.when(F.col("to_materialize") & F.col("is_missing"), "added").when(F.col("to_materialize"), "updated").otherwise("deleted")
    return rows.select("source_id", action.alias("action"))


def last_writer(index: DataFrame) -> DataFrame:
    """Of rows that share a segment id, the one written last (by ord, then idx): the view of a store keyed by content."""
    latest = index.groupBy("segment_id").agg(F.max(F.struct("ord", "idx")).alias("__last"))
    return index.join(latest, "segment_id").where(F.struct("ord", "idx") == F.col("__last")).drop("__last")
