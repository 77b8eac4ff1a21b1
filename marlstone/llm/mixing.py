"""Mixing sources to target weights by systematic sampling.

Each document of a source expects the same number of copies, in whole millionths. Within its source the
expected copies are prefix-summed, one random offset per source is added, and a document is emitted once
for each whole number that its stretch of the sum crosses. So a source's total is its target to within one
document, and no document's copies differ from its expectation by one or more.

Documents stand in the order (doc_id modulo `buckets`, doc_id, text). The prefix sum needs only how many
documents stand before: a count for each (source, bucket), summed over buckets, then a row number inside
the bucket. So even a source that holds most of the corpus is spread over `buckets` groups.

Defined cases: a null source counts as the source ''. A null id stands first, in bucket 0. A null or empty
text has no characters but is sampled as any document of its source. A source without any characters gets
one expected copy a document. Rows that repeat are documents of their own. An empty table gives no rows. Extra
columns are carried along, whatever their names; a copy_col that is the name of one is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1_000_000
BUCKETS = 4093
ALPHA = 0.9
SEED = "mix-1"


def source_plan(docs: DataFrame, weights: dict[str, float] | None = None, total_chars: float | None = None, alpha: float = ALPHA, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """One row per (source, bucket): documents before it in its source, expected copies and offset in millionths.

    weights: share of the mixture by source; a source that has none gets no copies. Without weights, shares
    follow characters ** alpha. total_chars: size of the mixture; without it, the least mixture in which
    every document of a source with a positive share expects at least one copy."""
    counts = docs.groupBy("__source", "__bucket").agg(F.count("*").alias("n"), F.sum("__chars").alias("chars"))
    by_source = Window.partitionBy("__source")
    before = by_source.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")))
    sources = counts.groupBy("__source").agg(F.sum("chars").cast("double").alias("chars"))
    if weights is None:
        share = F.when(F.col("chars") > 0, F.pow("chars", F.lit(alpha))).otherwise(0.0)
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        share = F.coalesce(F.create_map(*pairs)[F.col("__source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sources = sources.withColumn("share", share)
    if total_chars is None:
        scale = sources.agg(F.max(F.when(F.col("share") > 0, F.col("chars") / F.col("share"))).alias("scale"))
    else:
        scale = sources.agg(F.try_divide(F.lit(float(total_chars)), F.sum("share")).alias("scale"))
    copies = F.when(F.col("chars") > 0, F.coalesce(F.col("scale"), F.lit(0.0)) * F.col("share") / F.col("chars")).otherwise(F.lit(1.0 if weights is None else 0.0))
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "__source")), 1, 7), 16, 10).cast("long") % UNIT
    sources = sources.crossJoin(scale).select("__source", F.floor(copies * UNIT + 0.5).cast("long").alias("each"), offset.alias("offset"))
    return plan.select("__source", "__bucket", "before").join(sources, "__source")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total_chars: float | None = None, alpha: float = ALPHA, seed: str = SEED, buckets: int = BUCKETS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The sampled rows, with the columns of docs (or those in carry) and, if copy_col is given, which copy it is (from 1)."""
    kept = docs.columns if carry is None else carry
    if copy_col in kept:
        raise ValueError(f"there is a column {copy_col} already")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"),
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(source_col), F.lit("")).alias("__source"),
        F.coalesce(F.pmod(F.col(id_col), F.lit(buckets)), F.lit(0)).cast("long").alias("__bucket"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("__chars"),
        F.xxhash64(text_col).alias("__tie"),
    )
    plan = source_plan(keyed, weights, total_chars, alpha, seed, buckets)
    place = Window.partitionBy("__source", "__bucket").orderBy("__id", "__tie")
    placed = keyed.drop("__chars").join(plan, ["__source", "__bucket"]).withColumn("__end", (F.col("before") + F.row_number().over(place)) * F.col("each") + F.col("offset"))
    copies = F.floor(F.col("__end") / UNIT) - F.floor((F.col("__end") - F.col("each")) / UNIT)
    placed = placed.withColumn("__copies", copies.cast("int")).where("__copies > 0")
    out = placed.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    columns = [F.col(f"__row.`{c}`") for c in kept]
    return out.select(*columns, *([F.col("__copy").alias(copy_col)] if copy_col else []))


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(doc_id % {BUCKETS}, 0) AS bucket, coalesce(length(text), 0) AS chars FROM documents
), s AS (
  SELECT source, CAST(sum(chars) AS DOUBLE) AS chars, pow(CAST(sum(chars) AS DOUBLE), {ALPHA}) AS share FROM d GROUP BY source
), e AS (
  SELECT source, CAST(floor((SELECT max(chars / share) FROM s) * share / chars * {UNIT} + 0.5) AS BIGINT) AS each_,
         CAST('0x' || substr(md5('{SEED}|' || source), 1, 7) AS BIGINT) % {UNIT} AS offset_
  FROM s
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY bucket, doc_id) AS place FROM d
), c AS (
  SELECT doc_id, (place * each_ + offset_) // {UNIT} - ((place - 1) * each_ + offset_) // {UNIT} AS copies FROM r JOIN e USING (source)
)
SELECT documents.*, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM c JOIN documents USING (doc_id)
"""
