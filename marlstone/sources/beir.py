"""Retrieval benchmarks on disk: corpus.jsonl, queries.jsonl and a table of judgements; and the export of answer samples."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGEMENTS = tuple(f"{place}.tsv" for place in ("qrels", "qrels/test", "qrels/dev"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON line; blank lines are passed over."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r"), F.monotonically_increasing_id().alias("line")).select("r.*", "line")


def judgements_path(directory: str, given: str | None = None) -> str:
    if given is not None:
        path = given if os.path.isabs(given) else os.path.join(directory, given)
        if os.path.exists(path):
            return path
        raise FileNotFoundError(path)
    for name in JUDGEMENTS:
        if os.path.exists(path := os.path.join(directory, name)):
            return path
    raise FileNotFoundError(f"none of {', '.join(JUDGEMENTS)} in {directory}")


def read_judgements(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance. Lines of under three fields or without a number (a header) are passed over; the last of equal keys stands."""
    fields = spark.read.text(path).select(F.split("value", "\t").alias("f"), F.monotonically_increasing_id().alias("line")).where(F.size("f") >= 3)
    rows = fields.select(F.col("f")[0].alias("query_id"), F.col("f")[1].alias("doc_id"), F.expr("try_cast(f[2] AS double)").alias("relevance"), "line").where("relevance is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("relevance", "line").alias("relevance"))


def read_beir(spark: SparkSession, directory: str, qrels: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus: doc_id, text; queries: query_id, text; judgements). A title stands on a line of its own before the text."""
    kind = "_id string, id string, title string, text string"
    key = F.coalesce("_id", "id")

    def last(name: str, text, alias: str) -> DataFrame:
        rows = read_jsonl(spark, os.path.join(directory, name), kind)
        return rows.select(key.alias(alias), text.alias("text"), "line").groupBy(alias).agg(F.max_by("text", "line").alias("text"))

    title, body = F.trim(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("text", F.lit("")))
    whole = F.when(title == "", body).otherwise(F.trim(F.concat_ws("\n", title, body)))
    return last("corpus.jsonl", whole, "doc_id"), last("queries.jsonl", F.coalesce("text", F.lit("")), "query_id"), read_judgements(spark, judgements_path(directory, qrels))


def _single_file(df: DataFrame, path: Path) -> None:
    """df, of one string column `value`, as one file; rows are streamed by way of the driver, never held there at once."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as out:
        for r in df.toLocalIterator():
            out.write(r.value + "\n")


def write_beir(directory: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> str:
    """The same layout written; titles are empty."""
    os.makedirs(directory, exist_ok=True)
    root = Path(directory)
    for name, df, key in (("corpus.jsonl", corpus, "doc_id"), ("queries.jsonl", queries, "query_id")):
        (root / name).unlink(missing_ok=True)
        fields = [F.col(key).cast("string").alias("_id"), *([F.lit("").alias("title")] if key == "doc_id" else []), F.coalesce("text", F.lit("")).alias("text")]
        _single_file(df.orderBy(key).select(F.to_json(F.struct(*fields)).alias("value")), root / name)
    (root / JUDGEMENTS[0]).write_text("\t".join(("query-id", "corpus-id", "score")) + "\n")
    grade = F.when(F.col("relevance") == F.floor("relevance"), F.col("relevance").cast("long").cast("string")).otherwise(F.col("relevance").cast("string"))
    _single_file(qrels.orderBy("query_id", "doc_id").select(F.concat_ws("\t", "query_id", "doc_id", grade).alias("value")), root / "qrels.tsv")
    return str(root)


def as_ragas_dataset(samples: DataFrame | Iterable[Mapping]):
    """An evaluation dataset of the ragas library, if it is installed."""
    try:
        from ragas import EvaluationDataset
    except ImportError as e:
        raise ImportError("exporting samples needs the ragas package") from e
    rows = [r.asDict(recursive=True) for r in samples.toLocalIterator()] if isinstance(samples, DataFrame) else [dict(s) for s in samples]
    return EvaluationDataset.from_list([{k: v for k, v in r.items() if v is not None} for r in rows])
