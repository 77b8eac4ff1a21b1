"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import languages, lines, mixing, multiindex, ngrams, pieces, replies, toxicity, urls, vafile
from .common import table

QUERIES = "vec_id % 20 = 0"  # the rows that searches take as queries, against all rows


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multiindex.neighbours(vectors, vectors.where(QUERIES))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).where("toxic")


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.conversations(replies.threads(table(spark, sf_dir, "conversations")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), gone_col="lines_gone")


def op6_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors, vectors.where(QUERIES)).drop("reads")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.join(table(spark, sf_dir, "documents"))


def op8_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages.spans(docs, languages.train(docs))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), copy_col="copy")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def all_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def all_reply_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.conversations(replies.threads(table(spark, sf_dir, "conversations")), top=None)


def all_ngram_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.all_pairs(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_reply_trees": replies.SQL, "op4_url_filters": urls.SQL, "op5_line_dedup": lines.SQL, "op6_va_file": vafile.SQL, "op7_ngram_jaccard": ngrams.SQL, "op9_source_mix": mixing.SQL}


def whole_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The full results of operators whose query above returns a chosen part."""
    return {"op2_toxicity_scores": all_toxicity_scores, "op3_reply_trees_all": all_reply_branches, "op7_ngram_jaccard_all": all_ngram_pairs}


def whole_sql() -> dict[str, str]:
    return {"op3_reply_trees_all": replies.ALL_SQL, "op7_ngram_jaccard_all": ngrams.ALL_SQL}
