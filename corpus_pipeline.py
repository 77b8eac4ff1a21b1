"""The corpus pipeline: five stages over documents, each a function (spark, docs, sf_dir) -> DataFrame.

1. language: labels spans of languages in every text; a document without words, or of which no language has half the words, goes.
2. lines: lines within one edit of an earlier line go; documents of which no line stays go.
3. near copies: of documents connected by n-gram Jaccard similarity one stays, the least id.
4. mix: documents are repeated so that sources reach their target shares; every document is expected at least once.
5. tokens: the ids of each document's text.

All but the last keep the columns of documents. A stage handles nulls, empty texts, ties, repeated rows, empty tables and extra columns as its
operator says; extra columns are carried through to the last stage.
"""

from marlstone.llm import languages, lines, mixing, ngrams, pieces
from marlstone.llm.common import as_table, table


def language(spark, docs, sf_dir):
    return languages.keep_known(docs, languages.train(docs))


def line_dedup(spark, docs, sf_dir):
    return lines.dedup_lines(docs)


def near_copies(spark, docs, sf_dir):
    return ngrams.keep_one(docs)


def mix(spark, docs, sf_dir):
    return mixing.mix(docs)


def tokens(spark, docs, sf_dir):
    return pieces.encode(docs)


STAGES = [("language", language), ("line dedup", line_dedup), ("near copies", near_copies), ("source mix", mix), ("tokens", tokens)]

#: Language labels and token ids are beyond SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = as_table(docs, "stage-" + name.replace(" ", "-"))
    return docs
