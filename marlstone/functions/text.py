"""Text expressions: approximate tokens, stripped lines, answers, n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZER = "char-approx"
TERMINATORS = r"\r\n|[\n\r\x{B}\x{C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
PUNCTUATION = r"""[!-/:-@\[-`{-~]"""


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded half to even, at least 1; 0 for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("int")))


def count_tokens(text: str) -> int:
    return round(max(len(text), 4) / 4) if text else 0


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends; Spark's trim knows only spaces."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def line_array(text: Column) -> Column:
    return F.split(text, TERMINATORS, -1)


def normal_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "), r"(?U)[\s\x1c-\x1f]+", " "))


def answer_tokens(text: Column) -> Column:
    """Words of the normal answer; none for an empty one."""
    return F.filter(F.split(normal_answer(text), " "), lambda w: w != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), F.lit(1))


def ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of `low` to `high` words joined by a space, shorter runs first. Runs of n are those of n - 1 zipped with the words that follow."""
    runs, grams = tokens, [tokens] if low == 1 else []
    for n in range(2, high + 1):
        left = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        runs = F.zip_with(F.slice(runs, F.lit(1), left), F.slice(tokens, F.lit(n), left), lambda a, b: F.concat_ws(" ", a, b))
        if n >= low:
            grams.append(runs)
    return F.concat(*grams)


def counted(rows: DataFrame, key: str, items: str) -> DataFrame:
    """key, item, times: how often each row's array of strings holds each of its items. An array is sorted in its row and its runs are counted, so nothing is
    shuffled or held beyond a row."""
    rows = rows.select(key, F.sort_array(items).alias("__all"))
    every = F.sequence(F.lit(0), F.greatest(F.size("__all") - 1, F.lit(0)))
    first = lambda i: (i < F.size("__all")) & ((i == 0) | (F.get("__all", i) != F.get("__all", i - 1)))
    rows = rows.select(key, "__all", F.filter(every, first).alias("__at"))
    after = F.concat(F.slice("__at", F.lit(2), F.greatest(F.size("__at") - 1, F.lit(0))), F.array(F.size("__all")))
    runs = F.zip_with("__at", after, lambda a, b: F.struct(F.get("__all", a).alias("item"), (b - a).cast("long").alias("times")))
    # a filter before the explode would be moved below the projections with all that they compute, and explode brings one of its own
    return rows.select(key, F.explode_outer(runs).alias("__run")).where("__run.item is not null").select(key, "__run.item", "__run.times")
