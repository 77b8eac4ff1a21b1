"""Language identification of spans: script ranges narrow the candidates, then Viterbi over per-word scores.

A word is a run of letters or combining marks of one script. Ranges of code points give its script, and that its candidates: scripts of one language decide at once; of scripts
that several languages share (Han, Cyrillic, Arabic, Devanagari) letters that only some of these write (LETTERS) narrow them further; Latin leaves
the trained languages, scored by the word's character pairs and triples (with its borders) under each. Viterbi then finds the labels of all words of a text that score
highest, where each change of language costs `penalty`. Maximal runs of one label are the spans.

Of candidates that share a script the first has score 0 and the others -RARER a word, so a word alone is taken for the first; neighbours decide otherwise, as a change
costs more: Han words between kana are Japanese, others Chinese.

The scores of Latin words are log probabilities, trained on a bounded sample of labelled rows: of each language the SAMPLE rows whose hashed id is least (of rows with one id the least
text), their whole texts. Pairs and triples are counted where the rows are; only counts reach the driver. The languages are those that label rows, or of these just the ones asked for.
Words are never looked up in a list, so a word's cost doesn't grow with the vocabulary.

Defined cases: a null or empty text, or one without letters, has no words, no spans and the language 'und', and is rejected. Between
languages with equal scores the first in alphabetic order wins. Without labelled rows no language is trained, and Latin words are 'und'. A labelled language without Latin words
is not trained. Repeated rows and null ids keep their rows. Extra columns are carried by `keep_known` and ignored by `spans`. An empty table gives no
rows. Texts of any length are labelled whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, slices

SAMPLE = 300
PENALTY = 6.0
LEAST_SHARE = 0.5
BITS = 16
RARER = 0.5
# script ranges: first and last code point, and the languages that a word of that script may have, the likeliest first (empty: the trained ones)
CYRILLIC, ARABIC, DEVANAGARI, HAN = ("ru", "uk", "be", "bg", "sr"), ("ar", "fa", "ur"), ("hi", "mr"), ("zh", "ja")
SCRIPTS = (
    (0x0041, 0x024F, ()), (0x1E00, 0x1EFF, ()), (0xFF21, 0xFF5A, ()), (0x0370, 0x03FF, ("el",)), (0x1F00, 0x1FFF, ("el",)),
    (0x0400, 0x052F, CYRILLIC), (0x0531, 0x058F, ("hy",)), (0x0591, 0x05FF, ("he",)), (0x0600, 0x077F, ARABIC), (0x0900, 0x097F, DEVANAGARI),
    (0x0980, 0x09FF, ("bn",)), (0x0B80, 0x0BFF, ("ta",)), (0x0E00, 0x0E7F, ("th",)), (0x10A0, 0x10FF, ("ka",)), (0x1100, 0x11FF, ("ko",)),
    (0xAC00, 0xD7AF, ("ko",)), (0x3040, 0x30FF, ("ja",)), (0x3400, 0x9FFF, HAN), (0x20000, 0x2FA1F, HAN),
)
# letters (lower case) and the languages of their script that write them
LETTERS = (
    ("ы", ("ru", "be")), ("э", ("ru", "be")), ("ё", ("ru", "be")), ("ъ", ("ru", "bg")), ("щ", ("ru", "uk", "bg")), ("и", ("ru", "uk", "bg", "sr")), ("й", ("ru", "uk", "be", "bg")),
    ("і", ("uk", "be")), ("ї", ("uk",)), ("є", ("uk",)), ("ґ", ("uk",)), ("ў", ("be",)), ("ђ", ("sr",)), ("ј", ("sr",)), ("љ", ("sr",)), ("њ", ("sr",)), ("ћ", ("sr",)), ("џ", ("sr",)),
    ("پ", ("fa", "ur")), ("چ", ("fa", "ur")), ("ژ", ("fa", "ur")), ("گ", ("fa", "ur")), ("ک", ("fa", "ur")), ("ی", ("fa", "ur")), ("ٹ", ("ur",)), ("ڈ", ("ur",)), ("ڑ", ("ur",)),
    ("ں", ("ur",)), ("ے", ("ur",)), ("ھ", ("ur",)), ("ہ", ("ur",)), ("ي", ("ar",)), ("ك", ("ar",)), ("ة", ("ar",)), ("ى", ("ar",)), ("إ", ("ar",)), ("ळ", ("mr",)),
)
SCRIPTED = tuple(sorted({x for *_, names in SCRIPTS for x in names}))
_BAD = -1e4


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 outside words, else 1 + the script's row; the lower case; 0 or 1 + the row in LETTERS. By script, and by letter: the score of each of SCRIPTED."""
    kind, lower, letter = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
    for k, (first, last, _) in enumerate(SCRIPTS):
        for c in range(first, last + 1):
            x = chr(c)
            if x.isalpha() or 0x300 <= c < 0x370 or (not x.isascii() and (x.isidentifier() or ("a" + x).isidentifier()) and not x.isdigit()):
                kind[c] = k + 1
            if len(x.lower()) == 1:
                lower[c] = ord(x.lower())
    kind[0x300:0x370] = 1
    by_script = np.array([[-RARER * min(1, names.index(x)) if x in names else _BAD for x in SCRIPTED] for *_, names in SCRIPTS], np.float32)
    by_letter = np.zeros((len(LETTERS) + 1, len(SCRIPTED)), np.float32)
    for k, (x, names) in enumerate(LETTERS):
        letter[ord(x)] = k + 1
        by_letter[k + 1] = [0 if y in names else _BAD for y in SCRIPTED]
    return kind, lower, letter, by_script, by_letter


_TABLES: list = []


def tables():
    if not _TABLES:
        _TABLES.extend(_tables())
    return _TABLES


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character pairs and triples of the words, borders included, and for each the word it belongs to."""
    n = ends - starts
    offset = np.concatenate([[0], np.cumsum(n + 2)])
    flat = np.zeros(offset[-1], np.uint64)
    word = np.repeat(np.arange(len(n)), n)
    flat[np.arange(len(word)) + 2 * word + 1] = codes[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(word))]
    owner = np.repeat(np.arange(len(n)), n + 2)
    k, m = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    two = ((flat[:-1] * np.uint64(0x10001) + flat[1:]) * k) >> m
    three = (((flat[:-2] * np.uint64(0x10001) + flat[1:-1]) * np.uint64(0x10003) + flat[2:] + np.uint64(7)) * k) >> m
    own2, own3 = owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    return np.concatenate([two[own2], three[own3]]), np.concatenate([owner[:-1][own2], owner[:-2][own3]])


def split_words(texts: list[str]):
    """(lower-case code points, word starts, word ends, words of each text, script of each word)."""
    kind, lower = tables()[:2]
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    here = np.zeros(len(codes) + 1, np.uint8)
    here[1:] = kind[codes]
    edges = np.flatnonzero(here[1:] != here[:-1])
    starts = edges[here[1:][edges] > 0]
    ends = edges[here[:-1][edges] > 0]  # runs touch where the script changes: both lists then hold the border
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return lower[codes], starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0), here[1:][starts] - 1


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often each hashed pair or triple is in the Latin words of the texts."""
    counts = np.zeros(1 << BITS, np.int64)
    latin = np.array([not names for *_, names in SCRIPTS])
    for begin, end in in_pieces(texts):
        codes, starts, ends, _, scripts = split_words(texts[begin:end])
        at = latin[scripts]
        if at.any():
            counts += np.bincount(_grams(codes, starts[at], ends[at])[0].astype(np.int64), minlength=1 << BITS)
    return counts


class Model:
    """Log probabilities of hashed character pairs and triples, by trained language. `names` are all languages that a word may have."""

    def __init__(self, weights: np.ndarray, trained: list[str]):
        self.weights, self.trained = weights, trained
        self.names = sorted({*SCRIPTED, *trained})

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> Model:
        trained = sorted(x for x, c in counts.items() if c.any())
        both = np.stack([counts[x] for x in trained], 1) if trained else np.zeros((1 << BITS, 0))
        return cls(np.log((both + 0.5) / (both.sum(0) + 0.5 * (1 << BITS))).astype(np.float32), trained)

    @classmethod
    def train(cls, rows: list[tuple[str, str]]) -> Model:
        return cls.of_counts({lang: gram_counts([t for x, t in rows if x == lang and t]) for lang in {x for x, _ in rows}})

    def scores(self, codes, starts, ends, scripts) -> np.ndarray:
        """Per word and language of `names`; a language that the word's script or letters exclude gets _BAD."""
        *_, letter, by_script, by_letter = tables()
        out = np.full((len(starts), len(self.names)), np.float32(_BAD))
        column = [self.names.index(x) for x in SCRIPTED]
        latin = np.array([not names for *_, names in SCRIPTS])[scripts]
        at = np.flatnonzero(~latin)
        if len(at):
            own = by_script[scripts[at]]
            marks = letter[codes]
            for k in np.unique(marks[marks > 0]).tolist():  # the words that hold the letter
                before = np.concatenate([[0], np.cumsum(marks == k)])
                own[before[ends[at]] > before[starts[at]]] += by_letter[k]
            out[at[:, None], column] = np.where(own > _BAD / 2, own, np.float32(_BAD))
        at = np.flatnonzero(latin)
        if len(at) and self.trained:
            grams, owner = _grams(codes, starts[at], ends[at])
            for k, lang in enumerate(self.trained):
                out[at, self.names.index(lang)] = np.bincount(owner, self.weights[grams.astype(np.int64), k], minlength=len(at))
        return out


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word; texts advance together, the longest first so that those still open are a prefix."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    sizes = counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    open_at = np.searchsorted(-sizes, -np.arange(longest), side="left")  # how many texts have a word t
    labels = np.zeros(len(scores), np.int8)
    if not longest:
        return labels
    came = np.zeros(scores.shape, np.int8)
    own = np.arange(scores.shape[1], dtype=np.int8)
    best = np.zeros((len(counts), scores.shape[1]), np.float64)
    for t in range(longest):
        n = open_at[t]
        b = best[:n]
        if t:
            top = b.argmax(1)
            switch = np.take_along_axis(b, top[:, None], 1) - penalty
            change = switch > b
            came[first[:n] + t] = np.where(change, top[:, None], own)
            np.maximum(b, switch, out=b)
        b += scores[first[:n] + t]
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = open_at[t]
        at = first[:n] + t
        labels[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return labels


def label_words(texts: list[str], model: Model, penalty: float = PENALTY):
    """(starts, ends, counts, labels into model.names or -1 for 'und', first character of each text) of all words."""
    codes, starts, ends, counts, scripts = split_words(texts)
    bounds = np.cumsum([len(t) + 1 for t in texts])
    begin = np.concatenate([[0], bounds[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    scores = model.scores(codes, starts, ends, scripts)
    known = scores.max(1) > _BAD / 2 if len(scores) else np.zeros(0, bool)
    scores[~known] = 0
    columns = np.flatnonzero((scores > _BAD / 2).any(0) & (scores[known] > _BAD / 2).any(0)) if known.any() else np.zeros(0, int)
    if not len(columns):
        return starts, ends, counts, np.full(len(starts), -1), begin
    labels = columns[viterbi(np.ascontiguousarray(scores[:, columns]), counts, penalty)]
    return starts, ends, counts, np.where(known, labels, -1), begin


SPANS = "doc_id long, span int, begin int, end int, lang string, words int"


def _span_rows(ids: pa.Array, texts: list[str], model: Model, penalty: float) -> pa.RecordBatch:
    starts, ends, counts, labels, begin = label_words(texts, model, penalty)
    named = np.array([*model.names, "und"], object)
    doc = np.repeat(np.arange(len(texts)), counts)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (labels[1:] != labels[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc))[: len(head)] - 1
    owner = doc[head]
    rank = np.arange(len(head)) - np.searchsorted(owner, owner)
    return pa.record_batch(
        [ids.take(pa.array(owner)), pa.array(rank, pa.int32()), pa.array(starts[head] - begin[owner], pa.int32()), pa.array(ends[tail] - begin[owner], pa.int32()), pa.array(named[labels[head]], pa.string()), pa.array(tail - head + 1, pa.int32())],
        names=["doc_id", "span", "begin", "end", "lang", "words"],
    )


def train(labelled: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: Sequence[str] | None = None) -> Model:
    """The model from at most per_language rows of each language. Ids are chosen first, from two narrow columns."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null and lang is not null")
    if languages is not None:
        rows = rows.where(F.col("lang").isin(*languages))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "lang").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).select("id", "lang")
    picked = rows.where("text is not null").join(F.broadcast(chosen), ["id", "lang"]).groupBy("lang", "id").agg(F.min("text").alias("text"))  # at most per_language ids a language

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in slices(batches, 64):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang in set(langs):
                held[lang] = held.get(lang, 0) + gram_counts([t for x, t in zip(langs, texts) if x == lang])
        yield pa.record_batch([pa.array(held, pa.string()), pa.array([c.tobytes() for c in held.values()], pa.binary())], names=["lang", "counts"])

    found = picked.select("lang", "text").repartition(8, "lang").mapInArrow(count, "lang string, counts binary").collect()  # a row for each language
    return Model.of_counts({r.lang: np.frombuffer(r.counts, np.int64) for r in found})


def spans(docs: DataFrame, model: Model, penalty: float = PENALTY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each span of one language: doc_id, span (from 0), begin and end in characters, lang, words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trained))

    def run(batches):
        m = Model(*shared.value)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in in_pieces(texts):
                yield _span_rows(b.column(0).slice(i, j - i), texts[i:j], m, penalty)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SPANS)


def keep_known(docs: DataFrame, model: Model, penalty: float = PENALTY, least_share: float = LEAST_SHARE, text_col: str = "text") -> DataFrame:
    """The rows of docs of which one language has at least least_share of the words. Texts with no words go, and so do those where no language has that share."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.trained))

    def run(batches):
        m = Model(*shared.value)
        for b in slices(batches):
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            keep = np.zeros(len(texts), bool)
            for i, j in in_pieces(texts):
                _, _, counts, labels, _ = label_words(texts[i:j], m, penalty)
                doc = np.repeat(np.arange(j - i), counts)
                wide = len(m.names) + 1
                per = np.bincount(doc * wide + labels + 1, minlength=(j - i) * wide).reshape(j - i, -1)[:, 1:]
                keep[i:j] = (counts > 0) & (per.max(1) >= least_share * counts)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
