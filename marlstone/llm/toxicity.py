"""Toxicity by compression distance: windows of a text are compressed with a dictionary of ordinary text and with one of toxic text, and lengths compared.

Both zstandard dictionaries are trained on windows of labelled texts as they are. Most windows of a toxic text are ordinary, so the toxic dictionary is trained again, ROUNDS
times, on just those windows of toxic texts that gain from it as windows of clean texts seldom do (RATIO times as often). The toxic compressor has the toxic
dictionary in front of the ordinary one, so whatever is ordinary costs the same in both, and the gain of a window (compressed bytes with
the ordinary dictionary less those with both) measures what only toxic text holds.

A text's score is the sum over its windows of the gain beyond the window threshold, divided by the square root of the number of windows (plus 4), as chance gains
add up like that. It is toxic if the score exceeds the text threshold.

Labelled rows are split by a hash of their id into two halves. From one, bounded samples are drawn (SAMPLE toxic rows, 3 * SAMPLE clean ones, those of least hashed id): two thirds of them train
dictionaries for each of SETTINGS (size and segment length), on at most TRAINING_WINDOWS windows spread evenly over the texts; the last third chooses among them, and the window threshold.
The text threshold is then the 1 - RATE quantile of the scores of all clean rows of the other half, and at least FLOOR.

Defined cases: a null or empty text, or one without words, has score 0 and is not toxic; a score at the threshold is not toxic. Without toxic or without clean labelled rows to
train on nothing is toxic. A row whose label or id is null, or that has two different labels, doesn't train. Repeated rows and null ids keep their rows. Extra columns are ignored by
`score`. An empty table gives no rows. Every window of a text of any length counts, and words of any length.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, key_filter, slices

SAMPLE = 3000
WINDOW = 16
TRAINED_WINDOW = 10
RATE = 0.006
FLOOR = 0.2
RATIO = 3
ROUNDS = 3
ORDINARY_BYTES = 65536
FIRST_BYTES = 8192
SETTINGS = ((1024, 16), (1536, 12), (1536, 16), (2048, 12))
GAINS = (0, 1)
TRAINING_WINDOWS = 150_000
_EDGES = str.maketrans({c: " " for c in ".,!?;:\"*#$%&()[]{}<>|/\\+=~_^`"})


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(_EDGES).split()


def windows(words: list[str], size: int = WINDOW) -> list[bytes]:
    return [f" {' '.join(words[i : i + size])} ".encode("utf-8", "replace") for i in range(0, len(words), size)]


def _spread(texts: Iterable[str], size: int) -> list[bytes]:
    """Windows of all texts; of more than TRAINING_WINDOWS every second, or third and so on."""
    every = [w for t in texts for w in windows(words_of(t), size)]
    return every[:: len(every) // TRAINING_WINDOWS + 1]


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A trained dictionary, or the samples themselves where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes):
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
    known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=known, compression_params=how).compress


def text_score(gains: np.ndarray, least: float) -> float:
    return float(np.maximum(0, gains - least).sum() / (len(gains) + 4) ** 0.5)


class Judge:
    """Both dictionaries and thresholds; plain data, so it can be broadcast."""

    def __init__(self, ordinary: bytes, toxic: bytes, gain: float = 0.0, threshold: float = FLOOR):
        self.ordinary, self.toxic, self.gain, self.threshold = ordinary, toxic, gain, threshold

    @classmethod
    def train(cls, toxic: list[str], clean: list[str]) -> Judge | None:
        """Dictionaries and the window threshold; two thirds of both lists train, the rest chooses."""
        bad, good = (x[: -(-2 * len(x) // 3)] for x in (toxic, clean))
        choosing = [x[len(y) :] or x for x, y in ((toxic, bad), (clean, good))]
        candidates, familiar = _spread(bad, TRAINED_WINDOW), _spread(good, TRAINED_WINDOW)
        ordinary = _dictionary(_spread(good, 6), ORDINARY_BYTES, 64, 6)
        if not candidates or not ordinary:
            return None
        plain = compressor(ordinary)
        cost, usual = (np.array([len(plain(w)) for w in x]) for x in (candidates, familiar))
        best: tuple[float, float, Judge | None] = (-1.0, 0.0, None)
        for size, k in SETTINGS:
            own = _dictionary(candidates, FIRST_BYTES, k, 8)
            for _ in range(ROUNDS):
                both = compressor(own + ordinary)
                gain = cost - np.array([len(both(w)) for w in candidates])
                chance = usual - np.array([len(both(w)) for w in familiar])
                least = next((g for g in range(1, 64) if (gain >= g).mean() >= RATIO * ((chance >= g).mean() + 1 / max(1, len(chance)))), None)
                if least is None:
                    break
                own = _dictionary([w for w, g in zip(candidates, gain) if g >= least], size, k, 8)
            judge = cls(ordinary, own)
            gains = [[judge.gains(t) for t in x] for x in choosing]
            for least in GAINS:
                bad_scores, good_scores = (np.array([text_score(g, least) for g in x]) for x in gains)
                limit = max(FLOOR, float(np.quantile(good_scores, 1 - RATE)))
                found = float((bad_scores > limit).mean()), float(np.median(bad_scores) - limit)
                if found > best[:2]:
                    best = *found, cls(ordinary, own, least)
        return best[2]

    def compressors(self):
        if not hasattr(self, "_compressors"):
            self._compressors = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return self._compressors

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "gain": self.gain, "threshold": self.threshold}

    def gains(self, text: str | None) -> np.ndarray:
        plain, both = self.compressors()
        return np.array([len(plain(w)) - len(both(w)) for w in windows(words_of(text))], np.int64)

    def score(self, text: str | None) -> tuple[float, int, int]:
        """(score, windows with a gain beyond the window threshold, windows)."""
        gains = self.gains(text)
        return text_score(gains, self.gain), int((gains > self.gain).sum()), len(gains)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Judge | None:
    """A Judge from labelled rows, or None if either class has none to train on."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(toxic_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marks = marks.groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    half = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(2))
    picked = [marks.where((F.col("toxic") == t) & (half == 0)).orderBy(F.xxhash64("id"), "id").limit(many * sample).select("id", "toxic") for t, many in ((1, 1), (0, 3))]
    wanted = F.broadcast(picked[0].union(picked[1]))  # at most 4 * sample rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = texts.join(wanted, "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))

    def fit(batches):  # in one task, so the sample's texts don't pass through the driver
        held = sorted((i, t, x) for b in batches for i, t, x in zip(*(c.to_pylist() for c in b.columns)))
        held = [held[k] for k in np.random.default_rng(1).permutation(len(held))]  # neighbours by id may be alike
        bad, clean = ([x for _, t, x in held if t == kind] for kind in (1, 0))
        judge = Judge.train(bad, clean) if bad and clean else None
        if judge:
            yield pa.record_batch([pa.array([judge.ordinary]), pa.array([judge.toxic]), pa.array([float(judge.gain)])], names=["ordinary", "toxic", "gain"])

    fitted = rows.coalesce(1).mapInArrow(fit, "ordinary binary, toxic binary, gain double").first()
    if not fitted:
        return None
    judge = Judge(bytes(fitted.ordinary), bytes(fitted.toxic), fitted.gain)
    # texts that may be among the rows apart are scored where they are, and only scores are joined
    apart = as_table(marks.where((F.col("toxic") == 0) & (half == 1)).select("id", F.xxhash64("id").alias("th")), "toxicity-apart")
    scores = score(key_filter(apart, texts.where("id is not null").select("id", "text", F.xxhash64("id").alias("th"))), judge, "id")
    scores = scores.join(apart.select(F.col("id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    found = scores.agg(F.percentile_approx("score", 1 - RATE, 100_000)).first()[0]
    judge.threshold = max(FLOOR, found or 0.0)
    return judge


def score(docs: DataFrame, judge: Judge | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (4 decimals), hits, windows, toxic, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        own = shared.value
        for b in slices(batches):
            found = [own.score(t) if own else (0.0, 0, 0) for t in b.column(1).to_pylist()]
            scores, hits, n = zip(*found) if found else ((), (), ())
            scores = np.round(np.array(scores, float), 4)
            toxic = scores > own.threshold if own else np.zeros(len(b), bool)
            yield pa.record_batch([b.column(0), pa.array(scores), pa.array(hits, pa.int32()), pa.array(n, pa.int32()), pa.array(toxic)], names=["doc_id", "score", "hits", "windows", "toxic"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, hits int, windows int, toxic boolean")
