"""Segmentation: a corpus becomes rows of segments with exact character offsets.

Every segmenter turns columns (source_id, source_hash, ord, text, doc_id, metadata) into (…, parent_id, idx, start, end, text, tokens, metadata,
segment_id), where the source's text from start to end is the segment's text. Cutting is sequential, so it runs in Python over Arrow
batches without a shuffle, few texts at a time; token counts, metadata and ids are made there too (of a Function's segments by expressions).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.identity import canonical_json, digest, merged_metadata, normal_form, segment_id
from ..shared import in_parts

SEPARATORS = ("\n\n", "\n", ". ", ", ", " ", "")
KEPT = ("source_id", "source_hash", "ord")
COLUMNS = (*KEPT, "parent_id", "idx", "start", "end", "text", "tokens", "metadata", "segment_id")
_BREAKS = re.compile("\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]")

Span = tuple[int, int]


def line_spans(text: str) -> Iterator[Span]:
    """Stripped lines that are not empty."""
    begin = 0
    for stop, after in [*(m.span() for m in _BREAKS.finditer(text)), (len(text), 0)]:
        line = text[begin:stop]
        if bare := line.strip():
            lead = begin + len(line) - len(line.lstrip())
            yield lead, lead + len(bare)
        begin = after


def _pieces(text: str, begin: int, stop: int, ladder: Sequence[str], small: Callable[[int, int], bool]) -> Iterator[Span]:
    """Pieces between the first separator of the ladder that occurs; those not small are cut by the finer ones."""
    level = next((k for k, s in enumerate(ladder) if not s or text.find(s, begin, stop) >= 0), None)
    if level is None:
        yield begin, stop
        return
    mark, finer = ladder[level], ladder[level + 1 :]
    if not mark:
        yield from ((i, i + 1) for i in range(begin, stop))
        return
    at = begin
    while at <= stop:
        found = text.find(mark, at, stop)
        end = stop if found < 0 else found
        if at < end:
            if finer and not small(at, end):
                yield from _pieces(text, at, end, finer, small)
            else:
                yield at, end
        if found < 0:
            break
        at = found + len(mark)


def _packed(spans: list[Span], weights: list[int], size: int, overlap: int) -> Iterator[Span]:
    """Runs of pieces of at most `size` in all. A run begins with the last pieces of the one before, of up to `overlap` in all, one at least
    (but never all of them); a run of nothing else is left out. What is carried isn't counted against `size` again before the next piece."""
    first = fresh = total = 0
    for i, w in enumerate(weights):
        if i > first and total + w > size:
            if fresh < i:
                yield spans[first][0], spans[i - 1][1]
            keep = i
            total = 0
            if overlap and i - first > 1:
                keep, total = i - 1, weights[i - 1]
                while keep - 1 > first and total + weights[keep - 1] <= overlap:
                    keep -= 1
                    total += weights[keep]
            first, fresh = keep, i
        total += w
    if spans and fresh < len(spans):
        yield spans[first][0], spans[-1][1]


def recursive_spans(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS, count: Callable[[str], int] | None = None) -> list[Span]:
    if not text:
        return []
    if count is None:  # by length alone: no slices
        weigh = lambda a, b: max(1, round((b - a) / 4))
    else:
        weigh = lambda a, b: count(text[a:b])
    spans = list(_pieces(text, 0, len(text), tuple(separators), lambda a, b: weigh(a, b) <= size))
    return list(_packed(spans, [weigh(a, b) for a, b in spans], size, overlap))


class Segmenter:
    """What all segmenters share: `identity` names one in configurations, `cut` gives the spans of a text."""

    identity = "segmenter"
    tokenizer = T.TOKENIZER
    count: Callable[[str], int] | None = None

    def cut(self, text: str) -> Iterable[Span]:
        raise NotImplementedError

    def _finished(self, rows: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        tokens = T.approx_tokens(F.col("text")) if self.count is None else F.col("tokens")
        label = canonical_json({"tokenizer": self.tokenizer})
        rows = rows.withColumns({"tokens": tokens, "metadata": merged_metadata(F.col("metadata"), label)})
        return rows.withColumn("segment_id", segment_id(F.col("text"), F.col("metadata"))).select(*COLUMNS, *extra)

    def segments(self, sources: DataFrame) -> DataFrame:
        """Segments of a corpus; a null or empty text has none."""

        label = canonical_json({"tokenizer": self.tokenizer})
        joined = lambda m: label if m in (None, "{}") else canonical_json({**json.loads(m), **json.loads(label)})

        def run(batches):
            for b in in_parts(batches):
                at, idx, starts, ends, texts, tokens, ids = [], [], [], [], [], [], []
                metadata = [joined(m) for m in b.column("metadata").to_pylist()]
                for k, t in enumerate(b.column("text").to_pylist()):
                    for i, (u, v) in enumerate(self.cut(t) if t else ()):
                        at.append(k)
                        idx.append(i)
                        starts.append(u)
                        ends.append(v)
                        texts.append(t[u:v])
                        tokens.append((self.count or T.count_tokens)(t[u:v]))
                        ids.append(digest(normal_form(t[u:v]) + metadata[k]))
                rows = pa.array(at, pa.int64())
                own = [b.column(c).take(rows) for c in (*KEPT, "doc_id")]
                yield pa.record_batch(
                    [*own, *(pa.array(x, pa.int32()) for x in (idx, starts, ends)), pa.array(texts, pa.string()), pa.array(tokens, pa.int32()), pa.array(metadata, pa.string()).take(rows), pa.array(ids, pa.string())],
                    names=COLUMNS,
                )

        kind = "source_id string, source_hash string, ord long, parent_id string, idx int, start int, end int, text string, tokens int, metadata string, segment_id string"
        return sources.select(*KEPT, "doc_id", "metadata", "text").mapInArrow(run, kind)


class Lines(Segmenter):
    identity = "line-segmenter"

    def cut(self, text):
        return line_spans(text)

    def texts(self, sources: DataFrame) -> DataFrame:
        """The same lines without offsets, by expressions alone: source_id, idx, text, tokens, segment_id (of sources without metadata)."""
        lines = F.filter(F.transform(T.line_array(F.col("text")), T.stripped), lambda x: x != "")
        rows = sources.select("source_id", F.posexplode(lines).alias("idx", "text"))
        return rows.withColumns({"tokens": T.approx_tokens(F.col("text")), "segment_id": segment_id(F.col("text"), F.lit(canonical_json({"tokenizer": T.TOKENIZER})))})


class Recursive(Segmenter):
    """Paragraphs, lines, sentences, clauses, words, characters: the coarsest cut whose pieces fit, packed into chunks with overlap."""

    def __init__(self, size: int = 512, overlap: int = 64, separators: Sequence[str] = SEPARATORS, count: Callable[[str], int] | None = None, tokenizer: str = T.TOKENIZER):
        if size <= 0 or not 0 <= overlap < size:
            raise ValueError("a chunk's size must be positive and the overlap less than it, not negative")
        self.size, self.overlap, self.separators, self.count, self.tokenizer = size, overlap, tuple(separators), count, tokenizer
        self.identity = "recursive:" + canonical_json({"overlap": overlap, "separators": list(separators), "size": size, "tokenizer": tokenizer})

    def cut(self, text):
        return recursive_spans(text, self.size, self.overlap, self.separators, self.count)


class Function(Segmenter):
    """A function of a text (of the whole source as a mapping if pass_source) that gives texts or mappings. Offsets are found from left to right."""

    def __init__(self, func: Callable, identity: str | None = None, pass_source: bool = False, count: Callable[[str], int] = T.count_tokens, tokenizer: str = T.TOKENIZER):
        name = getattr(func, "__qualname__", "")
        if identity is None and (not name or "<lambda>" in name):
            raise ValueError("a segmenter without a name of its own needs an identity")
        self.func, self.pass_source, self.count, self.tokenizer = func, pass_source, count, tokenizer
        self.identity = identity or f"{func.__module__}.{name}"

    def _items(self, source: str | Mapping) -> list[dict]:
        text = source if isinstance(source, str) else source.get("text", "")
        found = self.func(source if self.pass_source else text)
        found = [found] if isinstance(found, (str, Mapping)) else found
        out, cursor = [], 0
        for item in found:
            if isinstance(item, str):
                if not item:
                    continue
                at = text.find(item, cursor)
                where = {"start": at, "end": at + len(item)} if at >= 0 else {}
                cursor = at + len(item) if at >= 0 else cursor
                item = {"text": item, **where}
            out.append({"index": len(out), "tokens": self.count(item["text"]), **item})
        return out

    def segments(self, sources: DataFrame) -> DataFrame:
        def run(batches):
            for b in in_parts(batches):
                rows = []
                for r in b.to_pylist():
                    if r["text"] is None:
                        continue
                    meta = json.loads(r["metadata"] or "{}")
                    source = {"text": r["text"], "metadata": meta, **({"id": r["doc_id"]} if r["doc_id"] is not None else {})}
                    for s in self._items(source if self.pass_source else r["text"]):
                        own = canonical_json({**meta, **(s.get("metadata") or {})})
                        parent = s.get("parent_id", r["doc_id"])
                        rows.append((r["source_id"], r["source_hash"], r["ord"], parent, own, s["index"], s.get("start"), s.get("end"), s["tokens"], s["text"], s.get("id")))
                columns = zip(*rows) if rows else [()] * 11
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=[*KEPT, "parent_id", "metadata", "idx", "start", "end", "tokens", "text", "given"])

        kind = "source_id string, source_hash string, ord long, parent_id string, metadata string, idx int, start int, end int, tokens int, text string, given string"
        rows = sources.select(*KEPT, "doc_id", "metadata", "text").mapInArrow(run, kind)
        return self._finished(rows, ["given"]).withColumn("segment_id", F.coalesce("given", "segment_id")).drop("given")


def with_overlap(segments: DataFrame, sources: DataFrame, n_chars: int) -> DataFrame:
    """Every segment with offsets reaches n_chars further, to the end of its source at most; ids and tokens follow."""
    if n_chars < 0:
        raise ValueError("an overlap can't be negative")
    whole = sources.select("source_id", F.col("text").alias("__whole"))
    known = F.col("start").isNotNull() & F.col("end").isNotNull()
    stop = F.least(F.length("__whole"), F.col("end") + n_chars)
    rows = segments.join(whole, "source_id", "left").withColumn("__stop", F.when(known, stop))
    rows = rows.withColumn("text", F.when(known, F.substring("__whole", F.col("start") + 1, F.col("__stop") - F.col("start"))).otherwise(F.col("text")))
    rows = rows.withColumns({
        "end": F.when(known, F.col("__stop")).otherwise(F.col("end")),
        "tokens": F.when(known & F.col("tokens").isNotNull(), T.approx_tokens(F.col("text"))).otherwise(F.col("tokens")),
        "segment_id": F.when(known, segment_id(F.col("text"), F.col("metadata"))).otherwise(F.col("segment_id")),
    })
    return rows.select(segments.columns)


def hierarchical(segmenters: Sequence[Segmenter], sources: DataFrame) -> DataFrame:
    """The segments of each level in turn: a level cuts the segments of the one before, whose ids its segments have as parent. Offsets stay
    those of the source, but metadata is not passed down. An extra column `level` counts from 0."""
    if not segmenters:
        raise ValueError("at least one segmenter is needed")
    out = now = segmenters[0].segments(sources).withColumn("level", F.lit(0))
    for level, segmenter in enumerate(segmenters[1:], 1):
        key = F.concat_ws("|", "source_id", F.col("level").cast("string"), F.col("idx").cast("string"))
        above = now.withColumn("above", key)
        texts = above.select(F.col("above").alias("source_id"), "source_hash", "ord", "text", F.col("segment_id").alias("doc_id"), F.lit("{}").alias("metadata"))
        below = segmenter.segments(texts).withColumnRenamed("source_id", "above")
        base = above.select("above", F.col("source_id"), F.col("start").alias("base"), F.col("idx").alias("above_idx"))
        below = below.join(base, "above").withColumns({"start": F.col("start") + F.coalesce("base", F.lit(0)), "end": F.col("end") + F.coalesce("base", F.lit(0)), "level": F.lit(level)})
        now = below.select(*COLUMNS, "level")
        out = out.unionByName(now)
    return out


_NAMES: dict[str, Callable[..., Segmenter]] = {}


def register_segmenter(name: str, make: Callable[..., Segmenter]) -> None:
    _NAMES[name.strip().lower()] = make


for _n in ("default", "recursive", "recursive-character"):
    register_segmenter(_n, Recursive)
for _n in ("line", "lines", "line-segmenter"):
    register_segmenter(_n, Lines)


def as_segmenter(x=None, **options) -> Segmenter:
    """A segmenter from nothing (the default), a name, a segmenter or a function."""
    if x is None:
        return Recursive(**options)
    if isinstance(x, Segmenter):
        return x
    if isinstance(x, str):
        make = _NAMES.get(x.strip().lower())
        if make is None:
            raise ValueError(f"no segmenter is registered as {x!r}; there are {sorted(_NAMES)}")
        return make(**options)
    if callable(x):
        return Function(x, **options)
    raise TypeError(f"no segmenter can be made of {type(x).__name__}")


def make_segment(text: Column, metadata: Column | None = None, id: Column | None = None, **fields: Column) -> Column:
    """A segment as a struct; null fields are absent ones, and an id that is null follows from the text and metadata."""
    meta = metadata if metadata is not None else F.lit("{}")
    own = segment_id(text, meta)
    return F.struct(text.alias("text"), F.coalesce(id, own).alias("id") if id is not None else own.alias("id"), meta.alias("metadata"), *[c.alias(k) for k, c in fields.items()])


def as_segments(rows: DataFrame, **defaults) -> DataFrame:
    """Rows as segments: `defaults` fill what is null or missing; a text column is needed."""
    if "text" not in rows.columns:
        raise ValueError("a segment needs a text")
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    meta = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in rows.columns else F.lit("{}")
    own = segment_id(F.col("text"), meta)
    return rows.withColumns({"metadata": meta, "segment_id": F.coalesce(F.col("segment_id"), own) if "segment_id" in rows.columns else own})
