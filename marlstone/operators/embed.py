"""Embedders: callables from texts to float32 rows, and the columns and tables that Spark makes of them.

An embedder is called on the texts of an Arrow batch, sorted by length where that saves padding; rows keep their identity, so nothing is put
back in order afterwards. `embedded` adds its vectors as a column, `cached` does so through a table of vectors already made.
"""

from __future__ import annotations

import json
import math
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections import Counter
from collections.abc import Callable, Hashable, Iterable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import cache_key
from ..shared import in_parts


class EmbedderError(RuntimeError):
    """An embedder gave the wrong shape, or its service refused."""


@dataclass(frozen=True)
class BatchHandle:
    """An embedding job: poll() says pending, done or failed, result() waits for the array or raises, cancel() gives up what has not begun."""

    poll: Callable[[], str]
    result: Callable[[], np.ndarray]
    cancel: Callable[[], None] = lambda: None


def ready_handle(array) -> BatchHandle:
    out = np.asarray(array, np.float32)
    return BatchHandle(lambda: "done", lambda: out)


def _handle_of(job: Future) -> BatchHandle:
    def poll() -> str:
        if not job.done():
            return "pending"
        return "failed" if job.cancelled() or job.exception() else "done"

    return BatchHandle(poll, job.result, lambda: job.cancel() and None)


class Embedder:
    model_id = "embedder"
    dim: int | None = None
    normalized = False
    honored_input_types: tuple[str, ...] = ()

    def __call__(self, texts: Iterable[str], input_type: str | None = None) -> np.ndarray:
        raise NotImplementedError

    def checked(self, texts: Sequence[str], input_type: str | None = None) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, self.dim or 0), np.float32)
        out = np.asarray(self(texts, input_type=input_type), np.float32)
        wanted = (len(texts), self.dim if self.dim is not None or out.ndim != 2 else out.shape[1])
        if out.shape != wanted:
            raise EmbedderError(f"{self.model_id} gave an array of shape {out.shape} instead of {wanted}")
        return out

    def embed_batch(self, texts: Iterable[str], input_type: str | None = None, background: bool = False) -> BatchHandle:
        """The texts' vectors behind a handle: made at once, or by a thread of the calling process."""
        texts = list(texts)
        if not background:
            return ready_handle(self.checked(texts, input_type))
        worker = ThreadPoolExecutor(1)
        job = worker.submit(self.checked, texts, input_type)
        worker.shutdown(wait=False)
        return _handle_of(job)

    def __repr__(self):
        return f"{type(self).__name__}({self.model_id!r}, dim={self.dim})"


class FunctionEmbedder(Embedder):
    """An embedder from a function of a list of texts."""

    def __init__(self, func, model_id=None, dim=None, normalized=False, honored_input_types=(), pass_input_type=False):
        self.func, self.dim, self.normalized, self.pass_input_type = func, dim, normalized, pass_input_type
        name = getattr(func, "__name__", "embed")
        self.model_id = model_id or "function:" + name
        self.honored_input_types = tuple(honored_input_types)

    def __call__(self, texts, input_type=None):
        texts = list(texts)
        if not texts:
            return np.zeros((0, self.dim or 0), np.float32)
        out = np.asarray(self.func(texts, input_type=input_type) if self.pass_input_type else self.func(texts), np.float32)
        if self.dim is None and out.ndim == 2:
            self.dim = out.shape[1]
        return out


_WORDS = re.compile(r"\w+")
#: Grams whose places a hashing embedder remembers.
MOST_KNOWN = 50_000


class HashingEmbedder(Embedder):
    """Words and runs of words hashed into signed buckets, weighted by frequency, of length 1. A text without words is the zero vector."""

    normalized = True

    def __init__(self, dim=512, ngram_range=(1, 2), sublinear_tf=True):
        low, high = ngram_range
        if dim < 1 or not 1 <= low <= high:
            raise ValueError(f"dim must be positive and the range of n-grams ascending from 1: {dim}, {ngram_range}")
        self.dim, self.low, self.high, self.sublinear = int(dim), int(low), int(high), bool(sublinear_tf)
        special = ("" if (low, high) == (1, 2) else f"-ng{low}_{high}") + ("" if sublinear_tf else "-tflin")
        self.model_id = f"hashing:v1{special}@{dim}"
        self._known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}}

    def _place(self, gram: str) -> tuple[int, float]:
        place = self._known.get(gram)
        if place is None:
            h = int.from_bytes(blake2b(gram.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            place = ((h >> 1) % self.dim, 1.0 if h & 1 else -1.0)
            if len(self._known) < MOST_KNOWN:
                self._known[gram] = place
        return place

    def _grams(self, text: str) -> Counter:
        words = _WORDS.findall(text.lower())
        found: Counter = Counter()
        for n in range(self.low, self.high + 1):
            found.update(words if n == 1 else (" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
        return found

    def __call__(self, texts, input_type=None):
        texts = list(texts)
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):  # one text's grams at a time
            grams = self._grams(text)
            if not grams:
                continue
            places = [self._place(g) for g in grams]
            weights = [1.0 + math.log(c) for c in grams.values()] if self.sublinear else list(map(float, grams.values()))
            signed = np.array([s * w for (_, s), w in zip(places, weights)], np.float32)
            np.add.at(row, np.array([b for b, _ in places]), signed)  # one by one, in the order of first occurrence
            size = float(np.linalg.norm(row))
            if size > 0:
                row /= size
        return out


class _Around(Embedder):
    """An embedder that passes on what it is made of."""

    def __init__(self, inner: Embedder):
        self.inner = inner

    model_id = property(lambda self: self.inner.model_id)
    dim = property(lambda self: self.inner.dim)
    normalized = property(lambda self: self.inner.normalized)
    honored_input_types = property(lambda self: self.inner.honored_input_types)


class NormalizingEmbedder(_Around):
    """Vectors of length 1; zero vectors stay."""

    normalized = True

    def __call__(self, texts, input_type=None):
        out = np.asarray(self.inner(texts, input_type=input_type), np.float32)
        size = np.linalg.norm(out, axis=1, keepdims=True) if len(out) else np.ones((0, 1), np.float32)
        return out / np.where(size > 0, size, 1)


class CachedEmbedder(_Around):
    """Vectors by key in a mutable mapping, for use on the driver; see `cached` for tables. Queries are not looked up unless asked for."""

    def __init__(self, inner: Embedder, store, cache_queries: bool = False):
        super().__init__(inner)
        self.store, self.cache_queries = store, cache_queries

    def _key(self, text: str, input_type: str | None) -> str:
        from ..functions.identity import digest

        return f"{self.model_id}/" + digest(f"{self.model_id}|{self.normalized}|{input_type}|{text}")

    def __call__(self, texts, input_type=None):
        texts = list(texts)
        if input_type == "query" and not self.cache_queries:
            return self.inner(texts, input_type=input_type)
        keys = [self._key(t, input_type) for t in texts]
        missing = [i for i, k in enumerate(keys) if k not in self.store]
        if missing:
            for i, v in zip(missing, self.inner([texts[i] for i in missing], input_type=input_type)):
                self.store[keys[i]] = np.asarray(v, np.float32)
        return np.stack([self.store[k] for k in keys]) if keys else np.zeros((0, self.dim or 0), np.float32)


def retryable(error: BaseException) -> bool:
    codes = [c for c in (getattr(error, n, None) for n in ("status_code", "code")) if isinstance(c, int) and c]
    if codes:
        return codes[0] >= 500 or codes[0] == 429
    return isinstance(error, (ConnectionError, TimeoutError, urllib.error.URLError))


@dataclass(frozen=True)
class RetryPolicy:
    jitter: float = 0.3
    max_attempts: int = 4
    max_delay: float = 30.0
    base_delay: float = 1.0
    retry_on: Callable[[BaseException], bool] = field(default=retryable)


class RetryingEmbedder(_Around):
    """Tries again inside the task, since a retried task would embed its whole partition anew."""

    def __init__(self, inner, policy=None, sleep=time.sleep):
        super().__init__(inner)
        self.policy, self.sleep = policy or RetryPolicy(), sleep

    def __call__(self, texts, input_type=None):
        texts, p = list(texts), self.policy
        for attempt in range(1, p.max_attempts + 1):
            try:
                return self.inner(texts, input_type=input_type)
            except Exception as e:
                if attempt == p.max_attempts or not p.retry_on(e):
                    raise
                wait = min(p.max_delay, p.base_delay * 2 ** (attempt - 1))
                self.sleep(wait * (1 + p.jitter * random.random()))
        raise ValueError("max_attempts must be at least 1")


class MultiEmbedder(Embedder):
    """Each text goes to the embedder that the predicate names."""

    def __init__(self, routes, predicate, default=None):
        if not routes and default is None:
            raise ValueError("at least one route is needed")
        self.routes, self.predicate, self.default = dict(routes), predicate, default
        every = [*self.routes.values(), *([default] if default else [])]
        known = sorted({e.dim for e in every} - {None})
        if known[1:]:
            raise ValueError(f"routes differ in dimensions: {known}")
        self.dim = known[0] if known else None
        self.normalized = all(e.normalized for e in every)
        self.model_id = f"multi({'|'.join(dict.fromkeys(e.model_id for e in every))})"
        self.honored_input_types = tuple(sorted(set.intersection(*(set(e.honored_input_types) for e in every))))

    def __call__(self, texts, input_type=None):
        texts = list(texts)
        groups: dict[Hashable, list[int]] = {}
        for i, t in enumerate(texts):
            groups.setdefault(self.predicate(t), []).append(i)
        out: np.ndarray | None = None
        for key, at in groups.items():
            to = self.routes.get(key, self.default)
            if to is None:
                raise EmbedderError(f"no route for {key!r} and no default")
            part = np.asarray(to([texts[i] for i in at], input_type=input_type), np.float32)
            if out is None:
                out = np.zeros((len(texts), part.shape[1]), np.float32)
            out[at] = part
        return out if out is not None else np.zeros((0, self.dim or 0), np.float32)


# services


def post_json(url: str, payload, headers: Mapping[str, str], timeout: float):
    asked = urllib.request.Request(url, payload if isinstance(payload, bytes) else json.dumps(payload).encode())
    for name, value in [("Content-Type", "application/json"), *headers.items()]:
        asked.add_header(name, value)
    try:
        reply = urllib.request.urlopen(asked, None, timeout)
    except urllib.error.HTTPError as e:
        failure = EmbedderError(f"{url} answered {e.code}: {e.read()[:300]!r}")
        failure.status_code = e.code
        raise failure from e
    with reply:
        return json.loads(reply.read())


class ServiceEmbedder(Embedder):
    """Texts in requests of at most `batch_size`; `build` makes a payload and `parse` finds the vectors in the answer. The key is read in the
    worker from the environment unless it is given, and never shows in a plan."""

    def __init__(self, model_id: str, url: str, build: Callable, parse: Callable, batch_size: int, dim: int | None = None, normalized: bool = False, key: str | None = None, key_names: Sequence[str] = (), auth: tuple[str, str] = ("Authorization", "Bearer "), headers: Mapping[str, str] | None = None, timeout: float = 60.0, honored: Iterable[str] = (), send: Callable = post_json):
        self.model_id, self.url, self.build, self.parse, self.batch_size, self.dim, self.normalized = model_id, url, build, parse, batch_size, dim, normalized
        self.key, self.key_names, self.auth, self.headers, self.timeout, self.send = key, tuple(key_names), auth, dict(headers or {}), timeout, send
        self.honored_input_types = tuple(honored)

    def _head(self) -> dict[str, str]:
        if not self.key_names:
            return self.headers
        key = self.key or next((os.environ[n] for n in self.key_names if os.environ.get(n)), None)
        if not key:
            raise EmbedderError(f"{self.model_id} needs an API key: pass it or set {' or '.join(self.key_names)}")
        return {**self.headers, self.auth[0]: self.auth[1] + key}

    def __call__(self, texts, input_type=None):
        waiting, head, rows = list(texts), self._head(), []
        while waiting:
            part, waiting = waiting[: self.batch_size], waiting[self.batch_size :]
            got = self.parse(self.send(self.url, self.build(part, input_type), headers=head, timeout=self.timeout))
            if len(got) != len(part):
                raise EmbedderError(f"{self.model_id}: {len(part)} texts, {len(got)} vectors")
            rows.extend(got)
        out = np.asarray(rows, np.float32) if rows else np.zeros((0, self.dim or 0), np.float32)
        if self.dim is None and len(out):
            self.dim = out.shape[1]
        return out


def http_embedder(url, model_id=None, dim=None, normalized=False, batch_size=64, headers=None, timeout=30.0, payload_builder=None, response_parser=None, send=post_json) -> Embedder:
    build = (lambda texts, _: payload_builder(texts)) if payload_builder else (lambda texts, _: {"inputs": list(texts)})
    return ServiceEmbedder(model_id or f"http:{url}", url, build, response_parser or (lambda r: r), batch_size, dim, normalized, headers=headers, timeout=timeout, send=send)


OPENAI, COHERE, VOYAGE, GEMINI = "text-embedding-3-small", "embed-v4.0", "voyage-3.5", "gemini-embedding-001"
PURPOSES = ("document", "query", "classification", "clustering")


def _sizes(spec: str) -> tuple[dict[str, int], set[str]]:
    """Dimensions by model from `model=size ...`; those with a star can be cut shorter."""
    pairs = [x.split("=") for x in spec.split()]
    return {m: int(n.rstrip("*")) for m, n in pairs}, {m for m, n in pairs if n.endswith("*")}


def _dim(model: str, dim: int | None, sizes: tuple[dict[str, int], set[str]]) -> tuple[int | None, bool]:
    """(dimensions, whether they are fewer than the model's own)."""
    native, shortened = sizes
    own = native.get(model)
    if dim is None or dim == own:
        return own, False
    if model not in shortened:
        raise ValueError(f"{model} has no other number of dimensions than {own}")
    return dim, True


def openai_embedder(model=OPENAI, dim=None, api_key=None, batch_size=2048, send=post_json) -> Embedder:
    size, cut = _dim(model, dim, _sizes("text-embedding-3-small=1536* text-embedding-3-large=3072* text-embedding-ada-002=1536"))
    build = lambda texts, _: {"model": model, "input": list(texts), **({"dimensions": size} if cut else {})}
    parse = lambda r: [d["embedding"] for d in sorted(r["data"], key=lambda d: d["index"])]
    return ServiceEmbedder(f"openai:{model}" + (f"@{size}" if cut else ""), "https://api.openai.com/v1/embeddings", build, parse, min(batch_size, 2048), size, True, api_key, ("OPENAI_API_KEY",), send=send)


def cohere_embedder(model=COHERE, dim=None, api_key=None, batch_size=96, timeout=60.0, send=post_json) -> Embedder:
    size, cut = _dim(model, dim, _sizes("embed-v4.0=1536* embed-english-v3.0=1024 embed-multilingual-v3.0=1024"))
    kinds = dict(zip(PURPOSES, ("search_document", "search_query", *PURPOSES[2:])))
    build = lambda texts, kind: {"model": model, "texts": list(texts), "input_type": kinds.get(kind, "search_document"), "embedding_types": ["float"], **({"output_dimension": size} if cut else {})}
    parse = lambda r: r["embeddings"]["float"] if isinstance(r["embeddings"], Mapping) else r["embeddings"]
    return ServiceEmbedder(f"cohere:{model}" + (f"@{size}" if cut else ""), "https://api.cohere.com/v2/embed", build, parse, min(batch_size, 96), size, False, api_key, ("COHERE_API_KEY", "CO_API_KEY"), timeout=timeout, honored=kinds, send=send)


def voyage_embedder(model=VOYAGE, dim=None, api_key=None, batch_size=1000, timeout=60.0, send=post_json) -> Embedder:
    size, cut = _dim(model, dim, _sizes(" ".join(f"voyage-{v}=1024*" for v in ("3.5", "3.5-lite", "3-large", "code-3"))))
    build = lambda texts, kind: {"model": model, "input": list(texts), **({"input_type": kind} if kind in ("query", "document") else {}), **({"output_dimension": size} if cut else {})}
    parse = lambda r: [d["embedding"] for d in sorted(r["data"], key=lambda d: d["index"])]
    return ServiceEmbedder(f"voyage:{model}" + (f"@{size}" if cut else ""), "https://api.voyageai.com/v1/embeddings", build, parse, min(batch_size, 1000), size, True, api_key, ("VOYAGE_API_KEY",), timeout=timeout, honored=("query", "document"), send=send)


def gemini_embedder(model=GEMINI, dim=None, api_key=None, batch_size=100, timeout=60.0, send=post_json) -> Embedder:
    model = model.removeprefix("models/")
    size, cut = _dim(model, dim, _sizes(f"{GEMINI}=3072*"))
    kinds = {p: ("RETRIEVAL_" if p in PURPOSES[:2] else "") + p.upper() for p in PURPOSES}

    def build(texts, kind):
        extra = ({"taskType": kinds[kind]} if kind in kinds else {}) | ({"outputDimensionality": size} if cut else {})
        return {"requests": [{"model": f"models/{model}", **extra, "content": {"parts": [dict(text=t)]}} for t in texts]}

    url = f"https://generativelanguage.googleapis.com/v1beta/models/{model}:batchEmbedContents"
    return ServiceEmbedder(f"gemini:{model}" + (f"@{size}" if cut else ""), url, build, lambda r: [e["values"] for e in r["embeddings"]], min(batch_size, 100), size, not cut, api_key, ("GEMINI_API_KEY", "GOOGLE_API_KEY"), ("x-goog-api-key", ""), timeout=timeout, honored=kinds, send=send)


_MODELS: dict = {}


class SentenceTransformerEmbedder(Embedder):
    """A local transformer, loaded once in each worker."""

    def __init__(self, model_name: str = "all-MiniLM-L6-v2", normalize: bool = False, batch_size: int = 128, device: str | None = None, **options):
        self.model_name, self.normalized, self.batch_size, self.device, self.options = model_name, normalize, batch_size, device, options
        self.model_id = f"st:{model_name}"

    def __call__(self, texts, input_type=None):
        if self.model_name not in _MODELS:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ImportError("local transformers need the sentence-transformers package") from e
            _MODELS[self.model_name] = SentenceTransformer(self.model_name, device=self.device, **self.options)
        return np.asarray(length_sorted(list(texts), lambda part: _MODELS[self.model_name].encode(part, normalize_embeddings=self.normalized, batch_size=self.batch_size), self.batch_size), np.float32)


def length_sorted(texts: list[str], embed: Callable[[list[str]], np.ndarray], batch_size: int) -> np.ndarray:
    """Rows in the order of texts, embedded in batches of similar lengths so that padding is small."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    parts = [np.asarray(embed([texts[i] for i in order[k : k + batch_size]])) for k in range(0, len(order), batch_size)]
    if not parts:
        return np.zeros((0, 0), np.float32)
    stacked = np.concatenate(parts)
    out = np.empty_like(stacked)
    out[order] = stacked
    return out


_SERVICES = {"openai": openai_embedder, "cohere": cohere_embedder, "voyage": voyage_embedder, "gemini": gemini_embedder}


def as_embedder(x=None, api_key: str | None = None, **options) -> Embedder:
    """An embedder from nothing (hashing), an embedder, a URL, `service:model`, `hashing`, `st:model` or a bare model name, or a function."""
    if isinstance(x, Embedder):
        return x
    if x is None:
        return HashingEmbedder(**options)
    if isinstance(x, str):
        if re.match("https?://", x):
            return http_embedder(x, **options)
        head, _, rest = x.partition(":")
        if head in _SERVICES:
            return _SERVICES[head](**({"model": rest} if rest else {}), **({"api_key": api_key} if api_key else {}), **options)
        if x == "hashing":
            return HashingEmbedder(**options)
        return SentenceTransformerEmbedder(rest if head == "st" else x, **options)
    if callable(x):
        return FunctionEmbedder(x, **options)
    raise TypeError(f"no embedder can be made of {type(x).__name__}")


# columns and tables


def embedded(rows: DataFrame, embedder: Embedder, text_col: str = "text", vector_col: str = "vector", input_type: str | None = "document") -> DataFrame:
    """rows with their vectors as array<float>; a null text has a null vector."""

    def run(batches):
        for b in in_parts(batches, text_col):
            texts = b.column(text_col).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            vectors = embedder.checked([texts[i] for i in at], input_type)
            width = vectors.shape[1] if len(vectors) else 0
            offsets = np.zeros(len(texts) + 1, np.int32)
            offsets[1:][at] = width
            null = np.ones(len(texts), bool)
            null[at] = False
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(vectors.ravel()), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, vector_col])

    kind = f"{rows.schema.simpleString()[7:-1]}" if rows.columns else ""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), f"`{vector_col}` array<float>"])
    return rows.mapInArrow(run, schema if kind else f"`{vector_col}` array<float>")


def cached(rows: DataFrame, embedder: Embedder, cache: DataFrame, text_col: str = "text", input_type: str | None = "document") -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, new rows of the cache): only texts that the cache (key, vector) doesn't hold are embedded, each once."""
    keyed = rows.withColumn("__key", cache_key(embedder.model_id, embedder.normalized, input_type, F.col(text_col)))
    misses = keyed.select("__key", text_col).where("__key is not null").dropDuplicates(["__key"]).join(cache.select(F.col("key").alias("__key")), "__key", "left_anti")
    fresh = embedded(misses, embedder, text_col, "vector", input_type).select(F.col("__key").alias("key"), "vector")
    every = cache.select("key", "vector").unionByName(fresh)
    return keyed.join(every.withColumnRenamed("key", "__key"), "__key", "left").drop("__key"), fresh
