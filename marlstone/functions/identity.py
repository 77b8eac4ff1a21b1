"""Content identity: one normal form of text, canonical JSON, and the hashes made of them."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Mapping
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BOM = "﻿"


def normal_form(text: str) -> str:
    """NFC, without byte-order marks, with line feeds only."""
    return re.sub("\r\n?", "\n", unicodedata.normalize("NFC", text).replace(BOM, ""))


def canonical_json(value: Any) -> str:
    return json.dumps(value, default=str, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def digest(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def text_hash(text: str) -> str:
    return digest(normal_form(text))


def _field(source: Mapping, key: str) -> Any:
    own = source.get(key)
    return own if own is not None else (source.get("metadata") or {}).get(key)


def source_hash(source: str | bytes | Mapping, content_keys: Iterable[str] = ()) -> str:
    """Hash of a source: raw bytes; normalised text; of a mapping its text (and the content keys it has), or all of it if it has no text."""
    if isinstance(source, bytes):
        return digest(source)
    if isinstance(source, str):
        return text_hash(source)
    if not isinstance(source, Mapping):
        raise TypeError(f"a source is text, bytes or a mapping, not {type(source).__name__}")
    if "text" not in source:
        return digest(canonical_json(dict(source)))
    extra = {k: v for k in content_keys if (v := _field(source, k)) is not None}
    return digest(normal_form(source["text"]) + (canonical_json(extra) if extra else ""))


def segment_key(text: str, metadata: Mapping | None = None) -> str:
    return digest(normal_form(text) + canonical_json(dict(metadata or {})))


#: Texts of these characters alone are in NFC already: none of them decomposes, none joins a character before it.
INERT = (
    r"\x{0}-\x{2FF}\x{388}-\x{3FF}\x{400}-\x{482}\x{48A}-\x{52F}\x{2002}-\x{20CF}\x{2190}-\x{21FF}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{FF00}-\x{FFEF}\x{1F300}-\x{1F64F}"
)


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    parts = [pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(k, 64).to_pylist()], pa.string()) for k in range(0, len(texts), 64)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def normalized(text: Column) -> Column:
    """normal_form as an expression. Only rows with characters that NFC may change go through Python, few at a time; Spark has no NFC of its own."""
    beyond = text.rlike(r"[^\x{0}-\x{2FF}]") & text.rlike(f"[^{INERT}]")  # the first is quick, and most texts have no need of the second
    composed = F.coalesce(_nfc(F.when(beyond, text)), text)
    return F.regexp_replace(F.regexp_replace(composed, BOM, ""), r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def segment_id(text: Column, metadata: Column) -> Column:
    return F.sha2(F.concat(normalized(text), F.coalesce(metadata, F.lit("{}"))), 256)


def cache_key(model_id: str, normalized_vectors: bool, input_type: str | None, text: Column) -> Column:
    """Key of an embedding in a cache table; the text counts as it is, not normalised."""
    head = f"{model_id}|{normalized_vectors}|{input_type}|"
    return F.concat(F.lit(f"{model_id}/"), F.sha2(F.concat(F.lit(head), text), 256))


@F.pandas_udf(StringType())
def _merged(base: pd.Series, extra: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else canonical_json({**json.loads(a), **json.loads(b or "{}")}) for a, b in zip(base, extra)])


def merged_metadata(base: Column, extra: Column | str) -> Column:
    """Canonical JSON of two JSON objects, the second one's keys winning. Empty bases, the usual case, stay out of Python."""
    extra = F.lit(extra) if isinstance(extra, str) else extra
    own = F.coalesce(base, F.lit("{}"))
    return F.coalesce(_merged(F.when(own != "{}", own), extra), extra)
