"""Configurations as data: what segments and embeds, with all parameters filled in, named by a hash."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.identity import canonical_json, digest
from ..operators.embed import Embedder
from ..operators.segment import Segmenter


def full_arguments(function, args=(), kwargs=None) -> dict[str, Any]:
    """Arguments by name with defaults filled in. What the function doesn't take is kept under its own name, what it lacks stays out."""
    given = dict(kwargs or {})
    try:
        signature = inspect.signature(function)
    except (TypeError, ValueError):
        return given
    open_ended = any(p.kind is p.VAR_KEYWORD for p in signature.parameters.values())
    known = given if open_ended else {k: v for k, v in given.items() if k in signature.parameters}
    bound = signature.bind_partial(*args, **known)
    bound.apply_defaults()
    out: dict[str, Any] = {}
    for name, value in bound.arguments.items():
        kind = signature.parameters[name].kind
        if kind is inspect.Parameter.VAR_KEYWORD:
            out.update(value)
        elif kind is not inspect.Parameter.VAR_POSITIONAL or value:
            out[name] = list(value) if kind is inspect.Parameter.VAR_POSITIONAL else value
    return {**given, **out}


def step_parameters(function: Callable, given: Mapping[str, Any] | None = None, inputs: int = 1) -> dict[str, Any]:
    """full_arguments without the first positional parameters, which stand for data."""
    try:
        names = [p.name for p in inspect.signature(function).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)][:inputs]
    except (TypeError, ValueError):
        names = []
    return {k: v for k, v in full_arguments(function, (), given).items() if k not in names}


@dataclass(frozen=True)
class Step:
    op: str
    op_version: str = "1"
    params: Mapping = field(default_factory=dict)

    def as_dict(self) -> dict:
        return dict(op=self.op, op_version=self.op_version, params=dict(self.params))

    @classmethod
    def from_dict(cls, data: Mapping) -> Step:
        return cls(data["op"], data.get("op_version", "1"), dict(data.get("params", {})))


@dataclass(frozen=True)
class Pipeline:
    segment: Step
    embed: Step

    def as_dict(self) -> dict:
        return {name: getattr(self, name).as_dict() for name in ("embed", "segment")}

    @classmethod
    def from_dict(cls, data: Mapping) -> Pipeline:
        return cls(*(Step.from_dict(data[name]) for name in ("segment", "embed")))

    @property
    def config_id(self) -> str:
        return digest(canonical_json(self.as_dict()))


def segment_step(segmenter: Segmenter) -> Step:
    return Step(f"segment:{segmenter.identity}")


def embed_step(embedder: Embedder) -> Step:
    return Step(f"embed:{embedder.model_id}", "1", {"input_type": "document"})


def pipeline_of(segmenter: Segmenter, embedder: Embedder) -> Pipeline:
    return Pipeline(segment_step(segmenter), embed_step(embedder))
