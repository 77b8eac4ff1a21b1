"""Named corpora of one session."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import explore
from .manager import Manager


@dataclass(frozen=True)
class CorpusInfo:
    corpus_id: str
    sources: int
    segments: int
    configs: dict[str, str]


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._managers: dict[str, Manager] = {}

    def create_corpus(self, corpus_id: str, sources: Any = None, segmenter: Any = None, embedder: Any = None, store: str | None = None, index: bool = True) -> Manager:
        if corpus_id in self._managers:
            raise ValueError(f"there is a corpus {corpus_id!r} already")
        made = Manager(self.spark, sources, segmenter, embedder, store, default=True)
        if index:
            made.materialize()
        self._managers[corpus_id] = made
        return made

    def __getitem__(self, corpus_id: str) -> Manager:
        return self._managers[corpus_id]

    def __contains__(self, name) -> bool:
        return name in self._managers

    def __iter__(self):
        yield from self._managers

    def __len__(self) -> int:
        return len(self._managers)

    def list_corpora(self) -> list[str]:
        return list(self._managers)

    def corpus_info(self, corpus_id: str) -> CorpusInfo:
        m = self[corpus_id]
        return CorpusInfo(corpus_id, m.corpus.count(), m.index.read().count(), {k: c.config_id for k, c in m.configs.items()})

    def delete_corpus(self, corpus_id: str) -> None:
        del self._managers[corpus_id]

    def search(self, corpus_id: str, query, limit: int = 10, **options) -> DataFrame:
        return self[corpus_id].search(query, limit, **options)

    def retrieve(self, corpus_id: str, query, limit: int = 10, **options) -> DataFrame:
        return self[corpus_id].retrieve(query, limit, **options)

    def explore_corpus(self, corpus_id: str, config: str | None = None, **options):
        rows = self[corpus_id].rows(config).selectExpr("segment_id AS id", "vector", "text").dropDuplicates(["id"])
        return explore.explore(rows, **options)
