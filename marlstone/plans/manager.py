"""The manager of a corpus: named configurations, their index, search, diagnosis and refresh.

The index is one versioned table in buckets by configuration and source; a refresh writes only the buckets of the sources that it touches. Vectors are taken
from a cache table by text, so another configuration or a refresh embeds only what is new; the cache is only ever appended to.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import canonical_json
from ..operators import sync
from ..operators.embed import Embedder, as_embedder, cached, embedded
from ..operators.graph import Graph, edges_of, recipe
from ..operators.search import batch_top_k, rerank, top_k, with_source
from ..operators.segment import Segmenter, as_segmenter
from ..shared import shared_folder, written
from ..sources.corpora import SCHEMA, as_corpus
from .config import Pipeline, pipeline_of
from .store import Table

INDEX = "config_hash string, source_id string, source_hash string, ord long, segment_id string, parent_id string, idx int, start int, end int, text string, tokens int, metadata string, vector array<float>"
STATE = "config_hash string, source_id string, source_hash string"
REGISTRY = "source_id string, source_hash string"
CACHE = "key string, vector array<float>"


@dataclass
class Refreshed:
    """What a refresh did, as a table (source_id, action) and counts."""

    actions: DataFrame
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def changed(self) -> bool:
        return any(self.counts.values())


@dataclass(frozen=True)
class Config:
    name: str
    segmenter: Segmenter
    embedder: Embedder
    pipeline: Pipeline

    @property
    def config_id(self) -> str:
        return self.pipeline.config_id


class Searchable:
    """A read-only view of the index of one configuration."""

    def __init__(self, rows: Callable[[], DataFrame], embedder: Embedder):
        self._rows, self.embedder = rows, embedder

    def rows(self) -> DataFrame:
        return self._rows()

    def _vector(self, query) -> list[float]:
        if isinstance(query, str):
            return [float(x) for x in self.embedder.checked([query], "query")[0]]
        return [float(x) for x in query]

    def search(self, query: str | Sequence[float], limit: int = 10, filter: Mapping | None = None) -> DataFrame:
        """The best segments for a text or a vector, with score and rank; none of an empty index."""
        return top_k(self.rows(), self._vector(query), limit, filter)

    def retrieve(self, query: str | Sequence[float], limit: int = 10, filter: Mapping | None = None) -> DataFrame:
        """The same as segments: without scores, with the source in the metadata."""
        return with_source(self.search(query, limit, filter))

    def search_many(self, queries: DataFrame, limit: int = 10, filter: Mapping | None = None, key: str = "segment_id") -> DataFrame:
        """All rows of queries (query_id, and text or vector) at once."""
        asked = queries if "vector" in queries.columns else embedded(queries.select("query_id", "text"), self.embedder, input_type="query")
        return batch_top_k(self.rows(), asked, limit, key, filter)

    def rerank(self, query: str, scorer, limit: int = 10, fetch_k: int = 50, filter: Mapping | None = None) -> DataFrame:
        return rerank(self.search(query, max(limit, fetch_k), filter), scorer, query=query, limit=limit)

    def __len__(self) -> int:
        return self.rows().count()


class Manager:
    def __init__(self, spark: SparkSession, corpus: Any = None, segmenter: Any = None, embedder: Any = None, store: str | None = None, cache: bool = True, default: bool | None = None, auto_refresh: bool = False, on_change: Callable[[DataFrame], Any] | None = None):
        self.spark = spark
        self.corpus = as_corpus(spark, corpus)
        self.store = (store or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}").rstrip("/")
        self.index = Table(spark, f"{self.store}/index", INDEX, "source_id")
        self.state = Table(spark, f"{self.store}/state", STATE, "source_id")
        self.cache = Table(spark, f"{self.store}/vectors", CACHE) if cache else None
        self.configs: dict[str, Config] = {}
        self.graph = Graph()
        self.on_change = on_change
        self.registry = Table(spark, f"{self.store}/registry", REGISTRY, "source_id") if auto_refresh else None
        if self.registry is not None and self.registry.version() is None:  # what is there when watching begins is no change
            self.registry.replace("", self.corpus.select("source_id", "source_hash"))
        if default if default is not None else embedder is not None:
            self.register("default", segmenter, embedder)

    def set_corpus(self, corpus: Any) -> None:
        self.corpus = as_corpus(self.spark, corpus)

    # configurations

    def register(self, name: str = "default", segmenter: Any = None, embedder: Any = None, api_key: str | None = None) -> str:
        """Names a configuration, in place of an earlier one of that name; nothing is indexed yet."""
        seg, emb = as_segmenter(segmenter), as_embedder(embedder, api_key)
        self.configs[name] = Config(name, seg, emb, pipeline_of(seg, emb))
        return self.configs[name].config_id

    def resolve(self, config: str | None = None) -> Config:
        """By name or id; without one the default or the only one."""
        if config is None:
            if "default" in self.configs:
                return self.configs["default"]
            if len(self.configs) == 1:
                return next(iter(self.configs.values()))
            raise ValueError("name a configuration: there is no default and not just one")
        found = self.configs.get(config) or next((c for c in self.configs.values() if c.config_id == config), None)
        if found is None:
            raise KeyError(config)
        return found

    def pipeline(self, config: str | None = None) -> Pipeline:
        return self.resolve(config).pipeline

    # the index

    def _made(self, config: Config, sources: DataFrame) -> DataFrame:
        """Index rows of sources under a configuration, written once; new vectors go to the cache table."""
        segments = config.segmenter.segments(sources)
        if self.cache is None:
            rows = embedded(segments, config.embedder)
        else:
            segments = written(segments, "segments")
            _, fresh = cached(segments, config.embedder, self.cache.read())
            known = self.cache.append(fresh)
            self.cache.drop_old()
            rows, _ = cached(segments, config.embedder, known)
        rows = rows.withColumn("config_hash", F.lit(config.config_id)).select([f.name for f in self.index.schema.fields])
        return written(rows, "made")

    def _subset(self, sources: DataFrame | Sequence[str] | None) -> DataFrame:
        if sources is None:
            return self.corpus
        return self.corpus.join(self._ids(sources), "source_id", "left_semi")

    def _ids(self, sources: DataFrame | Sequence[str]) -> DataFrame:
        if isinstance(sources, DataFrame):
            return sources.select(F.col("source_id").cast("string").alias("source_id")).distinct()
        return self.spark.createDataFrame([(str(s),) for s in dict.fromkeys(sources)], "source_id string")

    def _put(self, config: Config, kept: DataFrame, fresh: DataFrame, sources: DataFrame, kept_state: DataFrame, buckets: list[int] | None) -> None:
        """New versions of the index and of the state, in these buckets: kept rows and fresh ones, which were made of the sources."""
        seen = sources.select(F.lit(config.config_id).alias("config_hash"), "source_id", "source_hash")
        self.index.replace(config.config_id, kept.unionByName(fresh), buckets)
        self.state.replace(config.config_id, kept_state.join(seen.select("source_id"), "source_id", "left_anti").select(seen.columns).unionByName(seen), buckets)
        for table in (self.index, self.state):
            table.drop_old()

    def materialize(self, config: str | None = None, sources: DataFrame | Sequence[str] | None = None) -> dict[str, int]:
        """Indexes all configurations, or one; all sources, or some. Rows of the same segments are replaced."""
        wanted = [self.resolve(config)] if config is not None else list({c.config_id: c for c in self.configs.values()}.values())
        chosen = self._subset(sources)
        keys = ["source_id", "idx", "source_hash"]
        for c in wanted:
            fresh = self._made(c, chosen)
            buckets = self.index.buckets_of(chosen)
            kept = self.index.read(c.config_id, buckets).join(fresh.select(*keys).distinct(), keys, "left_anti")
            self._put(c, kept, fresh, chosen, self.state.read(c.config_id, buckets), buckets)
        current = chosen.select("source_id", "source_hash")
        segments = sum(self.index.read(c.config_id).join(current, ["source_id", "source_hash"], "left_semi").count() for c in wanted)
        return {"configs": len(wanted), "sources": chosen.count(), "segments": segments}

    def rows(self, config: str | None = None) -> DataFrame:
        return self.index.read(self.resolve(config).config_id)

    def searchable(self, config: str | None = None) -> Searchable:
        found = self.resolve(config)
        return Searchable(lambda: self.rows(found.config_id), found.embedder)

    def search(self, query, limit: int = 10, filter: Mapping | None = None, config: str | None = None) -> DataFrame:
        return self.searchable(config).search(query, limit, filter)

    def retrieve(self, query, limit: int = 10, filter: Mapping | None = None, config: str | None = None) -> DataFrame:
        return self.searchable(config).retrieve(query, limit, filter)

    # maintenance

    def diagnose(self, config: str | None = None) -> DataFrame:
        """Flags of every source. A source that was indexed and gave no segment counts as indexed."""
        c = self.resolve(config)
        rows = self.index.read(c.config_id).select("source_id", "source_hash", "config_hash")
        empty = self.state.read(c.config_id).select("source_id", "source_hash", "config_hash").join(rows.select("source_id").distinct(), "source_id", "left_anti")
        return sync.diagnose(self.corpus, rows.unionByName(empty), c.config_id)

    def refresh(self, config: str | None = None, sources: DataFrame | Sequence[str] | None = None, mode: str = "full") -> Refreshed:
        """Deletes, indexes and reports, by the plan of the mode; one new version of the index."""
        if sources is not None and mode == "full":
            raise ValueError("a full refresh takes all sources: use mode='scoped_full'")
        c = self.resolve(config)
        report = written(self.diagnose(c.config_id), "report")
        plan = written(sync.plan_refresh(report, mode, self._ids(sources) if sources is not None else None), "plan")
        actions = written(sync.refresh_report(plan, report), "actions")
        counts = {r.action: r["count"] for r in actions.groupBy("action").count().collect()}  # three numbers at most
        if counts:
            chosen = self.corpus.join(plan.where("to_materialize"), "source_id", "left_semi")
            fresh = self._made(c, chosen)
            buckets = self.index.buckets_of(plan)
            own = sync.without_sources(self.index.read(c.config_id, buckets), plan.where("to_delete"))
            keys = ["source_id", "idx", "source_hash"]
            own = own.join(fresh.select(*keys).distinct(), keys, "left_anti")
            self._put(c, own, fresh, chosen, sync.without_sources(self.state.read(c.config_id, buckets), plan), buckets)
        return Refreshed(actions, counts)

    def rebuild(self, config: str | None = None) -> Refreshed:
        """Drops a configuration's rows and state, and indexes all sources again."""
        c = self.resolve(config)
        nothing = self.spark.createDataFrame([], self.index.schema), self.spark.createDataFrame([], self.state.schema)
        self._put(c, nothing[0], self._made(c, self.corpus), self.corpus, nothing[1], None)
        actions = self.corpus.select("source_id", F.lit("added").alias("action"))
        return Refreshed(actions, {"added": actions.count()})

    def gc_orphans(self, config: str | None = None) -> int:
        """Deletes rows and state of sources that are no longer in the corpus; how many rows of the index."""
        c = self.resolve(config)
        orphans = written(self.diagnose(c.config_id).where("is_orphan").select("source_id"), "orphans")
        buckets = self.index.buckets_of(orphans)
        if not buckets:
            return 0
        own = self.index.read(c.config_id, buckets)
        before = own.count()
        nothing = self.spark.createDataFrame([], self.index.schema)
        self._put(c, sync.without_sources(own, orphans), nothing, self.corpus.limit(0), sync.without_sources(self.state.read(c.config_id, buckets), orphans), buckets)
        return before - self.index.read(c.config_id, buckets).count()

    # changes, if the manager was made with auto_refresh

    def _watched(self) -> Table:
        if self.registry is None:
            raise TypeError("make the manager with auto_refresh=True to follow changes")
        return self.registry

    def diff(self) -> DataFrame:
        """source_id, status, old_hash, new_hash: the corpus against the registry, which stays as it is."""
        return sync.corpus_diff(self._watched().read(), self.corpus)

    def scan(self) -> DataFrame:
        """The changes since the last scan, applied to every configuration and then entered in the registry: after a failure the next scan finds them again."""
        return self._apply(self.diff())

    def _apply(self, diff: DataFrame) -> DataFrame:
        registry = self._watched()
        changed = written(diff.where("status <> 'unchanged'"), "changes")
        buckets = registry.buckets_of(changed)
        if not buckets:
            return changed
        if self.on_change is not None:
            self.on_change(changed)
        for config_id in dict.fromkeys(c.config_id for c in self.configs.values()):
            self.refresh(config_id, changed, "scoped_full")
        kept = sync.without_sources(registry.read("", buckets), changed)
        registry.replace("", kept.unionByName(changed.where("new_hash is not null").select("source_id", F.col("new_hash").alias("source_hash"))), buckets)
        registry.drop_old()
        return changed

    def _one(self, source_id: str) -> DataFrame:
        mine = F.col("source_id") == str(source_id)
        return self._apply(sync.corpus_diff(self._watched().read().where(mine), self.corpus.where(mine)))

    def put(self, source_id: str, source: Any) -> DataFrame:
        """Adds or replaces one source and refreshes it; the change, or nothing if its hash stays. For many use set_corpus and scan: each call here adds to
        the corpus' plan."""
        self._watched()
        added = as_corpus(self.spark, {str(source_id): source})
        self.corpus = self.corpus.where(F.col("source_id") != str(source_id)).unionByName(added)
        return self._one(source_id)

    def remove(self, source_id: str) -> DataFrame:
        """Takes one source out of the corpus and the index; KeyError if it isn't there."""
        self._watched()
        if self.corpus.where(F.col("source_id") == str(source_id)).isEmpty():
            raise KeyError(source_id)
        self.corpus = self.corpus.where(F.col("source_id") != str(source_id))
        return self._one(source_id)

    def lineage(self, config: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(artifacts, edges): of every source its hash as a leaf, its segments and its vectors, by the configurations registered."""
        wanted = [self.resolve(config)] if config is not None else list(self.configs.values())
        done = self.state.read()
        parts = [self.corpus.select(F.col("source_hash").alias("artifact_id"), F.lit(None).cast("string").alias("op"), F.lit(None).cast("string").alias("op_version"), F.array().cast("array<string>").alias("inputs"), F.lit(None).cast("string").alias("params"), F.lit(True).alias("materialized")).distinct()]
        for c in wanted:
            seen = done.where(F.col("config_hash") == c.config_id).select("source_hash").distinct().withColumn("done", F.lit(True))
            rows = self.corpus.select("source_hash").distinct().join(seen, "source_hash", "left").withColumn("materialized", F.coalesce("done", F.lit(False)))
            upstream = F.col("source_hash")
            for step in (c.pipeline.segment, c.pipeline.embed):
                key, params = recipe_key(step, upstream)
                parts.append(rows.select(key.alias("artifact_id"), F.lit(step.op).alias("op"), F.lit(step.op_version).alias("op_version"), F.array(upstream).alias("inputs"), F.lit(params).alias("params"), "materialized"))
                upstream = key
        artifacts = reduce(DataFrame.unionByName, parts).groupBy("artifact_id").agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("op", "op_version", "inputs", "params")], F.max("materialized").alias("materialized"))
        return artifacts, edges_of(artifacts)


def recipe_key(step, upstream):
    """The artifact id of a step on one input, as an expression: the hash of the recipe's canonical JSON."""
    params = canonical_json(dict(step.params))
    mark = "\x00"
    head, tail = canonical_json(recipe(step.op, mark, op_version=step.op_version, **step.params).as_dict()).split(canonical_json(mark)[1:-1])
    return F.sha2(F.concat(F.lit(head), upstream, F.lit(tail)), 256), params


def ingest(spark: SparkSession, sources: Any, segmenter: Any = None, embedder: Any = None, store: str | None = None) -> Searchable:
    """Sources to a searchable index in one step; without an embedder texts are hashed."""
    manager = Manager(spark, sources, segmenter, embedder, store, default=True)
    manager.materialize()
    return manager.searchable()


__all__ = ["Config", "Manager", "Refreshed", "Searchable", "ingest", "SCHEMA"]
