import importlib
import json
import shutil
import sys
from pathlib import Path

import pytest

from marlstone.operators import segment
from marlstone.operators.embed import FunctionEmbedder, HashingEmbedder
from marlstone.plans.manager import Manager, ingest
from marlstone.plans.service import Service
from marlstone.sources import beir
from marlstone.streaming import changes

LETTERS = [chr(97 + k) for k in range(16)]


def counts(texts):
    return [[float(t.count(c)) for c in [chr(97 + k) for k in range(16)]] for t in texts]


def model():
    return FunctionEmbedder(counts, "letters", 16)


def flags(manager):
    return {r.source_id: tuple(k for k in r.asDict() if k.startswith("is_") and r[k]) for r in manager.diagnose().collect()}


def test_ingest_and_search(spark):
    found = ingest(spark, ["forest path", "ocean wave", "machine code"], segment.Lines(), model())
    best = found.search("ocean wave", 2).orderBy("rank").collect()
    assert best[0].text == "ocean wave" and best[0].score == pytest.approx(1.0) and len(best) == 2
    assert ingest(spark, None, None, model()).search("x").count() == 0
    tagged = ingest(spark, [{"text": "aaa", "metadata": {"kind": "x"}}, {"text": "aab", "metadata": {"kind": "y"}}], None, model())
    assert [r.text for r in tagged.retrieve("aaa", filter={"kind": "y"}).collect()] == ["aab"]


def test_refresh_modes_and_convergence(spark):
    m = Manager(spark, {"keep": "aaa", "edit": "bbb", "drop": "ccc", "empty": "", "twin": "aaa"}, segment.Lines(), model())
    assert m.materialize()["segments"] == 4
    assert set(flags(m).values()) == {("is_fresh",)}
    m.set_corpus({"keep": "aaa", "edit": "ddd", "new": "eee", "empty": "", "twin": "aaa"})
    assert flags(m) == {"keep": ("is_fresh",), "edit": ("is_stale",), "drop": ("is_orphan",), "new": ("is_missing",), "empty": ("is_fresh",), "twin": ("is_fresh",)}
    with pytest.raises(ValueError):
        m.refresh(sources=["edit"])
    assert m.refresh(mode="scoped_full", sources=["new"]).counts == {"added": 1}
    assert m.refresh(mode="incremental").counts == {"updated": 1} and flags(m)["drop"] == ("is_orphan",)
    assert m.refresh().counts == {"deleted": 1} and not m.refresh().changed
    assert {r.text for r in m.rows().collect()} == {"aaa", "ddd", "eee"} and m.gc_orphans() == 0
    m.set_corpus({"keep": "zzz"})
    m.refresh(mode="none")
    assert flags(m)["keep"] == ("is_stale",)
    assert m.gc_orphans() == 3 and m.rebuild().counts == {"added": 1} and flags(m) == {"keep": ("is_fresh",)}


def test_changes_are_followed(spark):
    seen = []
    m = Manager(spark, {"a": "aaa", "b": "bbb"}, segment.Lines(), model(), auto_refresh=True, on_change=lambda rows: seen.extend((r.source_id, r.status) for r in rows.collect()))
    m.register("small", segment.Lines(), HashingEmbedder(8))
    m.materialize()
    assert m.scan().count() == 0 and m.put("a", "aaa").count() == 0 and seen == []
    assert [r.status for r in m.put("c", "ccc").collect()] == ["added"] and [r.status for r in m.put("a", "zzz").collect()] == ["modified"]
    assert [r.status for r in m.remove("b").collect()] == ["deleted"]
    with pytest.raises(KeyError):
        m.remove("b")
    for config in ("default", "small"):
        assert {r.text for r in m.rows(config).collect()} == {"ccc", "zzz"}
    assert set(flags(m).values()) == {("is_fresh",)} and seen == [("c", "added"), ("a", "modified"), ("b", "deleted")]
    m.set_corpus({"a": "zzz", "d": "ddd"})
    assert {(r.source_id, r.status) for r in m.diff().collect()} == {("a", "unchanged"), ("c", "deleted"), ("d", "added")}
    assert {(r.source_id, r.status) for r in m.scan().collect()} == {("c", "deleted"), ("d", "added")} and m.scan().count() == 0
    again = Manager(spark, {"a": "new"}, segment.Lines(), model(), store=m.store, auto_refresh=True)  # the registry outlives the manager
    assert {(r.source_id, r.status) for r in again.scan().collect()} == {("a", "modified"), ("d", "deleted")}
    with pytest.raises(TypeError):
        Manager(spark, {"a": "aaa"}, segment.Lines(), model()).scan()


def test_configurations_share_work(spark):
    m = Manager(spark, {"a": "one line", "b": "two line"}, segment.Lines(), model())
    other = m.register("small", segment.Lines(), HashingEmbedder(8))
    assert m.materialize()["configs"] == 2 and m.rows("small").first().vector and len(m.rows(other).first().vector) == 8
    assert m.resolve(other).name == "small" and m.resolve().name == "default"
    with pytest.raises(KeyError):
        m.resolve("nothing")
    artifacts, edges = m.lineage()
    assert artifacts.where("op like 'segment:%'").count() == 2 and artifacts.where("op like 'embed:%'").count() == 4 and edges.count() == 6
    assert artifacts.where("not materialized").count() == 0
    before = m.cache.read().count()
    m.rebuild("small")
    assert m.cache.read().count() == before


def test_service(spark):
    s = Service(spark)
    s.create_corpus("x", ["aaa", "bbb"], segment.Lines(), model())
    with pytest.raises(ValueError):
        s.create_corpus("x")
    with pytest.raises(KeyError):
        s.search("y", "a")
    assert s.corpus_info("x").segments == 2 and s.search("x", "aaa", 1).first().text == "aaa" and "x" in s and len(s) == 1
    s.delete_corpus("x")
    assert s.list_corpora() == []


def test_beir_round_trip(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text("\n".join(json.dumps(x) for x in [{"_id": "d1", "title": " T ", "text": "body "}, {"id": "d2", "text": "old"}, {"_id": "d2", "title": "", "text": "new"}]) + "\n\n")
    (tmp_path / "queries.jsonl").write_text(json.dumps({"_id": "q", "text": "ask"}) + "\n")
    (tmp_path / "qrels").mkdir()
    (tmp_path / "qrels" / "test.tsv").write_text("\n".join(["query-id\tcorpus-id\tscore", "q\td1\t2", "q\td1\t1", "short\tline", ""]))
    corpus, queries, qrels = beir.read_beir(spark, str(tmp_path))
    assert {tuple(r) for r in corpus.collect()} == {("d1", "T\nbody"), ("d2", "new")} and [tuple(r) for r in qrels.collect()] == [("q", "d1", 1.0)]
    beir.write_beir(str(tmp_path / "out"), corpus, queries, qrels)
    again = beir.read_beir(spark, str(tmp_path / "out"))
    assert all({tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()} for a, b in zip(again, (corpus, queries, qrels)))
    with pytest.raises(FileNotFoundError):
        beir.judgements_path(str(tmp_path / "out"), "no.tsv")


def test_stream_equals_batch(spark, tmp_path):
    feed = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 3, "y"), ("a", 4, "z"), ("b", 5, None), ("b", 6, None), ("a", 7, None), ("a", 8, "x")], "source_id string, seq long, source_hash string")
    feed.coalesce(1).write.parquet(str(tmp_path / "feed"))
    want = {tuple(r) for r in changes.change_events(feed).collect()}
    assert {(x[0], x[1], x[2]) for x in want} == {("a", 1, "added"), ("a", 4, "modified"), ("a", 7, "deleted"), ("a", 8, "added"), ("b", 3, "added"), ("b", 5, "deleted")}
    stream = spark.readStream.schema(feed.schema).parquet(str(tmp_path / "feed"))
    q = changes.stream_events(stream).writeStream.format("memory").queryName("events_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("events_out").collect()} == want
    seen = []
    q = changes.refresh_on_change(stream, lambda rows: seen.extend(tuple(r) for r in rows.collect()), str(tmp_path / "d"), available_now=True)
    q.awaitTermination(120)
    assert sorted(seen, key=str) == [("a", "x", 8), ("b", None, 6)]


def test_entry_without_the_training_operators(tmp_path, monkeypatch):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "marlstone", tmp_path / "marlstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    held = {k: sys.modules.pop(k) for k in list(sys.modules) if k.split(".")[0] in ("marlstone", "corpus_pipeline", "__spark_entry__")}
    monkeypatch.setattr(sys, "path", [str(tmp_path), *(p for p in sys.path if Path(p or ".").resolve() != root)])
    monkeypatch.chdir(tmp_path)
    try:
        entry = importlib.import_module("__spark_entry__")
        names = entry.queries()
        assert "diagnose" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    finally:
        for k in [k for k in sys.modules if k.split(".")[0] in ("marlstone", "corpus_pipeline", "__spark_entry__")]:
            del sys.modules[k]
        sys.modules.update(held)
