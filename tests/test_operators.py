import hashlib
import math
import re
import tracemalloc
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone import shared
from marlstone.functions import identity
from marlstone.operators import embed, evaluation, explore, graph, search, segment
from marlstone.plans.config import Pipeline, Step, full_arguments, step_parameters
from marlstone.sources.corpora import as_corpus


# identity


def test_normal_form_and_hashes(spark):
    texts = ["café", "café", "﻿a﻿b", "a\r\nb\rc\n", "", "한글", "Å Å"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", identity.content_hash(F.col("text")).alias("h")).collect()
    assert [r.h for r in rows] == [identity.text_hash(r.text) for r in rows] and rows[0].h == rows[1].h
    assert identity.normal_form("﻿a\r\nb\r") == "a\nb\n"
    assert identity.source_hash(b"x") == hashlib.sha256(b"x").hexdigest()
    assert identity.source_hash({"text": "x", "kind": "a"}) == identity.source_hash("x") != identity.source_hash({"text": "x", "kind": "a"}, ["kind"])
    assert identity.source_hash({"a": 1}) == identity.digest('{"a":1}')
    with pytest.raises(TypeError):
        identity.source_hash(3)


def test_corpora(spark, tmp_path):
    assert as_corpus(spark).count() == 0
    rows = {r.source_id: r for r in as_corpus(spark, {"a": "x", 1: {"text": "y", "id": "own", "metadata": {"kind": "k"}, "page": 3}}).collect()}
    assert rows["1"].doc_id == "own" and rows["1"].metadata == '{"kind":"k","page":3}' and rows["a"].metadata == "{}"
    twice = as_corpus(spark, ["x", "y", "x"]).orderBy("ord").collect()
    assert [r.text for r in twice] == ["x", "y"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.txt").write_text("two")
    assert {(r.source_id, r.text) for r in as_corpus(spark, str(tmp_path)).collect()} == {("a.txt", "one"), ("sub/b.txt", "two")}
    with pytest.raises(TypeError):
        as_corpus(spark, "/no/such/folder")


# segments


def test_recursive_worked_examples():
    cut = lambda t, n, o: [t[a:b] for a, b in segment.recursive_spans(t, n, o)]
    assert cut("one two three four", 3, 1) == ["one two three", "three four"]
    assert cut("alpha beta gamma delta epsilon", 4, 1)[-1].endswith("epsilon")
    assert "".join(cut("x" * 20, 2, 0)) == "x" * 20 and max(map(len, cut("x" * 20, 2, 0))) == 2
    spans = segment.recursive_spans("y" * 10_000, 512, 64)
    assert spans[0] == (0, 512) and spans[1][0] == 448 and segment.recursive_spans("a " + "y" * 2000, 512, 64) == [(0, 2002)]
    assert segment.recursive_spans("", 5, 1) == []
    for bad in ((0, 0), (4, 4), (4, -1)):
        with pytest.raises(ValueError):
            segment.Recursive(*bad)


def test_segments_slice_their_source(spark):
    docs = as_corpus(spark, {"a": "First paragraph here.\n\nSecond one, longer; with words.\n\nThird. " * 9, "b": {"text": "  hello  \r\n\nworld x\n", "id": "B", "kind": "k"}, "c": ""})
    whole = {r.source_id: r.text for r in docs.collect()}
    for s in (segment.Recursive(8, 2), segment.Lines(), segment.Function(lambda t: t.split(), "words")):
        rows = s.segments(docs).orderBy("source_id", "idx").collect()
        assert rows and all(r.text == whole[r.source_id][r.start : r.end] and r.text for r in rows)
        assert {r.source_id for r in rows} == {"a", "b"} and all(r.parent_id == ("B" if r.source_id == "b" else None) for r in rows)
        for key in ("a", "b"):
            assert [r.idx for r in rows if r.source_id == key] == list(range(sum(r.source_id == key for r in rows)))
        meta = '{"tokenizer":"char-approx"}'
        assert all(r.segment_id == identity.digest(identity.normal_form(r.text) + r.metadata) for r in rows)
    rows = segment.Lines().segments(docs).where("source_id = 'b'").collect()
    assert sorted(r.text for r in rows) == ["hello", "world", "x"] and rows[0].metadata == '{"kind":"k","tokenizer":"char-approx"}' and meta


def test_overlap_hierarchy_and_factory(spark):
    docs = as_corpus(spark, {"a": "one two three. four five six. seven eight"})
    base = segment.Function(lambda t: t.split(". "), "sentences").segments(docs)
    wide = segment.with_overlap(base, docs, 5).orderBy("idx").collect()
    assert [r.text for r in wide] == ["one two three. fou", "four five six. sev", "seven eight"]
    with pytest.raises(ValueError):
        segment.with_overlap(base, docs, -1)
    rows = segment.hierarchical([segment.Function(lambda t: t.split(". "), "sentences"), segment.Function(lambda t: t.split(), "words")], docs).collect()
    parents = {r.segment_id: r for r in rows if r.level == 0}
    assert len(parents) == 3 and all(r.parent_id in parents for r in rows if r.level == 1)
    assert all("one two three. four five six. seven eight"[r.start : r.end] == r.text for r in rows)
    assert segment.as_segmenter(" Lines ").identity == "line-segmenter" and segment.as_segmenter().size == 512
    with pytest.raises(ValueError):
        segment.as_segmenter(lambda t: [t])
    with pytest.raises(TypeError):
        segment.as_segmenter(3)
    with pytest.raises(ValueError):
        segment.hierarchical([], docs)


# embeddings


def hashed(text, dim=32):
    words = re.findall(r"\w+", text.lower())
    out = np.zeros(dim, np.float32)
    for gram, n in Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]).items():
        h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "big")
        out[(h >> 1) % dim] += (1 if h & 1 else -1) * (1 + math.log(n))
    size = np.linalg.norm(out)
    return out / size if size else out


def test_hashing(spark):
    e = embed.HashingEmbedder(32)
    texts = ["the quick brown fox the quick", "", "x²y naïve", "a a a a"]
    assert np.allclose(e(texts), [hashed(t) for t in texts], atol=1e-6) and e.model_id == "hashing:v1@32"
    assert embed.HashingEmbedder(8, (1, 3), False).model_id == "hashing:v1-ng1_3-tflin@8"
    rows = embed.embedded(spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, text string"), e).orderBy("k").collect()
    assert rows[4].vector is None and np.allclose([r.vector for r in rows[:4]], e(texts))
    for bad in ({"dim": 0}, {"ngram_range": (2, 1)}):
        with pytest.raises(ValueError):
            embed.HashingEmbedder(**bad)


def test_handles():
    import threading

    e = embed.FunctionEmbedder(lambda ts: [[len(t)] for t in ts], "len", 1)
    done = e.embed_batch(iter(["a", "bb"]))
    assert done.poll() == "done" and done.result().tolist() == [[1.0], [2.0]] and done.cancel() is None
    gate = threading.Event()
    slow = embed.FunctionEmbedder(lambda ts: gate.wait(60) and [[1.0]] * len(ts), "slow", 1).embed_batch(["a"], background=True)
    assert slow.poll() == "pending"
    gate.set()
    assert slow.result().tolist() == [[1.0]] and slow.poll() == "done"
    bad = embed.FunctionEmbedder(lambda ts: [[1.0]], "bad", 1).embed_batch(["a", "b"], background=True)
    with pytest.raises(embed.EmbedderError):
        bad.result()
    assert bad.poll() == "failed"


def test_hashing_query_against_an_independent_version(spark):
    from marlstone import catalogue

    texts = {str(r.doc_id): r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.source_id: r.vector for r in catalogue.hashing_embed(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == texts.keys() and all(np.allclose(got[k], hashed(t, 256), atol=1e-5) for k, t in texts.items())


def test_projection_query_against_singular_vectors(spark):
    from marlstone import catalogue

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x -= x.mean(0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    got = {r.id: r.coords for r in catalogue.pca(spark, "/root/testdata/sf0.001").collect()}
    assert np.allclose([got[r.vec_id] for r in rows], x @ axes.T, atol=1e-6)


def test_clusters_query_is_a_fixed_point(spark):
    from marlstone import catalogue

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    got = {r.id: r.label for r in catalogue.kmeans(spark, "/root/testdata/sf0.001").collect()}
    x, label = np.array([r.embedding for r in rows], float), np.array([got[r.vec_id] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = np.array([x[label == k].mean(0) for k in range(8)])
    d = ((x[:, None] - centres) ** 2).sum(2)
    assert len(got) == len(rows) and (d[np.arange(len(x)), label] <= d.min(1) + 1e-3).all()


def test_wrappers():
    calls = []

    def lengths(texts):
        calls.append(list(texts))
        return [[len(t), 1.0] for t in texts]

    inner = embed.FunctionEmbedder(lengths, "len")
    store = {}
    cached = embed.CachedEmbedder(inner, store)
    cached(["a", "bb"], "document"), cached(["bb", "ccc"], "document"), cached(["a"], "query")
    assert calls == [["a", "bb"], ["ccc"], ["a"]] and len(store) == 3
    assert np.allclose(np.linalg.norm(embed.NormalizingEmbedder(inner)(["abc"]), axis=1), 1)
    many = embed.MultiEmbedder({True: inner}, lambda t: len(t) > 2, embed.FunctionEmbedder(lambda ts: [[0, 0]] * len(ts), "zero", 2))
    assert many(["a", "abc", "b"]).tolist() == [[0, 0], [3, 1], [0, 0]] and many.model_id == "multi(len|zero)"
    with pytest.raises(embed.EmbedderError):
        embed.MultiEmbedder({True: inner}, lambda t: False)(["x"])
    tries, waits = [], []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return [[1.0]] * len(texts)

    assert embed.RetryingEmbedder(embed.FunctionEmbedder(flaky), sleep=waits.append)(["x"]).tolist() == [[1.0]] and len(waits) == 2
    with pytest.raises(ValueError):
        embed.RetryingEmbedder(embed.FunctionEmbedder(lambda t: int("x")), sleep=waits.append)(["x"])
    with pytest.raises(embed.EmbedderError):
        embed.FunctionEmbedder(lambda t: [[1.0]], "one").checked(["a", "b"])
    assert embed.length_sorted(["ccc", "a", "bb"], lambda p: np.array([[len(t)] for t in p]), 2).ravel().tolist() == [3, 1, 2]


def test_services():
    seen = []

    def reply(url, payload, headers, timeout):
        seen.append((url, payload, headers))
        if "openai" in url:
            return {"data": [dict(embedding=[float(i), 0.0], index=i) for i in reversed(range(len(payload["input"])))]}
        if "cohere" in url:
            return {"embeddings": {"float": [[1.0]] * len(payload["texts"])}}
        if "google" in url:
            return {"embeddings": [{"values": [2.0]}] * len(payload["requests"])}
        return [[3.0]] * len(payload["inputs"])

    assert embed.openai_embedder(api_key="k", send=reply)(["a", "b"]).ravel().tolist() == [0, 0, 1, 0] and seen[0][2]["Authorization"] == "Bearer k"
    assert embed.cohere_embedder(api_key="k", send=reply, batch_size=500)(["a"] * 100, "query").shape == (100, 1) and seen[1][1]["input_type"] == "search_query" and len(seen) == 3
    assert embed.gemini_embedder("models/" + embed.GEMINI, send=reply, api_key="k")(["a"]).tolist() == [[2.0]]
    assert embed.http_embedder("http://x", send=reply, batch_size=2)(["a"] * 5).shape == (5, 1)
    with pytest.raises(ValueError):
        embed.openai_embedder("text-embedding-ada-002", dim=3)
    assert embed.as_embedder("voyage:voyage-3-large").dim == 1024 and embed.as_embedder().model_id == "hashing:v1@512"


# search


def index(spark, vectors, **columns):
    rows = [(f"s{k}", k, 0, v, '{"kind":"%s"}' % "ab"[k % 2], f"t{k}", f"src{k % 3}") for k, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "segment_id string, ord long, idx int, vector array<float>, metadata string, text string, source_id string")


def test_ties_filters_zero_vectors(spark):
    rows = index(spark, [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [0.0, 5.0]])
    got = [(r.segment_id, round(r.score, 6)) for r in search.top_k(rows, [3.0, 0.0], 10).orderBy("rank").collect()]
    assert got == [("s0", 1.0), ("s1", 1.0), ("s2", 0.0), ("s3", 0.0)]
    assert [r.segment_id for r in search.top_k(rows, [1.0, 1.0], 10, {"kind": "b"}).collect()] == ["s1", "s3"]
    names = lambda spec: sorted(r.segment_id for r in search.filtered(rows, spec).collect())
    assert names({"ord": {"$gte": 1, "$lt": 3}}) == ["s1", "s2"] and names({"kind": {"$ne": "a"}}) == ["s1", "s3"] and names({"absent": {"$exists": False}}) == ["s0", "s1", "s2", "s3"]
    assert names({"$and": [{"kind": {"$in": ["a"]}}, {"ord": {"$nin": [0]}}]}) == ["s2"] and names({"absent": "x"}) == [] and names({"kind": {"$not": {"$eq": "a"}}}) == ["s1", "s3"]
    with pytest.raises(ValueError):
        search.filtered(rows, {"a": {"$like": 1}})
    assert search.top_k(rows.limit(0), [1.0, 0.0]).count() == 0


def test_batch_equals_single_and_blocks(spark, monkeypatch):
    r = np.random.default_rng(0)
    rows = index(spark, r.normal(size=(40, 4)).tolist())
    asked = rows.select(F.col("segment_id").alias("query_id"), "vector")
    few = {(x.query_id, x["rank"]): x.key for x in search.batch_top_k(rows, asked, 3).collect()}
    monkeypatch.setattr(search, "MOST_BROADCAST", 5)
    monkeypatch.setattr(search, "BLOCK_ROWS", 15)
    assert few == {(x.query_id, x["rank"]): x.key for x in search.batch_top_k(rows, asked, 3).collect()} and len(few) == 120
    one = search.top_k(rows, rows.where("segment_id = 's7'").first().vector, 3).orderBy("rank").collect()
    assert [x.segment_id for x in one] == [few["s7", k] for k in (1, 2, 3)]


def test_rerank_is_stable(spark):
    hits = search.top_k(index(spark, [[1.0, 0.0], [1.0, 0.1], [1.0, 0.2], [1.0, 0.3]]), [1.0, 0.0], 4)
    got = search.rerank(hits, lambda q, texts: [1.0 if t == "t3" else 0.0 for t in texts], "q", 3).orderBy("rank").collect()
    assert [r.text for r in got] == ["t3", "t0", "t1"]
    with pytest.raises(Exception, match="scores"):
        search.rerank(hits, lambda q, texts: [1.0], "q").collect()
    meta = search.with_source(hits).orderBy("rank").first()
    assert meta.metadata == '{"kind":"a","source":"src0"}'
    asked = []
    find = search.with_reranker(lambda q, limit: asked.append(limit) or hits.limit(limit), lambda q, t: list(range(len(t))), 4)
    assert find("q", limit=2).count() == 2 and asked == [4]


# lineage and configurations


def test_graph_diamond():
    g = graph.Graph()
    g.register_op("up", lambda x: x + 1), g.register_op("sum", lambda a, b: a + b)
    g.put("src", 1)
    a, b = g.add(graph.recipe("up", "src", op_version="1")), g.add(graph.recipe("up", "src", op_version="2"))
    sink = g.add(graph.recipe("sum", a, b, op_version="1"))
    assert g.materialize(sink) == 4 and {a, b, sink} == g.descendants("src") and {"src", a, b} == g.ancestors(sink)
    assert g.mark_stale(a) == {a, sink} and g.freshness(a) == "stale" and g.freshness("src") == "materialized" and g.freshness("?") == "unknown"
    assert len(g) == 4 and g.delete_cascade(a) == {a, sink} and g.descendants("src") == {b}
    with pytest.raises(KeyError):
        g.materialize("nothing")
    with pytest.raises(LookupError):
        g.materialize(g.add(graph.recipe("none", "src", op_version="1")))


def test_graph_tables(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "t"), ("b", "t"), ("x", "y"), ("y", "x")], "src string, dst string")
    seed = spark.createDataFrame([("s",), ("x",)], "seed string")
    assert {tuple(r) for r in graph.descendants(edges, seed).collect()} == {("s", "a"), ("s", "b"), ("s", "t"), ("x", "y")}
    rows = spark.createDataFrame([("s", None, None, [], None, True), ("a", "o", "1", ["s"], "{}", True), ("b", "o", "1", ["s"], "{}", True), ("t", "o", "1", ["a", "b"], "{}", True)], graph.ARTIFACTS)
    own = graph.edges_of(rows)
    stale = graph.mark_stale(rows, own, spark.createDataFrame([("a",)], "seed string"))
    assert {r.artifact_id for r in stale.where("not materialized").collect()} == {"a", "t"}
    left, ends = graph.prune_dead_leaves(rows, own, rows.where("false").select("artifact_id"))
    assert left.count() == 0 and ends.count() == 0
    asked = spark.createDataFrame([("a",), ("q",)], "artifact_id string")
    assert {tuple(r) for r in graph.freshness(stale, asked).collect()} == {("a", "stale"), ("q", "unknown")}


def test_configurations():
    p = Pipeline(Step("segment:x", params={"b": 1, "a": 2}), Step("embed:y"))
    assert Pipeline.from_dict(p.as_dict()) == p and p.config_id == Pipeline(Step("segment:x", params={"a": 2, "b": 1}), Step("embed:y")).config_id
    assert full_arguments(lambda x, y=2, *, z=3: 0, (1,), {"extra": 5}) == {"extra": 5, "x": 1, "y": 2, "z": 3}
    assert step_parameters(lambda data, k=1: 0, {"k": 4}) == {"k": 4}


# evaluation and exploration


def test_metrics_closed_forms(spark):
    qrels = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("q", "c", 0.0), ("p", "z", 1.0), ("none", "c", 0.0)], "query_id string, doc_id string, relevance double")
    runs = spark.createDataFrame([("q", "c", 1), ("q", "a", 2), ("q", "b", 4)], "query_id string, doc_id string, rank int")
    got = {(r.query_id, r.metric, r.k): r.value for r in evaluation.query_metrics(runs, qrels, (2, 10)).collect()}
    assert got["q", "ndcg", 10] == pytest.approx((3 / math.log2(3) + 1 / math.log2(5)) / (3 + 1 / math.log2(3)))
    assert (got["q", "recall", 2], got["q", "precision", 10], got["q", "mrr", 10]) == (0.5, 0.2, 0.5) and got["q", "map", 10] == pytest.approx((1 / 2 + 2 / 4) / 2)
    assert got["p", "ndcg", 10] == 0 and not any(k[0] == "none" for k in got)
    with pytest.raises(ValueError):
        evaluation.query_metrics(runs, qrels, metrics=("bleu",))
    means, _ = evaluation.evaluate_retrieval(runs, qrels, spark.createDataFrame([("q", "x")], "query_id string, text string"), (10,))
    assert evaluation.primary(means) == pytest.approx((3 / math.log2(3) + 1 / math.log2(4)) / (3 + 1 / math.log2(3)))  # ranks are made dense
    with pytest.raises(ValueError):
        evaluation.evaluate_retrieval(runs, qrels, spark.createDataFrame([("none", "x")], "query_id string, text string"))


def test_rag(spark):
    kind = "user_input string, response string, reference string, retrieved_contexts array<string>"
    rows = spark.createDataFrame([("u", "The cat, sat!", "a cat sat", ["cat food", "dog"]), ("u", "the", "An a", []), ("u", " ", None, None), ("u", "x x y", "x z", ["z"])], kind)
    got = evaluation.rag_metrics(rows).collect()
    assert (got[0].exact_match, got[0].token_f1, got[0].context_recall, got[0].context_precision) == (1.0, 1.0, 0.5, 0.5)
    assert (got[1].token_f1, got[1].context_recall, got[1].context_precision) == (1.0, 0.0, 0.0) and got[2].exact_match is None and got[2].non_empty_rate == 0.0
    assert got[3].token_f1 == pytest.approx(2 * 1 / 5)
    means = {r.metric: (r.value, r.coverage) for r in evaluation.evaluate_rag(rows).collect()}
    assert means["exact_match"] == (pytest.approx(2 / 3), 3) and means["non_empty_rate"] == (0.75, 4)


def test_blobs(spark):
    r = np.random.default_rng(0)
    x = np.concatenate([c + r.normal(scale=0.3, size=(15, 8)) for c in (np.eye(8)[0] * 5, np.eye(8)[1] * 5, np.eye(8)[2] * 5)])
    rows = spark.createDataFrame([(k, v.tolist(), f"t{k}") for k, v in enumerate(x)], "id long, vector array<double>, text string")
    both, titles = explore.explore(rows, 2, {"method": "pca"}, {"n_clusters": 3}, titles=lambda ts: f"{len(ts)} texts")
    got = both.orderBy("id").collect()
    assert all(len({q.label for q in got[i : i + 15]}) == 1 for i in (0, 15, 30)) and len({q.label for q in got}) == 3 and set(titles.values()) == {"15 texts"}
    coords, centred = np.array([q.coords for q in got]), x - x.mean(0)
    u, s = np.linalg.svd(centred, full_matrices=False)[:2]
    assert np.allclose(coords @ coords.T, (u[:, :2] * s[:2]) @ (u[:, :2] * s[:2]).T, atol=1e-6)
    thin = spark.createDataFrame([(0, [1.0]), (1, [3.0]), (2, [5.0])], "id long, vector array<double>")
    assert [len(q.coords) for q in explore.pca(thin, 3).collect()] == [3, 3, 3]
    with pytest.raises(ValueError):
        explore.project(thin.limit(1))
    with pytest.raises(ValueError):
        explore.cluster(thin, "dbscan")


def test_scores_in_tiles_equal_all_at_once_and_take_little_memory():
    r = np.random.default_rng(1)
    vectors = r.integers(-2, 3, (20_000, 6)).astype(np.float32)  # many ties, and vectors without length
    table = pa.record_batch({"key": pa.array(map(str, range(20_000))), "ord": pa.array(r.permutation(20_000)), "idx": pa.array(np.zeros(20_000, np.int32)), "vector": pa.FixedSizeListArray.from_arrays(pa.array(vectors.ravel()), 6).cast(pa.list_(pa.float32()))})
    asked = vectors[:300].astype(np.float64)
    tracemalloc.start()
    got = search._best(pa.array(map(str, range(300))), asked, table, 7).to_pandas()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # all scores of 256 queries at once take three times 41 MB
    wide = vectors.astype(np.float64)
    sizes = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(wide, axis=1)[None]
    scores = np.round(np.divide(asked @ wide.T, sizes, out=np.zeros_like(sizes), where=sizes > 0), 9)
    order = table.column("ord").to_numpy()
    for q in range(300):
        own = got[got.query_id == str(q)].sort_values(["score", "ord"], ascending=[False, True])
        best = np.lexsort((order, -scores[q]))[:7]
        assert own.key.tolist() == [str(k) for k in best] and own.score.tolist() == scores[q][best].tolist()


def test_classes_give_what_their_pairs_give(spark):
    r = np.random.default_rng(2)
    labels = [int(x) if x < 4 else None for x in r.integers(0, 5, 60)] + [9]  # 9 is alone
    rows = spark.createDataFrame([(str(k), x) for k, x in enumerate(labels)], "doc_id string, label int")
    pairs = spark.createDataFrame([(str(i), str(j), 1.0) for i, a in enumerate(labels) for j, b in enumerate(labels) if a is not None and a == b and i != j], "query_id string, doc_id string, relevance double")
    runs = spark.createDataFrame([(str(q), str(d), k + 1) for q in range(61) for k, d in enumerate(r.permutation(61)[:12].tolist())], "query_id string, doc_id string, rank int")
    values = lambda t: {tuple(x[:3]): round(x[3], 9) for x in t.select("query_id", "metric", "k", "value").collect()}
    classes = evaluation.Classes(rows)
    want = values(evaluation.query_metrics(runs, pairs, (1, 5, 10)))
    assert want and values(evaluation.query_metrics(runs, classes, (1, 5, 10))) == want
    asked = rows.where("doc_id < '3'").selectExpr("doc_id AS query_id")
    for a, b in zip(evaluation.evaluate_retrieval(runs, classes, asked, (3,)), evaluation.evaluate_retrieval(runs, pairs, asked, (3,))):
        assert sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in a.collect()) == sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in x) for x in b.collect())


def test_term_weights_shuffle_no_text_and_keep_documents_of_one_id_together(spark, tmp_path):
    from marlstone import catalogue

    rows = [(1, "b a b a a"), (2, ""), (3, None), (4, "x"), (5, "Ünï ünï ü")]

    def got(rows, name):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        return catalogue.term_weights(spark, f"{tmp_path}/{name}")

    once = got(rows, "once")
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    found = {(r.doc_id, r.gram): (r.times, r.weight) for r in once.collect()}
    assert found == {k: (n, round(1 + math.log(n), 9)) for k, n in {(1, "a"): 3, (1, "b"): 2, (1, "b a"): 2, (1, "a b"): 1, (1, "a a"): 1, (4, "x"): 1, (5, "ünï"): 2, (5, "ü"): 1, (5, "ünï ünï"): 1, (5, "ünï ü"): 1}.items()}
    twice = {(r.doc_id, r.gram): r.times for r in got([*rows, (1, "a c"), (None, "y"), (None, "y y")], "twice").collect()}
    assert twice == {**{k: n for k, (n, _) in found.items()}, (1, "a"): 4, (1, "c"): 1, (1, "a c"): 1, (None, "y"): 3, (None, "y y"): 1}


def test_texts_are_python_objects_a_few_at_a_time():
    texts = ["x" * 3000] * 5000 + ["y" * (3 << 20), None, ""]
    parts = list(shared.in_parts([pa.record_batch({"text": pa.array(texts)})]))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts and max(len(p) for p in parts) <= shared.PART_ROWS
    assert all(len(p) == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= shared.PART_BYTES for p in parts)


def test_hashing_embedder_holds_the_grams_of_one_text(monkeypatch):
    r = np.random.default_rng(3)
    texts = [" ".join(map(str, r.integers(0, 10**9, 600))) for _ in range(200)]
    tracemalloc.start()
    embed.HashingEmbedder(16)(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25e6  # all texts' grams at once take more than 40 MB


def test_no_inert_character_is_changed_by_nfc():
    spans = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", identity.INERT)]
    inert = {c for a, b in spans for c in range(a, b + 1)}
    joins = {int(d.split()[-1], 16) for c in range(0x110000) if (d := unicodedata.decomposition(chr(c))) and "<" not in d and " " in d} | set(range(0x1161, 0x11C3))
    assert not inert & joins and not any(unicodedata.combining(chr(c)) or not unicodedata.is_normalized("NFC", chr(c)) for c in inert)


def test_segments_need_one_python_step(spark):
    sources = as_corpus(spark, {"a": {"text": "Cafe\u0301. Ein Satz", "k": 1}, "b": "x"})
    plan = segment.Recursive(4, 0).segments(sources.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
