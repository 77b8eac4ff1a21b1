import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from marlstone.llm import ngrams

SCHEMA = "doc_id long, text string, sig string, component int"


def grams(text):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def corpus(seed=3, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "größe"]
    shared = " ".join(r.choice(vocabulary) for _ in range(15))
    docs = []
    for i in range(n):
        if docs and r.random() < 0.6:
            words = r.choice(docs)[1].split()
            for _ in range(r.randint(0, max(1, len(words) // 6))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
        else:
            words = [r.choice(vocabulary) for _ in range(r.randint(1, 60))] + (shared.split() if r.random() < 0.5 else [])
        docs.append((i, " ".join(words)))
    return docs


def brute(docs, theta=ngrams.THETA):
    """All similar pairs of row numbers."""
    sets = [grams(t) for _, t in docs]
    return {(a, b) for a in range(len(docs)) for b in range(a + 1, len(docs)) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= (theta - 1e-9) * len(sets[a] | sets[b])}


def grouped(docs):
    """Of each row: its id, the least id connected to it, how many rows it is similar to."""
    up, links = list(range(len(docs))), [0] * len(docs)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    place = {k: i for i, k in enumerate(order)}
    for a, b in brute(docs):
        links[a] += 1
        links[b] += 1
        a, b = root(place[a]), root(place[b])
        up[max(a, b)] = min(a, b)
    return Counter((docs[k][0], docs[order[root(place[k])]][0], links[k]) for k in range(len(docs)))


def joined(df):
    return Counter((r.doc_id, r.class_id, r.links) for r in ngrams.join(df).collect())


def test_join_against_brute_force(spark):
    docs = corpus()
    docs += [(len(docs) + i, t) for i, t in docs[::5]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    assert joined(df) == grouped(docs)


def test_components_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "COMPONENT_GRAMS", 300)
    base = corpus(5, 1)[0][1].split() * 3
    docs = [(i, " ".join([*base[: 30 + i % 4], f"own{i % 17}", *base[30 + i % 4 :]])) for i in range(60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    assert joined(df) == grouped(docs)
    want = {(docs[a][0], docs[b][0]) for a, b in brute(docs)}
    got = [(r.doc_a, r.doc_b) for r in ngrams.all_pairs(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_all_pairs_against_brute_force(spark):
    docs = corpus()
    docs += [(len(docs) + i, t) for i, t in docs[::3]]
    sets = {i: grams(t) for i, t in docs if grams(t)}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= (ngrams.THETA - 1e-9) * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = [((r.doc_a, r.doc_b), r.jaccard) for r in ngrams.all_pairs(df).collect()]
    assert len(got) == len(want) and dict(got) == want


def test_keep_one_against_brute_force(spark):
    docs = corpus(8)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = ngrams.keep_one(df).collect()
    assert {r.doc_id for r in got} == {c for _, c, _ in grouped(docs)} and all(r.sig == "x" for r in got)


def test_divide_skip_against_brute_force():
    r = np.random.default_rng(2)
    for theta in (0.3, 0.6, 0.9):
        base = [np.unique(r.integers(0, 300, r.integers(1, 80)).astype(np.uint64)) for _ in range(12)]
        sets = [np.unique(np.where(r.random(len(b)) < 0.15, r.integers(0, 300, len(b)), b).astype(np.uint64)) for b in base for _ in range(4)]
        got = {(min(i, j), max(i, j)): c for i, j, c in ngrams.divide_skip(sets, theta)}
        assert got == {(min(i, j), max(i, j)): c for i, j, c in ngrams.divide_skip(sets, theta, merge=ngrams.heap_merge)}
        want = {}
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                c = len(np.intersect1d(sets[i], sets[j]))
                if c / (len(sets[i]) + len(sets[j]) - c) >= theta - 1e-9:
                    want[i, j] = c
        assert got == want


def test_pair_hits_of_long_lists():
    gram = np.repeat(np.array([1, 2, 3], np.uint64), [2100, 3, 1])
    pairs = list(zip(*map(np.concatenate, zip(*ngrams._pair_hits(gram, np.arange(len(gram)))))))
    assert len(pairs) == len(set(pairs)) == 2100 * 2099 // 2 + 3


def test_merges_are_equal():
    r = np.random.default_rng(6)
    lists = [np.unique(r.integers(0, 50, k)).astype(np.int32) for k in (1, 5, 40, 40, 90)]
    a, b = ngrams.heap_merge(lists), ngrams.run_merge(lists)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_packed_pairs_come_back():
    r = np.random.default_rng(7)
    for n, most in ((3, 2), (400, 300), (400, 70_000)):
        names, sizes = np.sort(r.integers(0, 1 << 62, n)).astype(np.uint64), r.integers(1, 9, n)
        a, b = np.triu_indices(n, 1)
        pick = r.random(len(a)) < 0.3
        pick[0] = True
        a, b = a[pick], b[pick]
        hits = r.integers(1, most, len(a))
        u, nu, many, v, nv, at, h = ngrams._unpack_pairs(*ngrams._pack_pairs(names, sizes, a, b, hits))
        assert np.repeat(u, many).tolist() == names[a].tolist() and v[at].tolist() == names[b].tolist() and h.tolist() == hits.tolist()
        assert np.repeat(nu, many).tolist() == sizes[a].tolist() and nv[at].tolist() == sizes[b].tolist()


def test_two_sets_of_millions_of_grams():
    n = 3_000_000
    r = np.random.default_rng(8)
    grams = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
    a, b = grams[: len(grams) - 1500], grams[1500:]
    held = (np.concatenate([a, b]), np.array([len(a), len(b)]), np.array([5, 9], np.uint64))
    rows = ngrams._posting_rows([held], 12, ngrams.THETA, np.zeros(1 << 8, np.uint8), 8)
    pairs = list(ngrams._bucket_pairs([rows], ngrams.THETA, 12))
    merged = pa.Table.from_batches(pairs).combine_chunks().to_batches()
    assert [(r["u"], r["v"]) for x in ngrams._likely_pairs(merged, ngrams.THETA) for r in x.to_pylist()] == [(9, 5)]


def test_edges(spark):
    text = "one two three four five six"
    rows = [(None, text), (1, None), (2, ""), (3, "!!! ..."), (4, text), (4, text), (5, "word"), (6, "Word!"), (7, " ".join(map(str, range(60_000))))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    assert joined(df) == grouped(rows)
    assert Counter({(None, None, 2): 1, (4, None, 2): 2, (5, 5, 1): 1, (6, 5, 1): 1, (7, 7, 0): 1}) <= joined(df)
    kept = ngrams.keep_one(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 5), (True, 7)]
    assert ngrams.join(df.limit(0)).count() == 0 and ngrams.keep_one(df.limit(0)).count() == 0
    assert ngrams.keep_one(df.where("doc_id = 4")).count() == 1


def postings_of(sets, groups, theta=ngrams.THETA):
    """Rows of _group_rows, by group, of sets of grams named 0, 1, ..."""
    held = (np.concatenate(sets), np.array([len(s) for s in sets]), np.arange(len(sets), dtype=np.uint64))
    rows = pa.Table.from_batches(ngrams._group_rows([held], groups, theta, np.zeros(1 << 8, np.uint8), 8))
    return rows.sort_by("bucket").combine_chunks().to_batches()


def test_parts_and_ranges_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "POSTINGS", 40)
    monkeypatch.setattr(ngrams, "PART_GRAMS", 4)
    monkeypatch.setattr(ngrams, "PAIR_HITS", 100)
    docs = corpus(11, 200)
    docs += [(len(docs) + i, t) for i, t in docs[::7]]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    groups = ngrams._groups(ngrams._classes(ngrams.identified(df, "doc_id", "text"), ngrams.N), ngrams.THETA)
    assert groups.parts.max() > 4 and groups.ranges.max() > 2
    assert joined(df) == grouped(docs)


def test_groups_find_every_similar_pair(monkeypatch):
    r = np.random.default_rng(12)
    base = [np.unique(r.integers(0, 1 << 63, int(2 ** r.uniform(0, 10))).astype(np.uint64)) for _ in range(60)]
    sets = [np.unique(np.where(r.random(len(b)) < x, r.integers(0, 1 << 63, len(b)).astype(np.uint64), b)) for b in base for x in (0, 0.08, 0.2, 0.24, 0.3)]
    sets += [s[r.random(len(s)) < 0.62] for s in sets if len(s) > 40]
    want = {(min(i, j), max(i, j)) for i, j, _ in ngrams.divide_skip(sets, ngrams.THETA)}
    for postings, hits in ((2_000_000, 2_000_000), (300, 50), (30, 50)):
        monkeypatch.setattr(ngrams, "POSTINGS", postings)
        monkeypatch.setattr(ngrams, "PAIR_HITS", hits)
        groups = ngrams.Groups(np.full(ngrams.CLASSES, 3000))
        edges = [(e["u"], e["v"]) for x in ngrams._group_pairs(postings_of(sets, groups), ngrams.THETA, groups) for e in x.to_pylist()]
        root = dict(ngrams.forest(np.array(edges)).tolist())
        assert len(want) > 200 and all(root.get(a, a) == root.get(b, b) for a, b in want)


def sharing(documents, shared, own=20):
    """Sets of grams of their own, and the same few rarest ones in all."""
    r = np.random.default_rng(13)
    few = np.arange(1, shared + 1, dtype=np.uint64)
    return [np.concatenate([few, np.unique(r.integers(1 << 40, 1 << 63, own).astype(np.uint64))]) for _ in range(documents)]


def test_pairs_with_few_hits_do_not_leave_their_group():
    groups = ngrams.Groups(np.full(ngrams.CLASSES, 1000))
    rows = postings_of(sharing(1500, 2), groups)
    assert not list(ngrams._group_pairs(rows, ngrams.THETA, groups))
    rows = postings_of(sharing(1500, 6), groups)  # hits enough, but parities that differ
    assert not list(ngrams._group_pairs(rows, ngrams.THETA, groups))


def test_a_group_holds_few_pairs_at_a_time(monkeypatch):
    monkeypatch.setattr(ngrams, "PAIR_HITS", 200_000)
    groups = ngrams.Groups(np.full(ngrams.CLASSES, 1000))
    rows = postings_of(sharing(3000, 3), groups)
    tracemalloc.start()
    found = list(ngrams._group_pairs(rows, ngrams.THETA, groups))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not found and peak < 50e6  # 13.5 million hits of 4.5 million pairs


def test_a_large_group_is_not_held_whole():
    groups = ngrams.Groups(np.full(ngrams.CLASSES, 1000))
    r = np.random.default_rng(14)
    n, kept = 500_000, 10_000
    parities, low = r.integers(0, 1 << 63, 4 * n).astype(np.uint64), r.integers(0, 1 << 32, 3 * n).astype(np.uint32)
    parities[-4:], low[-3:] = parities[:4], low[:3]  # the last document is like the first
    columns = [np.arange(n, dtype=np.uint64), *(np.full(n, x, np.int32) for x in (64, 13, 3)), parities, low]
    rows = [[x[k * len(x) // n : (k + kept) * len(x) // n].tobytes() for x in columns] for k in range(0, n, kept)]
    batch = pa.record_batch([pa.array([int(groups.begin[3])] * len(rows)), *(pa.array(c, pa.binary()) for c in zip(*rows))], names=["bucket", "docs", "sizes", "inside", "here", "parities", "grams"])
    del columns, rows, parities, low
    tracemalloc.start()
    found = [e for x in ngrams._group_pairs([batch], ngrams.THETA, groups) for e in x.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [{"u": n - 1, "v": 0}] and peak < 65e6  # a group of 32 MB in its rows


def test_search_holds_postings_once():
    r = np.random.default_rng(15)
    sets = [np.unique(r.integers(0, 1 << 63, 100_000).astype(np.uint64)) for _ in range(10)]
    sets.append(sets[0][1000:])
    tracemalloc.start()
    found = list(ngrams.divide_skip(sets, ngrams.THETA))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(0, 10, len(sets[10]))] and peak < 60e6  # 1.1 million postings
