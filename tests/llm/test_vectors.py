import numpy as np
import pytest

from marlstone.llm import multiindex, vafile

SCHEMA = "vec_id long, embedding array<float>, label int, key int, id string"


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(f) for f in v], 0, 1, "x") for i, v in zip(ids, x)], SCHEMA)


def brute(x, k=10):
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), np.round(d, 9)), axis=1)[:, :k]
    return order, np.sqrt(np.take_along_axis(d, order, 1))


def clustered(n=600, dim=16, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim)) * 3
    return (centres[r.integers(0, 12, n)] + r.normal(size=(n, dim)) * 0.4).astype(np.float32)


def test_vafile_is_exact(spark):
    x = np.concatenate([clustered(300), np.repeat(clustered(3, seed=9), 15, axis=0)])
    df = frame(spark, x)
    got = vafile.top_k(df, df.where("vec_id % 3 = 0"), 10, block=60, first=20).collect()
    order, distance = brute(x)
    for r in got:
        assert r.neighbour == order[r.vec_id, r["rank"] - 1] and r.distance == pytest.approx(distance[r.vec_id, r["rank"] - 1], abs=1e-6)
    assert len(got) == 10 * len(range(0, len(x), 3)) and 10 <= np.mean([r.reads for r in got]) < 20


def test_vafile_takes_queries_from_elsewhere(spark):
    x = clustered(200)
    got = vafile.top_k(frame(spark, x), frame(spark, [x[7], [0.0, 1.0]], [-5, 9000]), 3).orderBy("vec_id", "rank").collect()
    assert [(r.vec_id, r["rank"]) for r in got] == [(-5, 1), (-5, 2), (-5, 3)] and (got[0].neighbour, got[0].distance) == (7, 0.0)


@pytest.mark.parametrize("x", [clustered(1500), np.random.default_rng(4).normal(size=(1500, 16)).astype(np.float32)], ids=["clusters", "noise"])
def test_multi_index_recall(spark, x):
    got = multiindex.neighbours(frame(spark, x), None, 10, block=200).toPandas()
    order, _ = brute(x)
    assert len(got) == 10 * len(x)
    found = got.groupby("vec_id").neighbour.apply(set)
    assert np.mean([len(found[i] & set(order[i])) for i in range(len(x))]) >= 9.0


def test_multi_index_recall_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "SAMPLE", 512)
    r = np.random.default_rng(5)
    centres = r.normal(size=(20, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = (centres[r.integers(0, 20, 20_000)] + r.normal(size=(20_000, 8)) * 0.1).astype(np.float32)
    df = frame(spark, x)
    got = multiindex.neighbours(df, df.where("vec_id < 400"), 10).toPandas()
    d = ((x[:400, None].astype(np.float64) - x[None]) ** 2).sum(2)
    d[np.arange(400), np.arange(400)] = np.inf
    order = np.argsort(d, axis=1)[:, :10]
    found = got.groupby("vec_id").neighbour.apply(set)
    assert np.mean([len(found[i] & set(order[i])) for i in range(400)]) >= 9.8


def test_walk_ascends_and_covers():
    r = np.random.default_rng(0)
    a, b = r.random(7), r.random(5)
    cells = multiindex.walk(a, b, np.ones((7, 5), int).tolist(), 35)
    sums = [a[i] + b[j] for i, j in cells]
    assert len(set(cells)) == 35 and sums == sorted(sums)
    assert len(multiindex.walk(a, b, np.full((7, 5), 10).tolist(), 25)) == 3
    rest = multiindex.walk(a, b, np.full((7, 5), 10).tolist(), 25, sums[20])
    assert rest == cells[3:21] and multiindex.walk(a, b, np.full((7, 5), 10).tolist(), 25, 0.0) == []


def test_groups_hold_all_cells_and_cut_large_ones():
    sizes = np.array([[3, 0, 25], [4, 10, 2]])
    groups = multiindex.Groups(sizes, 10)
    assert groups.shares.tolist() == [1, 1, 3, 1, 1, 1]
    ids = np.arange(30)
    load = np.zeros(groups.count, int)
    for c, n in enumerate(sizes.ravel().tolist()):
        placed = groups.of_entries(np.full(n, c), ids[:n])
        assert set(placed.tolist()) <= set(groups.of_cells([c]))
        np.add.at(load, placed, 1)
    assert load.max() <= 10 and load.sum() == 44 and load.min() > 0


@pytest.mark.parametrize("search", [vafile.top_k, multiindex.neighbours])
def test_edges(spark, search):
    v = [0.0, 1.0]
    rows = [(1, v), (2, v), (2, v), (3, [1.0, 0.0]), (None, v), (4, None), (5, [1.0, None]), (6, [float("nan"), 0.0]), (7, [1.0, 2.0, 3.0]), (8, [])]
    df = spark.createDataFrame([(i, x, 0, 1, "x") for i, x in rows], SCHEMA)
    got = [(r.vec_id, r["rank"], r.neighbour) for r in search(df, k=5).orderBy("vec_id", "rank").collect()]
    assert got == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]
    assert search(df.limit(0), k=5).count() == 0 and search(df.where("vec_id = 1"), k=5).count() == 0 and search(df, df.limit(0), 5).count() == 0
    flat = spark.createDataFrame([(i, [1.0, 1.0], 0, 1, "x") for i in range(4)], SCHEMA)
    assert [r.neighbour for r in search(flat, k=2).where("vec_id = 3").orderBy("rank").collect()] == [0, 1]
