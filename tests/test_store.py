import pytest

from marlstone.operators import segment
from marlstone.operators.embed import HashingEmbedder
from marlstone.plans.manager import Manager
from marlstone.plans.store import Table


def table(spark, tmp_path, buckets=8):
    return Table(spark, f"file://{tmp_path}/t", "k string, x int", "k", buckets)


def rows(spark, *items):
    return spark.createDataFrame(items, "k string, x int")


def held(df):
    return sorted(tuple(r) for r in df.collect())


def test_groups_buckets_and_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert held(t.read()) == [] and t.version() is None
    t.replace("g", rows(spark, *((str(k), k) for k in range(40))))
    t.replace("h", rows(spark, ("0", -1)))
    before = {tuple(e[:2]): e[2:] for e in t.manifest()}
    touched = t.buckets_of(rows(spark, ("3", 0), ("4", 0)))
    now = t.read("g", touched).where("k not in ('3', '4')").unionByName(rows(spark, ("3", 33)))
    t.replace("g", now, touched)
    assert held(t.read("g")) == sorted([(str(k), k) for k in range(40) if k not in (3, 4)] + [("3", 33)]) and held(t.read("h")) == [("0", -1)]
    after = {tuple(e[:2]): e[2:] for e in t.manifest()}
    assert {k for k in before if after.get(k) != before[k]} == {("g", b) for b in touched}  # untouched folders keep their names
    with pytest.raises(ValueError):
        t.replace("g", rows(spark, *((str(k), k) for k in range(40))), touched)
    t.replace("g", rows(spark))
    assert held(t.read("g")) == [] and len(held(t.read())) == 1


def test_append_writes_only_what_is_new(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", "k string, x int")
    t.append(rows(spark, ("a", 1)))
    first = t.manifest()[0][2:]
    t.append(rows(spark, ("b", 2)))
    assert held(t.read()) == [("a", 1), ("b", 2)] and t.manifest()[0][2:3] == first
    t.append(rows(spark))
    assert len(held(t.read())) == 2


def test_of_two_writers_one_fails(spark, tmp_path):
    t = table(spark, tmp_path)
    t.replace("g", rows(spark, ("a", 1)))
    now = t.version()
    t._commit(now, t.manifest())
    with pytest.raises(RuntimeError):
        t._commit(now, t.manifest())
    assert held(t.read("g")) == [("a", 1)]


def test_old_versions_go_with_what_only_they_name(spark, tmp_path):
    t = table(spark, tmp_path, 2)
    for k in range(4):
        t.replace("g", rows(spark, *((str(i), k) for i in range(6))))
    assert t.drop_old(1) == 6 and held(t.read()) == [(str(i), 3) for i in range(6)] and len(t._names("versions")) == 1 and t.drop_old(1) == 0


def test_refresh_leaves_other_buckets_alone(spark):
    corpus = {f"s{k}": f"text {k}" for k in range(30)}
    m = Manager(spark, corpus, segment.Lines(), HashingEmbedder(8))
    m.materialize()
    before = {tuple(e[:2]): e[2:] for e in m.index.manifest()}
    m.set_corpus(corpus | {"s7": "new text"})
    assert m.refresh().counts == {"updated": 1}
    after = {tuple(e[:2]): e[2:] for e in m.index.manifest()}
    assert len([k for k in after if after[k] != before.get(k)]) == 1 and {r.source_id: r.text for r in m.rows().collect()}["s7"] == "new text"
