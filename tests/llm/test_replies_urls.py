import random
import re

import pytest

from marlstone.llm import replies, urls

TREE = "tree long, node long, parent long, role string, text string, score double, leaf int, path string"


def rows(spark, items):
    return spark.createDataFrame([(*x, 1, "x") for x in items], TREE)


def test_branches_are_ranked(spark):
    df = rows(spark, [(1, 0, None, "user", "hi", 1.0), (1, 1, 0, "bot", "low", 0.0), (1, 2, 0, "bot", "high", 4.0), (1, 3, 2, "user", "end", 1.0), (2, 7, None, None, None, None)])
    got = {(r.tree, r["rank"]): (r.leaf, r.depth, r.score, r.conversation) for r in replies.conversations(df, None).collect()}
    assert got[1, 1] == (3, 3, 2.0, "<|user|>\nhi\n<|end|>\n<|bot|>\nhigh\n<|end|>\n<|user|>\nend\n<|end|>")
    assert got[1, 2][:3] == (1, 2, 0.5) and got[2, 1] == (7, 1, 0.0, "<|unknown|>\n\n<|end|>") and len(got) == 3


def test_deep_trees_cycles_orphans_repeats(spark):
    chain = [(1, k, k - 1 if k else None, "u", str(k), 1.0) for k in range(300)]
    odd = [(2, 1, 2, "u", "a", 1.0), (2, 2, 1, "u", "b", 1.0), (3, 5, 99, "u", "orphan", 1.0), (4, 1, None, "u", "x", 1.0), (4, 1, None, "u", "y", 2.0), (None, 1, None, "u", "x", 1.0), (5, None, None, "u", "x", 1.0)]
    got = {r.tree: r for r in replies.conversations(rows(spark, chain + odd), 1).collect()}
    assert set(got) == {1, 3, 4} and got[1].depth == 300 and got[3].leaf == 5 and "y" in got[4].conversation
    assert got[1].conversation.count("<|u|>") == 300


def test_very_long_texts_and_fractions(spark):
    df = rows(spark, [(1, 0, None, "u", "x" * 300_000, 0.1), (1, 1, 0, "u", "y" * 300_000, 0.2), (1, 2, 1, "u", "z", 0.3), (1, 3, 1, "u", "q", 0.3)])
    got = replies.conversations(df).orderBy("rank").collect()
    assert [r.leaf for r in got] == [2, 3] and got[0].score == ((0.1 + 0.2) + 0.3) / 3 == got[1].score and len(got[0].conversation) > 600_000


def test_branches_against_brute_force(spark):
    r = random.Random(4)
    items = [(t, k, r.choice([None, r.randrange(30), r.randrange(k) if k else None]), "u", f"{t}.{k}", float(r.randrange(9))) for t in range(20) for k in range(r.randint(1, 30))]
    up = {(t, k): p for t, k, p, *_ in items}
    score = {(t, k): s for t, k, *_, s in items}
    want = {}
    for t, k in up:
        path, at = [], k
        while at is not None and (t, at) in up and at not in path:
            path.append(at)
            at = up[t, at]
        if at in path or any(up[o] == k and o[0] == t for o in up):
            continue
        want[t, k] = (len(path), sum(score[t, x] for x in reversed(path)) / len(path), "\n".join(f"<|u|>\n{t}.{x}\n<|end|>" for x in reversed(path)))
    got = {(x.tree, x.leaf): (x.depth, x.score, x.conversation) for x in replies.conversations(rows(spark, items), None).collect()}
    assert got == want


def test_equal_scores_go_by_leaf_and_empty_table(spark):
    df = rows(spark, [(1, 0, None, "u", "r", 1.0), (1, 5, 0, "u", "a", 1.0), (1, 3, 0, "u", "b", 1.0)])
    assert [r.leaf for r in replies.conversations(df).orderBy("rank").collect()] == [3, 5]
    assert replies.conversations(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, rule string, token int"


def test_rules_against_all_expressions(spark):
    found = [r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").collect()]
    extra = ["http://spam-farm.example.org/", "http://x.spam-farm.example.org/en/appeal", "http://notspam-farm.example.org/", "http://a.example.com/banner/1", "http://www.q.example.org/es/", "HTTP://SPAM-FARM.EXAMPLE.ORG/a", ""]
    df = spark.createDataFrame([(k, u, "", "x", 1) for k, u in enumerate([*found, *extra])], PAGES)
    compiled = [urls.compile_rule(r) for r in urls.RULES]
    for r in urls.filter_urls(df).collect():
        hit = [k for k, (p, _, _) in enumerate(compiled) if re.search(p, r.url.lower())]
        blocked = any(compiled[k][1] for k in hit) and all(compiled[k][1] for k in hit)
        assert (r.rules, r.verdict) == (",".join(map(str, hit)), "block" if blocked else "allow"), r.url


def test_url_edges(spark):
    df = spark.createDataFrame([(1, None, "", "x", 1), (2, "", "", "x", 1), (None, "http://tracker.example.com/a", "", "x", 1), (3, "http://tracker.example.com/a", "", "x", 1), (3, "http://tracker.example.com/a", "", "x", 1), (4, "http://e.org/" + "a/" * 50_000, "", "x", 1)], PAGES)
    got = sorted((r.page_id or 0, r.verdict) for r in urls.filter_urls(df).collect())
    assert got == [(0, "block"), (1, "allow"), (2, "allow"), (3, "block"), (3, "block"), (4, "allow")]
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_rules_of_any_signs(spark):
    rules = ["/a[1].php", "||x.org/p(q)+{r}", "back\\slash", "$5.00", "/q?x=^", "\"'&~`;,!", "/ünder/"]
    found = ["http://h/a[1].php", "http://h/a1.php", "http://x.org/p(q)+{r}", "http://x.org/pq", "http://h/back\\slash", "http://h/$5.00", "http://h/$5x00", "http://h/q?x=", "http://h/\"'&~`;,!", "http://h/ünder/"]
    df = spark.createDataFrame([(k, u, "", "x", 1) for k, u in enumerate(found)], PAGES)
    got = {r.url: r.rules for r in urls.filter_urls(df, rules).collect()}
    assert [got[u] for u in found] == ["0", "", "1", "", "2", "3", "", "4", "5", "6"]


def test_rules_that_are_refused():
    for rule in ("||ads.org^$third-party", "example.org##.banner", "! a comment", ""):
        with pytest.raises(ValueError):
            urls.compile_rule(rule)


def test_equally_rare_tokens(spark):
    df = spark.createDataFrame([(1, "http://h/alpha/beta", "", "x", 1), (2, "http://h/beta/alpha", "", "x", 1)], PAGES)
    assert {r.page_id: r.rules for r in urls.filter_urls(df, ["/alpha/beta", "/beta/alpha"]).collect()} == {1: "0", 2: "1"}
