import random

import pytest

from marlstone.llm import lines
from marlstone.llm.common import components

SCHEMA = "doc_id long, text string, n_chars long, no int, row string"


def edits(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def brute(docs):
    """docs: (id, text) with distinct ids. {id: text} of what stays, ids of what goes."""
    order = [(i, k, x) for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0])) if t is not None for k, x in enumerate(t.split("\n"))]
    drop = set()
    for n, (i, k, x) in enumerate(order):
        if x.strip(" ") and any(y == x or (y.strip(" ") and abs(len(x) - len(y)) <= 1 and edits(x, y) <= 1) for _, _, y in order[:n]):
            drop.add((i, k))
    out = {}
    for i, t in docs:
        if t is None:
            out[i] = None
            continue
        parts = t.split("\n")
        left = [x for k, x in enumerate(parts) if (i, k) not in drop]
        if len(left) == len(parts) or any(x.strip(" ") for x in left):
            out[i] = "\n".join(left)
    return out


def test_within_one():
    words = [a + b + c for a in ("", "a", "ab", "ba") for b in ("", "a", "é") for c in ("", "b", "ab", "aab")]
    assert all(lines.within_one(a, b) == (edits(a, b) <= 1) for a in words for b in words)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, None, 5, "x") for i, t in rows], SCHEMA)
    return lines.dedup_lines(df).collect()


def test_against_brute_force(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "ζ"]
    pool = [" ".join(r.choice(words) for _ in range(r.randint(2, 7))) for _ in range(25)]
    for line in list(pool):
        for _ in range(3):
            k = r.randrange(len(line) + 1)
            pool.append(r.choice([line[:k] + line[k + 1 :], line[:k] + r.choice("abé ") + line[k:], line[:k] + r.choice("xyz") + line[k + 1 :]]))
    docs = [(i, "\n".join(r.choice([*pool, "", " ", "a", "ab"]) for _ in range(r.randint(1, 8)))) for i in range(60)]
    got = {x.doc_id: x.text for x in run(spark, docs)}
    assert got == brute(docs)


def test_edges(spark):
    same = "the very same line of text"
    docs = [(None, same), (1, None), (2, ""), (3, "  \n"), (4, same), (5, same + "s\n\nown line of this text"), (6, "short"), (7, "shorT"), (8, "x" * 200_000), (9, "x" * 199_999)]
    rows = run(spark, docs)
    got = {x.doc_id: x.text for x in rows}
    assert got == {None: same, 1: None, 2: "", 3: "  \n", 5: "\nown line of this text", 6: "short", 8: "x" * 200_000}
    assert all(x.no == 5 and x.row == "x" and x.n_chars == (None if x.text is None else len(x.text)) for x in rows)


def test_repeated_rows_and_empty_table(spark):
    assert [x.text for x in run(spark, [(1, "one line that is repeated"), (1, "one line that is repeated")])] == ["one line that is repeated"]
    assert run(spark, []) == []
    with pytest.raises(ValueError):
        lines.dedup_lines(spark.createDataFrame([], SCHEMA), gone_col="no")


def test_short_lines(spark):
    docs = [(1, "a\nxy"), (2, "b\nxyz\nq"), (3, "k\nxz"), (4, ""), (5, "nm\nop"), (6, "n\nfine here")]
    assert {x.doc_id: x.text for x in run(spark, docs)} == brute(docs)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (10, 9), (9, 11), (5, 5), (None, 4), (3, 1)], "u long, v long")
    assert {tuple(r) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 9), (10, 9), (11, 9), (5, 5)}
    assert components(edges.limit(0)).count() == 0
