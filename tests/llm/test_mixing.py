from collections import Counter

import pytest

from marlstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy int, each string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], SCHEMA)


def test_targets_and_copies(spark):
    rows = [(k, "x" * (10 + k % 7), "big") for k in range(900)] + [(1000 + k, "y" * 12, "small") for k in range(100)]
    out = mixing.mix(frame(spark, rows), {"big": 0.5, "small": 0.5}, copy_col="nth").collect()
    chars = Counter()
    for r in out:
        chars[r.source] += len(r.text)
    copies = Counter(r.doc_id for r in out)
    assert abs(chars["big"] / chars["small"] - 1) < 0.02
    small = [copies[1000 + k] for k in range(100)]
    assert max(small) - min(small) <= 1 and all(copies[k] >= 1 for k in range(900))
    assert all(r.copy == 7 and r.each == "x" for r in out)
    assert len({(r.doc_id, r.nth) for r in out}) == len(out)


def test_sources_without_weight_go_and_totals_hold(spark):
    rows = [(k, "abcde", s) for k, s in enumerate(["a"] * 50 + ["b"] * 50)]
    out = mixing.mix(frame(spark, rows), {"a": 1.0}, total_chars=100).collect()
    assert {r.source for r in out} == {"a"} and 19 <= len(out) <= 21


def test_edges(spark):
    rows = [(None, "abc", "s"), (1, None, "s"), (2, "", "s"), (3, "abc", None), (4, "abc", "s"), (4, "abc", "s"), (5, "", "empty"), (6, "z" * 300_000, "long")]
    out = mixing.mix(frame(spark, rows)).collect()
    got = Counter((r.doc_id, r.text, r.source) for r in out)
    assert all(got[x] >= 1 for x in rows) and got[4, "abc", "s"] >= 2
    assert mixing.mix(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, rows), copy_col="copy")


def test_same_result_again(spark):
    df = frame(spark, [(k, "abc" * (k % 5 + 1), f"s{k % 3}") for k in range(200)])
    first = sorted(r.doc_id for r in mixing.mix(df, {"s0": 0.7, "s1": 0.2, "s2": 0.1}, total_chars=900).collect())
    assert first == sorted(r.doc_id for r in mixing.mix(df.repartition(7), {"s0": 0.7, "s1": 0.2, "s2": 0.1}, total_chars=900).collect())
