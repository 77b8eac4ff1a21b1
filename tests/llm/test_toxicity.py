import random

import numpy as np
import zstandard

from marlstone.llm import toxicity

DOCS, LABELS = "doc_id long, text string, score double, windows string", "doc_id long, toxic int, quality int"


def text(r, bad):
    words = ["".join(r.choice(["ka", "lo", "mi", "ren", "sta", "vu"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 90))]
    for _ in range(r.randint(3, 6) if bad else 0):
        words.insert(r.randrange(len(words)), r.choice(["grumblefoe", "zwackhead", "dirtpoxy", "quibblesnot"]))
    return " ".join(words)


def corpus(spark, n=700):
    r = random.Random(1)
    marks = [int(k % 5 == 0) for k in range(n)]
    docs = spark.createDataFrame([(k, text(r, m), 0.5, "x") for k, m in enumerate(marks)], DOCS)
    return docs, marks


def test_held_out_accuracy(spark):
    docs, marks = corpus(spark)
    labels = spark.createDataFrame([(k, m, 1) for k, m in enumerate(marks) if k < 500], LABELS)
    judge = toxicity.train(docs, labels)
    rows = toxicity.score(docs.where("doc_id >= 500"), judge).collect()
    caught = [r.toxic for r in rows if marks[r.doc_id]]
    alarms = [r.toxic for r in rows if not marks[r.doc_id]]
    assert sum(caught) >= 0.9 * len(caught) and sum(alarms) <= 0.03 * len(alarms)


def test_edges(spark):
    docs, marks = corpus(spark)
    labels = spark.createDataFrame([*((k, m, 1) for k, m in enumerate(marks) if k < 500), (None, 1, 1), (3, None, 1), (5, 1, 0), (5, 0, 0)], LABELS)
    judge = toxicity.train(docs, labels)
    bad = " ".join(["zwackhead ka lo dirtpoxy mi"] * 4)
    rows = spark.createDataFrame([(1, None, 0.0, "x"), (2, "", 0.0, "x"), (3, "?! ...", 0.0, "x"), (None, bad, 0.0, "x"), (4, bad, 0.0, "x"), (4, bad, 0.0, "x"), (5, "ka lo mi " * 50_000 + bad, 0.0, "x")], DOCS)
    got = sorted((r.doc_id or 0, r.toxic, r.windows) for r in toxicity.score(rows, judge).collect())
    assert got[:6] == [(0, True, 2), (1, False, 0), (2, False, 0), (3, False, 0), (4, True, 2), (4, True, 2)] and got[6][2] == -(-150_020 // 16)
    assert toxicity.score(rows.limit(0), judge).count() == 0
    assert toxicity.train(docs, labels.where("toxic = 0")) is None and toxicity.train(docs.limit(0), labels) is None
    assert not any(r.toxic for r in toxicity.score(rows, None).collect())


def plain_score(judge, text):
    """The score by one-off compressors, window by window."""
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=4, min_match=4, target_length=32, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False, write_checksum=False)
    words = toxicity.words_of(text)
    total = n = 0
    for i in range(0, len(words), toxicity.WINDOW):
        w = (" " + " ".join(words[i : i + toxicity.WINDOW]) + " ").encode()
        sizes = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(w)) for d in (judge.ordinary, judge.toxic + judge.ordinary)]
        total += max(0, sizes[0] - sizes[1] - judge.gain)
        n += 1
    return round(total / (n + 4) ** 0.5, 4)


def test_scores_and_threshold_against_brute_force(spark):
    docs, marks = corpus(spark)
    labels = spark.createDataFrame([(k, m, 1) for k, m in enumerate(marks) if k < 500], LABELS)
    judge = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in toxicity.score(docs, judge).collect()}
    assert {i: r.score for i, r in got.items()} == {i: plain_score(judge, t) for i, t in texts.items()}
    half = {r.doc_id for r in docs.where("doc_id < 500 and pmod(xxhash64(5, doc_id), 2) = 1").collect()}
    scores = sorted(got[i].score for i in half if not marks[i])
    assert judge.threshold == max(toxicity.FLOOR, scores[int(np.ceil((1 - toxicity.RATE) * len(scores))) - 1])
    assert all(r.toxic == (r.score > judge.threshold) for r in got.values())
    tied = toxicity.Judge(judge.ordinary, judge.toxic, judge.gain, max(r.score for r in got.values()))
    assert not any(r.toxic for r in toxicity.score(docs, tied).collect())


def test_short_words_are_learned(spark):
    r = random.Random(3)
    said = ["zax", "gyk", "bo", "wuf"]
    texts = [" ".join(r.choice(said) if k % 4 == 0 and r.random() < 0.2 else "".join(r.choice(["ka", "lo", "mi", "ren"]) for _ in range(3)) for _ in range(60)) for k in range(800)]
    docs = spark.createDataFrame([(k, t, 0.5, "x") for k, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0), 1) for k in range(600)], LABELS)
    rows = toxicity.score(docs.where("doc_id >= 600"), toxicity.train(docs, labels)).collect()
    assert np.mean([r.toxic for r in rows if r.doc_id % 4 == 0]) >= 0.5 and np.mean([r.toxic for r in rows if r.doc_id % 4]) <= 0.05


def test_every_window_counts():
    bad = ["vilegrunt", "snarlpig"]
    judge = toxicity.Judge.train([" ".join([bad[k % 2], f"w{k}", bad[1 - k % 2], f"v{k}", bad[k % 2]]) for k in range(60)], [" ".join(f"w{k + j} v{j}" for j in range(30)) for k in range(200)])
    plain = [f"w{k}" for k in range(500)]
    hits = [judge.score(" ".join([*plain[:at], *(bad * 3), *plain[at:]]))[1] for at in (0, 250, 500)]
    assert min(hits) >= 1 and judge.score(" ".join(plain))[1] == 0
