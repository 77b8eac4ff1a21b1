"""The pipeline against brute-force versions of its stages, on a small table with every odd case."""

import hashlib
from collections import Counter

import corpus_pipeline
import sentencepiece
import test_lines
import test_ngrams

from marlstone.llm import mixing, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the house and garden with this water that they have seen near old river town before winter came again slowly".split()


def documents():
    long = " ".join(WORDS[k % 20] + WORDS[(k * 7) % 20] for k in range(60))
    near = long.replace(WORDS[3], "other", 1)
    base = ["\n".join(f"line {a} of text {b} {WORDS[a]} {WORDS[b]} {WORDS[(a * b) % 20]} alpha" for b in range(3)) for a in range(12)]
    texts = {k: t for k, t in enumerate(base)} | {20: long, 21: near, 22: long, 23: None, 24: "", 25: "123 456 !!", 26: base[3] + "\nan entirely own line at the end", 27: "line 0 of text 0 the the the alphA", None: "a text without id that stands first of all"}
    return [(i, t, "en", None if i == 5 else f"s{(i or 0) % 2}", len(t or "")) for i, t in texts.items()]


def brute(rows):
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept = test_lines.brute([(r[0], r[1]) for r in rows])
    rows = [(r[0], kept[r[0]], *r[2:]) for r in rows if r[0] in kept]
    order = {r[0]: -1 if r[0] is None else r[0] for r in rows}
    up = {i: i for i in order.values()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in test_ngrams.brute([(order[r[0]], r[1]) for r in rows]):
        a, b = root(order[rows[a][0]]), root(order[rows[b][0]])
        up[max(a, b)] = min(a, b)
    rows = [r for r in rows if root(order[r[0]]) == order[r[0]]]
    chars = Counter()
    for r in rows:
        chars[r[3] or ""] += len(r[1])
    share = {s: float(n) ** mixing.ALPHA for s, n in chars.items()}
    scale = max(chars[s] / share[s] for s in chars)
    out = []
    for s in chars:
        each = int(scale * share[s] / chars[s] * mixing.UNIT + 0.5)
        end = int(hashlib.md5(f"{mixing.SEED}|{s}".encode()).hexdigest()[:7], 16) % mixing.UNIT
        for r in sorted((r for r in rows if (r[3] or "") == s), key=lambda r: (0 if r[0] is None else r[0] % mixing.BUCKETS, r[0] is not None, r[0] or 0)):
            out += [r] * ((end + each) // mixing.UNIT - end // mixing.UNIT)
            end += each
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    return Counter((r[0], tuple(library.encode(r[1]))) for r in out)


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows)


def test_stages_keep_columns_and_take_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA + ", row int, copy string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, None)
        assert out.columns == empty.columns and out.count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line dedup", "near copies", "source mix", "tokens"]
