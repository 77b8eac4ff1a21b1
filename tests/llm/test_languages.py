import itertools
import random

import numpy as np

from marlstone.llm import languages

SCHEMA = "doc_id long, text string, lang string, span string, words int"
TEXTS = {"en": "the house and the garden with this water that they have", "de": "das haus und der garten mit diesem wasser nicht schön über", "fr": "la maison et le jardin avec cette eau été où français", "es": "la casa y el jardín con esta agua niño mañana según"}


def train():
    return languages.Model.train([(k, v) for k, v in TEXTS.items() for _ in range(5)])


def test_viterbi_against_all_paths():
    r = np.random.default_rng(3)
    for penalty in (0.0, 1.0, 5.0):
        counts = np.array([0, 4, 1, 5, 0, 3])
        scores = r.normal(size=(counts.sum(), 3)).astype(np.float32) * 2
        got = languages.viterbi(scores, counts, penalty)
        begin = 0
        for n in counts:
            own = scores[begin : begin + n].astype(np.float64)
            value = lambda p: sum(own[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if n:
                best = max(value(p) for p in itertools.product(range(3), repeat=int(n)))
                assert abs(value(tuple(got[begin : begin + n])) - best) < 1e-4
            begin += n


def test_spans_of_mixed_text(spark):
    text = "the house and the garden das haus und der garten nicht, Привет мир! 你好"
    rows = languages.spans(spark.createDataFrame([(1, text, None, "x", 1)], SCHEMA), train()).orderBy("span").collect()
    assert [r.lang for r in rows] == ["en", "de", "ru", "zh"]
    assert rows[0].begin == 0 and text[rows[1].begin : rows[1].end] == "das haus und der garten nicht" and rows[2].words == 2


def test_languages_that_share_a_script():
    model = train()
    for text, want in (
        ("你好 世界 我们在北京", {"zh"}), ("日本語の文章です。漢字とかな", {"ja"}), ("これは東京タワーです", {"ja"}), ("Привет мир, это русский", {"ru"}), ("Це українська мова, її пишуть так", {"uk"}),
        ("Гэта беларуская мова і ўсё", {"be"}), ("Ово је српски језик", {"sr"}), ("هذه لغة عربية كتبت هنا", {"ar"}), ("این یک متن فارسی است که می‌گوید", {"fa"}), ("یہ اردو کی تحریر ہے", {"ur"}), ("यह हिंदी है", {"hi"}),
    ):
        labels = languages.label_words([text], model)[3]
        assert {model.names[k] for k in labels} == want, text


def plain_spans(text, model, penalty):
    """Words by a loop, scores by hand, the best labels by a table of all changes."""
    kind, _, _, by_script, by_letter = languages.tables()
    letters = {x: names for x, names in languages.LETTERS}
    words, now = [], None
    for i, c in enumerate(text + "\n"):
        k = int(kind[ord(c)])
        if now and now[2] != k:
            words.append((now[0], i, now[2] - 1))
            now = None
        if k and not now:
            now = [i, i, k]
    best = []
    for begin, end, script in words:
        word = text[begin:end].lower()
        names = languages.SCRIPTS[script][2]
        if names:
            fit = [x for x in names if all(x in letters[c] for c in word if c in letters)]
            best.append({x: -languages.RARER * (x != names[0]) for x in fit})
        else:
            flat = [0, *(ord(c) for c in word), 0]
            mask, top = (1 << 64) - 1, 64 - languages.BITS
            grams = [(((a * 0x10001 + b) & mask) * 0x9E3779B97F4A7C15 & mask) >> top for a, b in zip(flat, flat[1:])]
            grams += [((((a * 0x10001 + b) * 0x10003 + c + 7) & mask) * 0x9E3779B97F4A7C15 & mask) >> top for a, b, c in zip(flat, flat[1:], flat[2:])]
            best.append({x: float(sum(model.weights[g, k] for g in grams)) for k, x in enumerate(model.trained)})
    every = model.names
    value, came = {x: 0.0 for x in every}, []
    for n, own in enumerate(best):
        step, back = {}, {}
        for x in every:
            back[x] = max(every, key=lambda y: (value[y] - penalty * (x != y) * (n > 0), y == x)) if n else x  # noqa: B023
            step[x] = value[back[x]] - penalty * (x != back[x]) + (own.get(x, languages._BAD) if own else 0)
        value = step
        came.append(back)
    labels = []
    if best:
        at = max(every, key=lambda x: value[x])
        for n in range(len(best) - 1, -1, -1):
            labels.append(at if best[n] else "und")
            at = came[n][at]
    labels.reverse()
    out = []
    for (begin, end, _), lang in zip(words, labels):
        if out and out[-1][2] == lang:
            out[-1] = (out[-1][0], end, lang, out[-1][3] + 1)
        else:
            out.append((begin, end, lang, 1))
    return out


def test_spans_and_the_share_rule_against_brute_force(spark):
    r, model = random.Random(9), train()
    more = ["Привет мир и люди", "Це її мова", "日本語のかな 漢字", "你好 世界", "123 !?", "هذه لغة", "été Größe", "\n\n"]
    texts = [" ".join(r.choice([*TEXTS.values(), *more]) for _ in range(r.randint(1, 4))) for _ in range(60)]
    df = spark.createDataFrame([(k, t, None, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {}
    for x in languages.spans(df, model).orderBy("doc_id", "span").collect():
        got.setdefault(x.doc_id, []).append((x.begin, x.end, x.lang, x.words))
    want = {k: plain_spans(t, model, languages.PENALTY) for k, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}
    kept = {x.doc_id for x in languages.keep_known(df, model, least_share=0.7).collect()}
    share = lambda v: max((sum(n for *_, x, n in v if x == lang) for *_, lang, _ in v if lang != "und"), default=0) / sum(n for *_, n in v)
    assert kept == {k for k, v in want.items() if v and share(v) >= 0.7} and 0 < len(kept) < len(texts)


def test_labels_decide_which_languages_are_trained(spark):
    rows = [(1, TEXTS["fr"], "xx", "x", 1), (2, TEXTS["en"], "en", "x", 1), (3, "привет", "ru", "x", 1), (4, None, "de", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert languages.train(df).trained == ["en", "xx"] and languages.train(df, languages=["en"]).trained == ["en"]


def test_edges(spark):
    rows = [(1, None, "en", "x", 1), (2, "", "en", "x", 1), (3, "123 !?", "en", "x", 1), (9, TEXTS["de"], "de", "x", 1), (None, TEXTS["de"], "de", "x", 1), (4, TEXTS["en"], "en", "x", 1), (4, TEXTS["en"], "en", "x", 1), (5, TEXTS["fr"] + " " + TEXTS["fr"] * 3000, "fr", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = languages.train(df)
    got = languages.spans(df, model).collect()
    assert sorted({(r.doc_id or 0, r.lang) for r in got}) == [(0, "de"), (4, "en"), (5, "fr"), (9, "de")] and len([r for r in got if r.doc_id == 4]) == 2
    kept = languages.keep_known(df, model)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4, 5, 9]
    empty = df.limit(0)
    assert languages.spans(empty, languages.train(empty)).count() == 0 and languages.keep_known(empty, model).count() == 0
    none = languages.train(empty)
    assert languages.keep_known(df, none).count() == 0 and {r.lang for r in languages.spans(df, none).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = languages.train(docs.where("doc_id % 2 = 0"), 60)
    rows = languages.spans(docs.where("doc_id % 2 = 1"), model)
    best = {}
    for r in rows.groupBy("doc_id", "lang").sum("words").collect():
        best[r.doc_id] = max(best.get(r.doc_id, (0, "")), (r[2], r.lang))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([best[i][1] == truth[i] for i in best]) > 0.97
