import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from marlstone.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_ids string"


def test_agrees_with_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(2)
    texts = ["", " ", "  two  spaces ", "line\nfeed\n\n", "été Größe 漢字 🙂 12345 ...", "x" * 300, "aaaaaaa bbbb", "tab\tand\r\n", "<s> </s> <unk> <0x41>"]
    texts += ["".join(r.choice("abc éß.,\n 1漢") for _ in range(r.randint(1, 200))) for _ in range(150)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], SCHEMA)
    rows = {x.doc_id: x for x in pieces.encode(df, whole=1).collect()}
    for k, t in enumerate(texts):
        assert list(rows[k].ids) == library.encode(t), t[:50]
        assert rows[k].round_trip and rows[k].agrees and rows[k].n_ids == len(rows[k].ids)
    back = {x.doc_id: x.text for x in pieces.decode(pieces.encode(df)).collect()}
    assert back == dict(enumerate(texts))


def test_both_agendas_agree():
    p = pieces.Pieces(pieces.MODEL)
    r = random.Random(4)
    for _ in range(200):
        t = "".join(r.choice("▁theingou aé") for _ in range(r.randint(0, 40)))
        assert p.agenda(t) == p.heap_agenda(t)


def test_agendas_together_agree():
    p = pieces.Pieces(pieces.MODEL)
    r = random.Random(6)
    texts = ["", "▁", "a", "漢", "🙂🙂", "\n", "a" * 48, "▁" * 48, "e\u0301", "\0", "\ud800x"]
    for signs in ("▁theingou aé", "ersan.,\n▁漢字🙂ß", "aab", "0123456789-▁"):
        texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 48))) for _ in range(400)]
    r.shuffle(texts)
    for some in (texts, texts[:1], []):
        assert p.agendas(some) == [np.array(p.agenda(t), np.int32).tobytes() for t in some]


def test_new_chunks_of_a_batch_are_not_met_alone(monkeypatch):
    p = pieces.Pieces(pieces.MODEL)
    chunks = pieces._Chunks(p, 300)
    monkeypatch.setitem(pieces._LOADED, "alone", (p, chunks, pieces._Words(p, chunks, 300)))
    r = random.Random(8)
    word = lambda: "".join(r.choice("einstrou.\né漢") for _ in range(r.randint(1, 20)))
    texts = [(" " * (k % 3)).join(["", *(word() for _ in range(30)), ""])[k % 2 :].strip("x") + "y" * (100 * (k % 5 == 0)) for k in range(120)]
    agenda, alone = p.agenda, []
    monkeypatch.setattr(p, "agenda", lambda t: alone.append(t) or agenda(t))
    for part in (texts[:40], texts[40:80], texts, texts[:40]):  # more than is remembered
        rows = pieces._rows("alone", pa.array(range(len(part))), part, True).to_pylist()
        assert [x["ids"] for x in rows] == [p.library.encode(t) for t in part]
        assert all(x["agrees"] and x["round_trip"] for x in rows)
    assert all(len(t) > pieces.LONGEST for t in alone)


def test_edges(spark):
    df = spark.createDataFrame([(None, "same", "x", "y"), (1, None, "x", "y"), (2, "", "x", "y"), (3, "same", "x", "y"), (3, "same", "x", "y"), (4, "▁", "x", "y"), (5, "word " * 60_000, "x", "y")], SCHEMA)
    rows = pieces.encode(df).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 7 and by[1].ids is None and by[1].n_ids is None and by[1].agrees and by[2].ids == [] and not by[4].round_trip and by[5].round_trip
    assert list(by[None].ids) == list(by[3].ids)
    assert pieces.encode(df.limit(0)).count() == 0 and pieces.decode(pieces.encode(df)).where("doc_id = 1").first().text is None


def test_a_wrong_cut_is_noticed(monkeypatch):
    p = pieces.Pieces(pieces.MODEL)
    p.chunks = lambda t: [t[:3], t[3:]] if len(t) > 3 else [t]
    chunks = pieces._Chunks(p, 10)
    monkeypatch.setitem(pieces._LOADED, "cut", (p, chunks, pieces._Words(p, chunks, 10)))
    rows = pieces._rows("cut", pa.array([1, 2]), ["something of length", "a"], True, 1).to_pylist()
    assert not rows[0]["agrees"] and rows[1]["agrees"]


def test_every_whole_text_is_compared(monkeypatch):
    p = pieces.Pieces(pieces.MODEL)
    p.chunks = lambda t: [t[:3], t[3:]] if len(t) > 3 else [t]
    chunks = pieces._Chunks(p, 1000)
    monkeypatch.setitem(pieces._LOADED, "cut", (p, chunks, pieces._Words(p, chunks, 1000)))
    texts = [f"something of length {k}" for k in range(40)]
    for _ in range(2):  # the second time all chunks are remembered
        rows = pieces._rows("cut", pa.array(range(40)), texts, True).to_pylist()
        assert not any(r["agrees"] for r in rows)


def test_ids_outside_the_vocabulary_are_refused():
    p = pieces.Pieces(pieces.MODEL)
    for ids in ([-1], [len(p.lengths)]):
        with pytest.raises(ValueError):
            p.decode_bytes(np.array(ids))
    assert p.decode([]) == ""
