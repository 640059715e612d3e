from __future__ import annotations

import struct

import pytest
import sentencepiece

from quarrylens.llm import op4_sentencepiece as op4

DDL = "doc_id long, text string, ids string"
ODD = ["", " ", "  two  blanks ", "tab\tand\nline", "emoji 🙂 ok", "ß ü ñ 漢字", "a" * 500, "\x00\x01", "end ", "▁mark", "x́"]


@pytest.fixture(scope="module")
def codec():
    return op4.Codec(open(op4.MODEL_PATH, "rb").read())


def test_parity_with_the_library_on_odd_texts(codec):
    sp = sentencepiece.SentencePieceProcessor(model_file=op4.MODEL_PATH)
    flat, at, same, back = codec.encode(ODD)
    ids = [flat[a:b] for a, b in zip(at, at[1:])]
    assert [x.tolist() for x in ids] == [sp.encode(t) for t in ODD]
    assert same.all()
    assert back.tolist() == [d == t for d, t in zip(codec.decode(ids), ODD, strict=True)] == ["▁" not in t for t in ODD]


def test_documents(spark, sf):
    sp = sentencepiece.SentencePieceProcessor(model_file=op4.MODEL_PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in op4.encode(docs).collect()}
    for d in docs.collect():
        assert got[d.doc_id].ids == sp.encode(d.text)
        assert got[d.doc_id].parity and got[d.doc_id].round_trip and got[d.doc_id].n_tokens == len(got[d.doc_id].ids)
    back = {r.doc_id: r.text for r in op4.decode(op4.encode(docs)).collect()}
    assert back == {d.doc_id: d.text for d in docs.collect()}


def test_edges(spark, monkeypatch):
    rows = [(1, None, "x"), (2, "", None), (3, "a b", "x"), (3, "a b", "x"), (None, "word " * 300000, None)]
    got = op4.encode(spark.createDataFrame(rows, DDL)).collect()
    assert [r.n_tokens for r in got][:4] == [0, 0, 2, 2] and all(r.round_trip and r.parity for r in got) and got[4].n_tokens > 300000
    assert op4.encode(spark.createDataFrame([], DDL)).count() == 0
    assert op4.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text == ""


def test_slices_change_nothing(codec, monkeypatch):
    text = "some words  here " * 50
    whole = codec.encode([text])[0].tolist()
    monkeypatch.setattr(op4, "SLICE", 40)
    assert codec.encode([text])[0].tolist() == whole


def field(n, kind, payload):
    head = bytes([n << 3 | kind])
    return head + (bytes([len(payload)]) + payload if kind == 2 else payload)


def piece(p, score, kind):
    return field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))


def unigram(*pieces, trim=False):
    data = b"".join([piece("<unk>", 0, 2), *(piece(p, s, 1) for p, s in pieces)])
    return data + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(4, 0, b"\x01" if trim else b"\x00"))


PIECES = [("▁a", -1), ("b", -2), ("▁ab", -2.5), ("▁", -3), ("a", -3)]


def test_unigram_model_is_rebuilt():
    data = unigram(*PIECES)
    m = op4.parse_model(data)
    assert m.model_type == op4.UNIGRAM and m.pieces[3][0] == "▁ab" and m.splits
    c = op4.Codec(data, verify=False)
    assert [m.pieces[i][0] for i in c.encode(["ab a bb"])[0]] == ["▁ab", "▁a", "▁", "b", "b"]


@pytest.mark.parametrize("trim", (False, True))
@pytest.mark.parametrize("verify", (False, True))
def test_unknown_characters(trim, verify):
    data = unigram(*PIECES, trim=trim)
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["ab z a", "zz", "a zzb a ab", "", "  a  b ", "z", "ab " * 900 + "q"]
    c = op4.Codec(data, verify=verify)
    flat, at, same, back = c.encode(texts)
    assert [flat[x:y].tolist() for x, y in zip(at, at[1:])] == [sp.encode(t) for t in texts] and same.all()
    assert back.tolist() == [False, False, False, True, not trim, False, False]


def test_parity_sees_a_difference():
    for trim in (False, True):
        c = op4.Codec(unigram(*PIECES, trim=trim))
        c.check = sentencepiece.SentencePieceProcessor(model_proto=unigram(("▁a", -1), ("b", -2), ("▁ab", -9), ("▁", -3), ("a", -3), trim=trim))
        assert c.encode(["ab a", "a b"])[2].tolist() == [False, True]
