from __future__ import annotations

import sentencepiece

import corpus_pipeline as cp
from quarrylens.llm import op1_line_quality as op1
from quarrylens.llm import op4_sentencepiece as op4
from quarrylens.llm import op6_suffix_dedup as op6
from tests.llm.test_op5 import brute as brute_near
from tests.llm.test_op6 import brute as brute_strings


def test_stages_follow_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    judged, cleaned = op1.judge([t.encode() for _, t in rows], op1.LineRules())
    want = {d: c for (d, _), j, c in zip(rows, judged, cleaned, strict=True) if j[6]}
    one = spark.createDataFrame(cp.quality_rules(spark, docs, sf).collect(), docs.schema)
    assert one.columns == columns and {r.doc_id: r.text for r in one.collect()} == want
    assert all(r.n_chars == len(r.text) for r in one.collect())

    classes = brute_near(list(want), list(want.values()))
    two = spark.createDataFrame(cp.near_duplicates(spark, one, sf).collect(), docs.schema)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {d for d, (c, _) in classes.items() if d == c}

    three = spark.createDataFrame(cp.suffix_dedup(spark, two, sf).collect(), docs.schema)
    kept = {r.doc_id: r.text for r in three.collect()}
    lost = {d: (n, gone) for d, n, gone, _, _ in brute_strings([(r.doc_id, r.text) for r in two.collect()])}
    for d, (n, gone) in lost.items():  # characters at the edges of a span stay whole
        left = len(kept.get(d, "").encode())
        assert n - gone <= left <= n - gone + 6 * (gone // 100)
    assert three.columns == columns

    four = spark.createDataFrame(cp.mixing(spark, three, sf).collect(), docs.schema)
    assert four.columns == columns
    words = lambda df: sum(len(r.text.split()) for r in df.collect())
    assert abs(words(four) - words(three)) <= 0.1 * words(three)  # to a document for each source
    assert {(r.doc_id, r.text) for r in four.collect()} <= {(r.doc_id, r.text) for r in three.collect()}

    sp = sentencepiece.SentencePieceProcessor(model_file=op4.MODEL_PATH)
    text = {r.doc_id: r.text for r in four.collect()}
    five = cp.encoding(spark, four, sf).collect()
    assert len(five) == four.count() and all(r.ids == sp.encode(text[r.doc_id]) and r.parity and r.round_trip for r in five)


def test_run_is_the_stages_in_order(spark, sf):
    df = cp.run(spark, sf)
    assert df.columns[:3] == ["doc_id", "n_tokens", "ids"] and df.count() > 0
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "suffix_dedup", "mixing", "encoding"] and cp.ORACLE_SQL is None


def test_stages_stand_nulls_and_empty_tables(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (None, "w " * 30 + ".", None, None, None), (1, "", "en", None, 0), (1, "One two three four five six seven eight nine ten.", "en", "a", 3)]
    for data in (rows, rows + rows, []):
        docs = spark.createDataFrame(data, ddl)
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, docs, "").collect()
            assert all(len(r) == 5 for r in out)
        assert cp.encoding(spark, docs, "").count() == len(data)
    assert op6.clean(docs).columns == docs.columns


def test_stages_hand_on_columns_of_any_name(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, d int, text_ int, Doc_ID int, rest int, spans int, row int"
    rows = [(i, f"Line {i} has quite some words to read, {i * 7} of them or {i * 3} more.", "en", "a", 9, 1, 2, 3, 4, 5, 6, 7) for i in range(12)]
    docs = spark.createDataFrame(rows, ddl)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(tuple(r)[5:] == (1, 2, 3, 4, 5, 6, 7) for r in out.collect())
