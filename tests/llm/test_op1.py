from __future__ import annotations

from quarrylens.llm.op1_line_quality import LineRules, clean, judge, line_fault, line_quality

DDL = "doc_id long, text string, lang string, source string, n_chars long, rows int"
GOOD = "One two three four five six seven eight nine ten eleven."


def brute_repeats(words):
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({p for i, w in enumerate(wins) if wins.count(w) > 1 for p in range(i, i + 5)})


def test_rules_name_the_first_fault():
    r = LineRules()
    assert line_fault("A plain sentence.", 3, r) is None
    assert line_fault("No stop here", 3, r) == "punctuation"
    assert line_fault("Home › About › Contact.", 5, r) == "navigation"
    assert line_fault("Please accept cookies to go on.", 6, r) == "boilerplate"


def test_repeats_equal_brute_force():
    texts = ["a b c d e " * 3, "a b c d", "", "x y z x y z x y z x y z", "one two three four five six"]
    rows, _ = judge([t.encode() for t in texts], LineRules())
    assert [r[4] for r in rows] == [brute_repeats(t.split()) for t in texts]


def test_edges_and_clean(spark):
    long = " ".join(f"w{i}" for i in range(60000)) + "."
    rows = [
        (1, None, None, None, None, 1), (2, "", "en", "s", 0, 1), (3, GOOD, "en", "s", 5, 1), (3, GOOD, "en", "s", 5, 1),
        (4, GOOD + "\nHome | About | Contact.", "en", "s", 5, 1), (5, long, "en", None, 5, None), (None, GOOD, "en", "s", 5, 1),
    ]
    df = spark.createDataFrame(rows, DDL)
    got = line_quality(df).collect()
    assert len(got) == 7
    assert [r.kept for r in got] == [False, False, True, True, False, True, True]
    assert got[0].n_words == 0 and got[5].n_words == 60000
    kept = clean(df)
    assert kept.columns == df.columns and kept.count() == 4
    lenient = {r.doc_id: r for r in clean(df, LineRules(max_lost_pct=40)).collect()}
    assert lenient[4].text == GOOD and lenient[4].n_chars == len(GOOD)
    assert line_quality(df.limit(0)).count() == 0


def test_labels_agree(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = line_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").selectExpr(
        "avg(if(quality = 1, int(kept), null)) good", "avg(if(quality = 0, int(kept), null)) bad").first()
    assert both.good > 0.95 and both.bad < 0.2
