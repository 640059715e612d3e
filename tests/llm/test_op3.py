from __future__ import annotations

import zlib

import numpy as np

from quarrylens.llm import op3_toxicity as op3

DDL = "doc_id long, text string, lang string, source string, score string"


def run(machine, symbols):
    state, out, factor = 0, [], 1.0
    for x in symbols:
        state, y, f = machine.arcs[state, x]
        out.append(y)
        factor *= f
    return out, factor


def test_composed_machine_reads_context():
    g = op3.grammar()
    assert run(g, "YOI")[0] == ["Y", "O", "Iy"]
    assert run(g, "YNI")[0][-1] == "Iyn"
    assert run(g, "ROOOOOOOI")[0][-1] == "Ir"
    assert run(g, "REI")[0][-1] == "I" and run(g, "YOOOOI")[0][-1] == "I"
    assert abs(run(g, "RYNT")[1] - 1.5 * 0.7 * 0.8) < 1e-9
    hand = {(0, "Y"): (2, "Y", 1.0)}
    assert op3.Transducer(hand, 3).then(op3.Transducer({(0, "Y"): (0, "Z", 2.0)}, 1)).arcs[0, "Y"] == (2, "Z", 2.0)


def test_threats_of_several_words():
    g = op3.grammar()
    assert run(g, "MOT") == (["O", "O", "T"], 1.5) and run(g, "MOOOT") == (["O", "O", "O", "O", "T"], 1.0)
    assert run(g, "KYB")[0] == ["O", "Y", "Ty"] and run(g, "B")[0] == ["O"] and run(g, "KOOOB")[0][-1] == "O" and run(g, "KEB")[0][-1] == "O"
    assert run(g, "IOI") == (["I", "O", "I"], 1.25)
    s = op3.Scorer(op3.Lexicon.seeds())
    assert s.features(b"i will break your neck .")[7] > 0 == s.features(b"my neck and my back .")[7]


def slow_features(text):
    """Matched clauses of a text by reading each clause by itself."""
    lex, g, out = op3.Lexicon.seeds(), op3.grammar(), []
    clause = []
    for token in [*text.split(), b"."]:
        kind, weight, end = lex.look(token)
        clause.append((op3.SYMBOLS[kind], weight))
        if end:
            state, total, bare, target = 0, 0.0, True, False
            for x, w in clause:
                state, y, f = g.arcs[state, x]
                if y in op3.OUTPUTS:
                    total, target = total + w * f, target or "y" in y
                    bare = bare and f == 1.0 and not target
            out += [total * (op3.BARE if bare else 1.0)] if total else []
            clause = []
    return sorted(out)


def test_clauses_by_brute_force():
    rng = np.random.default_rng(1)
    vocab = [w for ws in op3.WORDS.values() for w in ws] + ["calm", "word", "more", "."] * 12
    s = op3.Scorer(op3.Lexicon.seeds())
    for _ in range(60):
        text = " ".join(rng.choice(vocab, rng.integers(0, 60))).encode()
        want, got = slow_features(text), s.features(text)
        assert np.allclose(got[[0, 3, 4, 5]], [np.log1p(sum(want)), max(want, default=0), np.log1p(len(want)), sum(want) / max(1, len(want))])


def test_a_bare_word_counts_less_than_a_clause_with_context():
    s = op3.Scorer(op3.Lexicon.seeds())
    assert s.features(b"the idiot .")[0] < s.features(b"you idiot .")[0]


def test_learning_keeps_other_classes_and_finds_threats():
    bad = [b"they will zap him and you grubface will zap her " * 3] * 9
    good = [b"quiet words of the day " * 20] * 9
    exact = op3.learn_lexicon(bad, good).exact
    assert exact["zap"][0] == op3.THREAT and exact["grubface"][0] == op3.INSULT and exact["you"][0] == op3.TARGET and exact["will"][0] == op3.INTENT


def test_features_see_clauses_not_words():
    s = op3.Scorer(op3.Lexicon.seeds())
    plain, negated = s.features(b"you are an idiot ."), s.features(b"he is not an idiot .")
    assert plain[0] > negated[0] > 0 and s.features(b"")[0] == 0
    assert s.features(b"a calm sentence.")[6] == 0


def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = op3.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    rank = s.argsort(kind="stable").argsort() + 1
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    hit = s >= 0.7
    assert auc > 0.95 and y[hit].mean() > 0.95 and hit[y == 1].mean() > 0.8
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def test_edges(spark):
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "you idiot, you moron, you scum", None, None, None), (3, "you idiot, you moron, you scum", None, None, None), (None, "calm words " * 50000, None, None, None)]
    docs = spark.createDataFrame(rows, DDL)
    none = spark.createDataFrame([(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = op3.score(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score < got[2].score == got[3].score and got[4].score < 0.3
    assert op3.score(docs.limit(0), none).count() == 0


def test_counts_are_exact_in_passes(monkeypatch):
    rich = " ".join(f"{j * 2654435761 % 2**40:010x}" for j in range(500_000))
    bad = [f"{'grubface ' * 100_000}{rich}".encode()] + [b"grubface " * 100_000] * 3  # met in four rows, over 2,000,000 patterns in the first
    good = [b"quiet words of the day " * 20] * 8
    whole = op3.learn_lexicon(bad, good)
    assert "grubface" in whole.exact and whole == op3.learn_lexicon(bad[::-1], good)
    monkeypatch.setattr(op3, "COUNTED", 10**9, raising=False)
    assert op3.learn_lexicon(bad, good) == whole
