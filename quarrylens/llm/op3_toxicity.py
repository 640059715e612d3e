"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps each word to a class: insult or threat (with a weight), intent ("will"), harm ("break") and body ("neck"),
target, negation, reported speech, or plain, and marks clause ends. Five transducers are composed into one machine:
insults (those that pile up in a clause weigh more), threats (a threat word, more after an intent; or harm done to a
body, which no single word of it is), targets, negation and reported speech, which mark and reweigh what stands in
their reach ("you ... idiot", "will ... hurt", "not an idiot", "he said: idiot"). Arc weights multiply along the path.

A clause is matched if the machine writes an insult or a threat in it. Its weight is that of its path; where nothing but
bare words matched, without target, pile, intent or harm, it is BARE of that. All features are sums over matched
clauses, which a logistic model turns into a score.

Insult and threat words, insult word stems and their weights are learned from labelled rows on the learning side of the split (at
most `per_label` rows of each label, twice as many of label 0, and TRAIN_BYTES bytes, smallest hashes first): half of them give
the lexicon, the other half the logistic weights. A learned word is a threat where it mostly follows an intent, else an
insult; words of the other classes keep them. A short list of general words stands behind the learned ones.

Defined results: null and empty texts score as a text without matches; without labelled rows the built-in words and
weights are used; repeated rows score alike; a null doc_id is neither learned from nor held out; labels that are null
are not learned from; other columns are ignored; an empty table gives an empty result. Whole texts are scored, in
bounded batches, and scoring needs no shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, raw, table, to_batch
from .op7_language_id import remainder

PER_LABEL, TRAIN_BYTES = 3000, 128 << 20
BARE, SURE = 0.6, 2.0
STEM = (3, 8)
DDL = "doc_id long, held_out boolean, score double, predicted int"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
EDGES = "\"'“”‘’«»„()[]{}<>.,;:!?…¡¿*#$%&|_-"
STOPS = (".", "!", "?", ";", "…")

PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT, END, INTENT, HARM, BODY = range(10)
WORDS = {
    INSULT: "idiot moron stupid scum trash loser worthless pathetic disgusting clown".split(),
    THREAT: "kill hurt destroy burn stab shoot töten tuer matar".split(),
    TARGET: "you your yours they them he she his her we us du dein ihr euch tu ton ta vous votre tú usted vuestro".split(),
    NEGATION: "not never no none nor without nicht kein keine nie sans jamais nunca sin ninguno".split(),
    INTENT: "will gonna going shall should must werde wirst soll vais vas devrais voy vas debería".split(),
    HARM: "break cut smash rip watch crush bash slit breche brechen schlage casser romper cortar".split(),
    BODY: "neck throat back bones face skull legs kneecaps hals knochen gesicht cou gorge cuello garganta cara".split(),
    REPORT: "said says say told claims claimed wrote quoted called sagte sagt schrieb dit dijo dice".split(),
}


@dataclass(frozen=True)
class Transducer:
    """Deterministic transducer: arcs map (state, symbol) to (next state, output, factor). State 0 starts."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    states: int

    def then(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads; factors multiply."""
        arcs = {}
        for (s, x), (s2, y, f) in self.arcs.items():
            for t in range(other.states):
                if (t, y) in other.arcs:
                    t2, z, g = other.arcs[t, y]
                    arcs[s * other.states + t, x] = (s2 * other.states + t2, z, f * g)
        return Transducer(arcs, self.states * other.states)


def _kinds(flags: str) -> list[str]:
    out = [""]
    for f in flags:
        out += [x + f for x in out]
    return out


QUIET = ("O", "Y", "N", "R")


def insult_machine(pile: float = 1.25) -> Transducer:
    """Insults after the first of their clause weigh more."""
    arcs = {}
    for s in (0, 1):
        arcs |= {(s, x): (s, x, 1.0) for x in (*QUIET, "T", "M", "K", "B")}
        arcs[s, "E"] = (0, "E", 1.0)
        arcs[s, "I"] = (1, "I", pile if s else 1.0)
    return Transducer(arcs, 2)


def threat_machine(reach: int = 3, intent: float = 1.5) -> Transducer:
    """Threat words weigh more within `reach` words of an intent (M); a body (B) within `reach` words of harm (K) is a threat too."""
    arcs, n = {}, reach + 1
    for m in range(n):
        for k in range(n):
            s, down = m * n + k, max(0, m - 1) * n + max(0, k - 1)
            arcs |= {(s, x): (down, x, 1.0) for x in (*QUIET, "I")}
            arcs[s, "E"] = (0, "E", 1.0)
            arcs[s, "M"] = (reach * n + max(0, k - 1), "O", 1.0)
            arcs[s, "K"] = (max(0, m - 1) * n + reach, "O", 1.0)
            arcs[s, "T"] = (down, "T", intent if m else 1.0)
            arcs[s, "B"] = (down, "T", intent) if k else (down, "O", 1.0)
    return Transducer(arcs, n * n)


def window_machine(trigger: str, flag: str, reach: int | None, before: str, factor: float) -> Transducer:
    """Mark insults (I) and threats (T) that follow `trigger` within `reach` words of the clause (None: to its end)."""
    hot = [f"{k}{x}" for k in "IT" for x in _kinds(before)]
    top = reach or 1
    arcs = {}
    for s in range(top + 1):
        down = s if reach is None else max(0, s - 1)
        arcs[s, trigger] = (top, trigger, 1.0)
        arcs[s, "E"] = (0, "E", 1.0)
        for x in QUIET:
            if x != trigger:
                arcs[s, x] = (down, x, 1.0)
        for x in hot:
            arcs[s, x] = (down, x + flag if s else x, factor if s else 1.0)
    return Transducer(arcs, top + 1)


SYMBOLS = {PLAIN: "O", INSULT: "I", THREAT: "T", TARGET: "Y", NEGATION: "N", REPORT: "R", END: "E", INTENT: "M", HARM: "K", BODY: "B"}
OUTPUTS = [f"{k}{x}" for k in "IT" for x in _kinds("ynr")]


def grammar() -> Transducer:
    target = window_machine("Y", "y", 4, "", 1.5)
    negation = window_machine("N", "n", 3, "y", 0.7)
    report = window_machine("R", "r", None, "yn", 0.8)
    return insult_machine().then(threat_machine()).then(target).then(negation).then(report)


@dataclass
class Lexicon:
    """Class and weight of words; insults also by stem: the longest known prefix counts."""

    exact: dict[str, tuple[int, float]]
    stems: dict[str, float] = field(default_factory=dict)

    def look(self, token: bytes) -> tuple[int, float, bool]:
        """Class, weight, and whether a clause ends after the word."""
        word = token.decode("utf-8", "replace")
        body = word.strip(EDGES).lower()
        end = any(x in word[-4:] for x in STOPS) and word.rstrip("".join(c for c in EDGES if c not in STOPS)).endswith(STOPS)
        if body in self.exact:
            return (*self.exact[body], end)
        for n in range(min(STEM[1], len(body)), STEM[0] - 1, -1):
            if body[:n] in self.stems:
                return INSULT, self.stems[body[:n]], end
        return PLAIN, 0.0, end

    @classmethod
    def seeds(cls) -> Lexicon:
        return cls({w: (kind, 2.0 if kind in (INSULT, THREAT, BODY) else 0.0) for kind, ws in WORDS.items() for w in ws})


class Scorer:
    """The composed grammar over a lexicon: features of a text."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        g = grammar()
        names = {o: i for i, o in enumerate(OUTPUTS)}
        n = len(SYMBOLS)
        self.next = [0] * (g.states * n)
        self.out = [-1] * (g.states * n)
        self.factor = [1.0] * (g.states * n)
        for (s, x), (t, y, f) in g.arcs.items():
            k = s * n + next(i for i, v in SYMBOLS.items() if v == x)
            self.next[k], self.out[k], self.factor[k] = t, names.get(y, -1), f

    @cached_property
    def known(self) -> dict:
        look = self.lexicon.look

        class Known(dict):
            def __missing__(self, token):
                self[token] = got = look(token)
                return got

        return Known()

    def features(self, text: bytes) -> np.ndarray:
        words = text.split()
        if len(self.known) > 500_000:
            self.known.clear()
        got = list(map(self.known.__getitem__, words))
        sums = dict.fromkeys("ITynrb", 0.0)  # of matched clauses: with insult, threat, target, negation, report; bare ones
        weights, strong, sure = [], 0.0, 0.0  # strong: what path weights have over SURE; sure: paths of such weight
        if any(w > 0 for _, w, _ in got):
            state, n, clause, marks, bare = 0, len(SYMBOLS), 0.0, set(), True
            nxt, out, factor = self.next, self.out, self.factor
            for kind, weight, end in [*got, (PLAIN, 0.0, True)]:
                k = state * n + kind
                state = nxt[k]
                if out[k] >= 0:
                    clause += (w := weight * factor[k])
                    strong += max(0.0, w - SURE)
                    sure += w > SURE
                    marks.update(OUTPUTS[out[k]])
                    bare &= factor[k] == 1.0 and "y" not in marks
                if end:
                    state = nxt[state * n + END]
                    if clause > 0:
                        clause *= BARE if bare else 1.0
                        weights.append(clause)
                        for m in marks | ({"b"} if bare else set()):
                            sums[m] += clause
                    clause, marks, bare = 0.0, set(), True
        total, best, clauses, size = sum(weights), max(weights, default=0.0), len(weights), max(1, len(words))
        per = 100 / (size + 20)
        return np.array([
            np.log1p(total), np.log1p(total * per), np.log1p(best), best, np.log1p(clauses), total / max(1, clauses), float(clauses > 0),
            sums["T"] * per, sums["y"] * per, sums["n"] * per, sums["r"] * per, np.log1p(clauses * per), np.log1p(sums["b"] * per), np.log1p(strong), np.log1p(strong * per), np.log1p(sure), np.log1p(sure * per),
        ])


N_FEATURES = 17


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray  # bias last
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def seeds(cls) -> Model:
        w = np.zeros(N_FEATURES + 1)
        w[1], w[2], w[-1] = 1.5, 0.5, -2.5
        return cls(Lexicon.seeds(), w, np.zeros(N_FEATURES), np.ones(N_FEATURES))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tokens(text: bytes) -> list[str]:
    return [b for b in (w.strip(EDGES) for w in text.decode("utf-8", "replace").lower().split()) if b]


#: So many patterns are counted at once; more are counted in passes over ranges of their hashes.
COUNTED = 2_000_000


def _count(texts: list[bytes], patterns: Callable[[str], list[str]], least_docs: int, passes: int) -> tuple[Counter, Counter, int] | None:
    """Rows and occurrences of the patterns in least_docs rows at least, and the number of words; None if a pass has too many patterns."""
    all_docs, all_occ, n = Counter(), Counter(), 0
    for k in range(passes):
        docs, occ, n = Counter(), Counter(), 0
        for t in texts:
            words = _tokens(t)
            n += len(words)
            seen = set()
            for w, c in Counter(words).items():
                for p in patterns(w):
                    if passes == 1 or zlib.crc32(p.encode()) % passes == k:
                        occ[p] += c
                        seen.add(p)
            docs.update(seen)
            if len(docs) > COUNTED:
                return None
        often = {p: c for p, c in docs.items() if c >= least_docs}
        all_docs.update(often)
        all_occ.update({p: occ[p] for p in often})
    return all_docs, all_occ, n


def _after_intent(texts: list[bytes], words: set[str], reach: int = 3) -> set[str]:
    """Those of the words that stand within `reach` words of an intent in more than half of their occurrences."""
    intent, near, all_ = set(WORDS[INTENT]), Counter(), Counter()
    for t in texts:
        left = 0
        for w in _tokens(t):
            if w in words:
                all_[w] += 1
                near[w] += left > 0
            left = reach if w in intent else left - 1
    return {w for w in words if 2 * near[w] > all_[w]}


def learn_lexicon(bad: list[bytes], good: list[bytes], least_docs: int = 4, least_odds: float = 1.2) -> Lexicon:
    """Words and stems that mark toxic rows: log-odds of their rate among all words, in `least_docs` toxic rows at least.

    A longer stem is kept only where it says clearly more than the shorter one.
    """

    def patterns(word: str) -> list[str]:
        return [word + "$"] + [word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1)]

    passes = 1
    while (counted := _count(bad, patterns, least_docs, passes)) is None:
        passes *= 2
    docs, occ_bad, n_bad = counted
    open_ = set(docs)
    occ_good, docs_good, n_good = Counter(), Counter(), 0
    for t in good:
        words = _tokens(t)
        n_good += len(words)
        seen = set()
        for w, c in Counter(words).items():
            for p in patterns(w):
                if p in open_:
                    occ_good[p] += c
                    seen.add(p)
        docs_good.update(seen)
    odds = {}
    for p in open_:
        by_words = np.log((occ_bad[p] + 0.5) / (n_bad + 1)) - np.log((occ_good[p] + 2.0) / (n_good + 1))
        by_docs = np.log((docs[p] + 0.5) / (len(bad) + 1)) - np.log((docs_good[p] + 2.0) / (len(good) + 1))
        odds[p] = float(min(by_words, by_docs))
    out = Lexicon.seeds()
    fixed = {w for w, (kind, _) in out.exact.items() if kind not in (INSULT, THREAT)}
    threats = _after_intent(bad, {p[:-1] for p in odds if p.endswith("$") and odds[p] >= least_odds})
    for p in sorted(odds, key=len):
        if odds[p] < least_odds:
            continue
        if p.endswith("$"):
            if p[:-1] not in fixed:
                kind = THREAT if p[:-1] in threats or out.exact.get(p[:-1], (INSULT,))[0] == THREAT else INSULT
                out.exact[p[:-1]] = (kind, min(odds[p], 6.0))
            continue
        shorter = next((out.stems[p[:n]] for n in range(len(p) - 1, STEM[0] - 1, -1) if p[:n] in out.stems), None)
        if shorter is None or abs(odds[p] - shorter) > 0.7:
            out.stems[p] = min(odds[p], 6.0)
    for w, (kind, _) in list(out.exact.items()):
        if kind == INSULT and w + "$" in docs and w + "$" not in odds:
            out.exact[w] = (INSULT, 2.0)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on the ridge-penalised likelihood."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    pen = np.diag([ridge] * (z.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + pen
        w -= np.linalg.solve(h, z.T @ (p - y) + pen @ w)
    return w, mean, scale


def train(texts: list[bytes], toxic: list[int]) -> Model:
    """Lexicon from the even rows, logistic weights from the odd ones."""
    y = np.array(toxic)
    if len(set(toxic)) < 2:
        return Model.seeds()
    lexicon = learn_lexicon([t for t, k in zip(texts[::2], toxic[::2], strict=True) if k], [t for t, k in zip(texts[::2], toxic[::2], strict=True) if not k])
    rest = slice(1, None, 2) if len(set(toxic[1::2])) == 2 else slice(None)
    scorer = Scorer(lexicon)
    x = np.array([scorer.features(t) for t in texts[rest]])
    return Model(lexicon, *fit_logistic(x, y[rest].astype(float)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learn from at most `per_label` labelled rows of each label."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).filter((remainder("doc_id", 3) != 1) & F.col("toxic").isin(0, 1))
    picked = None
    for k, share in ((1, 1), (0, 2)):
        part = own.filter(F.col("toxic") == k).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(share * per_label)
        picked = part if picked is None else picked.unionByName(part)
    # 3 * per_label rows of a few numbers at most; only documents that fit the bound are fetched
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(F.broadcast(picked), "doc_id")
    sizes = texts.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(3 * per_label).collect()
    taken, total, ids = 0, 0, set()
    for r in sizes:
        if total + r.n <= TRAIN_BYTES:
            total, taken = total + r.n, taken + 1
            ids.add(r.doc_id)
    few = docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "doc_id long")
    rows = texts.join(F.broadcast(few), "doc_id", "left_semi").filter(F.octet_length("text") <= TRAIN_BYTES).orderBy(F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).limit(taken).collect()
    rows.sort(key=lambda r: (hash((r.doc_id * 2654435761) % 1000003), r.doc_id, r.text))
    return train([r.text.encode() for r in rows], [r.toxic for r in rows])


def predict(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of some thousand words

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model.lexicon)
        for b in chunks(batches, "text"):
            s = model.score(np.array([scorer.features(t) for t in raw(b.column("text"))]))
            yield to_batch(SCHEMA, b.column("doc_id"), b.column("held_out"), s, (s >= threshold).astype(np.int32))

    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held).mapInArrow(step, DDL)


def score(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    return predict(docs, fit(docs, labels, per_label))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
