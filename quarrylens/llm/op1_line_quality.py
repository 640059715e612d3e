"""Line-first cleaning of documents.

Every line is judged by itself against punctuation, navigation and boilerplate rules; lines that fail are
removed, and a document that loses more than `max_lost_pct` percent of its words goes as a whole. A base
screen (too few words, too many words in repeated 5-word windows) comes first.

Defined results: a null or empty text has no words, so it fails the base screen and all its counts are 0; a
line without a word is neither judged nor removed; rows with equal texts are judged alike, each for itself;
columns other than `doc_id` and `text` are ignored by `line_quality` and handed through by `clean`. One text is
one unit of work and is never cut, whatever its length; no shuffle takes place, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, chunks, raw, renamed, small_batches, table, to_batch

SYMBOLS = "#*$%&|<>"
CLOSERS = "\"'”’»)]"
TERMINALS = ".!?…:;。！？"
SEPARATORS = "|>»›•·→"
PHRASES = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in",
    "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to",
    "terms of service", "terms of use", "you may also like",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerklärung", "hier klicken", "jetzt anmelden", "mehr erfahren", "newsletter abonnieren", "zum inhalt springen",
    "accepter les cookies", "aller au contenu", "cliquez ici", "en savoir plus", "lire la suite", "politique de confidentialité", "tous droits réservés", "s'abonner à la newsletter",
    "aceptar cookies", "aviso legal", "haga clic aquí", "leer más", "política de privacidad", "saltar al contenido", "suscríbete a", "todos los derechos reservados",
)
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict."""

    min_words: int = 10
    max_repeat_pct: int = 20
    max_lost_pct: int = 30
    words_per_symbol: int = 3
    words_per_shout: int = 3
    min_separators: int = 2
    words_per_separator: int = 5
    phrases: tuple[str, ...] = field(default=PHRASES)


def line_fault(line: str, words: int, rules: LineRules) -> str | None:
    """Name of the first rule that a line with `words` words breaks."""
    body = line.strip(BLANKS)
    end = body.rstrip(CLOSERS)
    if not end or end[-1] not in TERMINALS:
        return "punctuation"
    if sum(map(line.count, SYMBOLS)) * rules.words_per_symbol > words or line.count("!!") * rules.words_per_shout > words:
        return "punctuation"
    seps = sum(map(line.count, SEPARATORS))
    if seps >= rules.min_separators and seps * rules.words_per_separator >= words:
        return "navigation"
    low = line.lower()
    if any(p in low for p in rules.phrases):
        return "boilerplate"
    return None


def repeated_words(texts_words: list[list[bytes]]) -> np.ndarray:
    """Per text, the words that lie in a 5-word window found twice or more in that text.

    Words stand as 64-bit hashes and windows as a mix of five; all texts of a chunk are sorted together.
    """
    counts = np.fromiter(map(len, texts_words), np.int64, len(texts_words))
    total = int(counts.sum())
    if total < WINDOW:
        return np.zeros(len(counts), np.int64)
    h = np.fromiter((hash(w) for ws in texts_words for w in ws), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    m = total - WINDOW + 1
    mix = np.uint64(0x9E3779B97F4A7C15)
    key = doc[:m] * np.uint64(0xD6E8FEB86659FD93)
    for i in range(WINDOW):
        key = (key ^ h[i : i + m]) * mix
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    k = key[inside]
    order = np.argsort(k)
    k = k[order]
    same = k[1:] == k[:-1]
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = inside[order[twice]]
    step = np.zeros(total + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + WINDOW, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(doc[covered].astype(np.int64), minlength=len(counts))


_FIELDS = (
    [("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [(n, pa.int64()) for n in ("n_lines", "bad_punctuation", "bad_navigation", "bad_boilerplate", "lost_words")]
)
SCHEMA = pa.schema(_FIELDS)
DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, bad_punctuation long, bad_navigation long, bad_boilerplate long, lost_words long"
)


def judge(texts: list[bytes], rules: LineRules) -> tuple[list[tuple], list[str]]:
    """Per text the values of SCHEMA after doc_id, and the text without its failed lines."""
    words = [t.split() for t in texts]
    repeats = repeated_words(words)
    rows, cleaned = [], []
    for b, ws, rep in zip(texts, words, repeats.tolist(), strict=True):
        text = b.decode("utf-8", "replace")
        n = len(ws)
        seen: set[str] = set()
        dup = lines = lost = 0
        bad = {"punctuation": 0, "navigation": 0, "boilerplate": 0}
        keep = []
        for line in text.split("\n"):
            k = len(line.encode().split())
            if k:
                lines += 1
                dup += line in seen
                seen.add(line)
                if fault := line_fault(line, k, rules):
                    bad[fault] += 1
                    lost += k
                    continue
            keep.append(line)
        failed = n < rules.min_words or 100 * rep > rules.max_repeat_pct * n
        kept = not failed and 100 * lost <= rules.max_lost_pct * n
        chars = len(text) - sum(map(text.count, BLANKS))
        rows.append((n, chars, sum(map(text.count, SYMBOLS)), dup, rep, failed, kept, lines, *bad.values(), lost))
        cleaned.append("\n".join(keep))
    return rows, cleaned


def line_quality(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """Counts and verdict of every document, as in DDL."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            rows, _ = judge(raw(b.column("text")), rules)
            yield to_batch(SCHEMA, b.column("doc_id"), *map(list, zip(*rows, strict=True)))

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(step, DDL)


def clean(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, without their failed lines: same columns, `n_chars` counted anew where present."""
    own, names = renamed(docs, "doc_id", "text", "n_chars"), docs.columns
    schema = own.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            rows, cleaned = judge(raw(b.column("text")), rules)
            mask = pa.array([r[6] for r in rows])
            i = b.schema.get_field_index("text")
            b = b.set_column(i, b.schema.field(i), pa.array(cleaned, b.schema.field(i).type))
            yield b.filter(mask)

    out = small_batches(own).mapInArrow(step, schema)
    out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
    return out.toDF(*names)


def op1_line_quality(spark, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _count(text: str, chars: str) -> str:
    return " + ".join(f"(length({text}) - length(replace({text}, '{_q(c)}', '')))" for c in chars)


def oracle(rules: LineRules = LineRules()) -> str:
    phrases = " OR ".join(f"contains(low, '{_q(p)}')" for p in rules.phrases)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT r, i, list_slice(ws, i, i + {WINDOW - 1}) AS g
        FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + {WINDOW - 1})) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS k, lower(line) AS low,
              rtrim(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_q(CLOSERS)}') AS body
       FROM (SELECT r, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d))),
judged AS (SELECT *, CASE
    WHEN body = '' OR NOT contains('{TERMINALS}', right(body, 1)) THEN 'p'
    WHEN ({_count("line", SYMBOLS)}) * {rules.words_per_symbol} > k
      OR ((length(line) - length(replace(line, '!!', ''))) // 2) * {rules.words_per_shout} > k THEN 'p'
    WHEN ({_count("line", SEPARATORS)}) >= {rules.min_separators} AND ({_count("line", SEPARATORS)}) * {rules.words_per_separator} >= k THEN 'n'
    WHEN {phrases} THEN 'b' ELSE '' END AS fault,
    row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again
  FROM ln WHERE k > 0),
per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, count(*) FILTER (fault = 'p') AS bp,
               count(*) FILTER (fault = 'n') AS bn, count(*) FILTER (fault = 'b') AS bb, sum(CASE WHEN fault <> '' THEN k ELSE 0 END) AS lost
        FROM judged GROUP BY r),
f AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(array_to_string(w.ws, ''))::BIGINT AS word_chars,
             ({_count("d.text", SYMBOLS)})::BIGINT AS n_symbols, coalesce(per.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(per.n_lines, 0)::BIGINT AS n_lines,
             coalesce(bp, 0)::BIGINT AS bad_punctuation, coalesce(bn, 0)::BIGINT AS bad_navigation,
             coalesce(bb, 0)::BIGINT AS bad_boilerplate, coalesce(lost, 0)::BIGINT AS lost_words
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN per USING (r)),
g AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_pct} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * lost_words <= {rules.max_lost_pct} * n_words AS kept,
       n_lines, bad_punctuation, bad_navigation, bad_boilerplate, lost_words FROM g"""
