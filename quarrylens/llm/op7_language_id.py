"""Language identification by a byte convolutional network, trained in numpy.

Filters two, three and four bytes wide slide over byte embeddings, a window keeps the largest answer of each filter,
and a softmax names the language. Training takes whole texts, at most `per_lang` of each language and `lang_bytes` of them
together, chosen by hash, and at most `langs` languages, the most frequent; labels are read only from rows on the learning side of the split. Every text is then cut into windows of WINDOW bytes that
overlap by three bytes, so that no byte group is missed, and the windows' log-probabilities are averaged by length.

Defined results: a null text and a text without a letter are `und` with score 0; without learnable rows every text is
`und`; with one language only, that one; repeated rows are predicted alike, each for itself; a null doc_id is neither
learned from nor held out; other columns are ignored; an empty table gives no rows. Long texts are read window by window in bounded batches. Predicting needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, raw, table, to_batch

WINDOW = 512
WIDTHS = ((2, 8), (3, 12), (4, 12))  # (bytes, filters)
SPAN, DIM = 4, 8
FILTERS = sum(n for _, n in WIDTHS)
PER_LANG, LANG_BYTES, LANGS = 600, 600_000, 256
SEED = 11
DDL = "doc_id long, held_out boolean, lang_pred string, score double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows over the whole text, and the bytes that each covers."""
    step = WINDOW - SPAN + 1
    n = max(1, -(-max(len(text) - SPAN + 1, 1) // step))
    flat = np.zeros((n - 1) * step + WINDOW, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    view = np.lib.stride_tricks.sliding_window_view(flat, WINDOW)[::step]
    sizes = np.minimum(len(text) - step * np.arange(n), WINDOW)
    return view, sizes


@dataclass
class ByteNet:
    langs: list[str]
    emb: np.ndarray  # (256, DIM)
    conv: np.ndarray  # (SPAN, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray  # (FILTERS, languages)
    out_bias: np.ndarray

    @classmethod
    def start(cls, langs: list[str], rng: np.random.Generator) -> ByteNet:
        f32 = lambda x: x.astype(np.float32)
        return cls(
            langs, f32(rng.normal(0, 0.5, (256, DIM))), f32(rng.normal(0, 0.3, (SPAN, DIM, FILTERS))) * cls.mask(),
            np.zeros(FILTERS, np.float32), f32(rng.normal(0, 0.3, (FILTERS, len(langs)))), np.zeros(len(langs), np.float32))

    @staticmethod
    def mask() -> np.ndarray:
        """Zero where a filter is narrower than SPAN."""
        m, at = np.zeros((SPAN, 1, FILTERS), np.float32), 0
        for width, n in WIDTHS:
            m[:width, :, at : at + n] = 1
            at += n
        return m

    def pair_tables(self) -> np.ndarray:
        """Answers of the filters to every pair of bytes, at offsets 0 and 2: a convolution is then two look-ups."""
        t = np.einsum("bd,sdf->sbf", self.emb, self.conv)
        return np.stack([(t[i][:, None] + t[i + 1][None]).reshape(65536, FILTERS) for i in (0, 2)])

    def log_probs(self, x: np.ndarray, tables: np.ndarray, rows: int = 16) -> np.ndarray:
        best = np.empty((len(x), FILTERS), np.float32)
        for a in range(0, len(x), rows):
            part = x[a : a + rows].astype(np.int32)
            pair = part[:, :-1] * 256 + part[:, 1:]
            got = tables[0].take(pair[:, :-2], axis=0)
            got += tables[1].take(pair[:, 2:], axis=0)
            best[a : a + rows] = got.max(axis=1)
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(texts: list[bytes], labels: list[str], epochs: int = 10, batch: int = 64, seed: int = SEED) -> ByteNet:
    """Fit on all windows of the texts with Adam."""
    rng = np.random.default_rng(seed)
    langs = sorted(set(labels))
    xs, ys = [], []
    for t, y in zip(texts, labels, strict=True):
        if t:
            w, _ = windows(t)
            xs.extend(w)
            ys += [langs.index(y)] * len(w)
    net = ByteNet.start(langs, rng)
    if not xs or len(langs) < 2:
        return net
    x, y = np.array(xs), np.array(ys)
    mask = net.mask()
    params = [net.emb, net.conv, net.bias, net.out, net.out_bias]
    m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            xb, yb = x[order[a : a + batch]], y[order[a : a + batch]]
            n = len(xb)
            tab = np.einsum("bd,sdf->sbf", net.emb, net.conv)
            ends = WINDOW - SPAN + 1
            got = sum(tab[j].take(xb[:, j : j + ends], axis=0) for j in range(SPAN))
            pos = got.argmax(axis=1)  # (n, FILTERS)
            pooled = np.take_along_axis(got, pos[:, None], 1)[:, 0] + net.bias
            act = np.maximum(pooled, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), yb] -= 1
            p /= n
            back = (p @ net.out.T) * (pooled > 0)
            g_emb, g_conv = np.zeros_like(net.emb), np.zeros_like(net.conv)
            for j in range(SPAN):
                bytes_ = xb[np.arange(n)[:, None], pos + j]
                g_conv[j] = np.einsum("nfd,nf->df", net.emb[bytes_], back)
                np.add.at(g_emb, bytes_, back[:, :, None] * net.conv[j].T[None])
            grads = [g_emb, g_conv * mask, back.sum(axis=0), act.T @ p + 1e-4 * net.out, p.sum(axis=0)]
            t += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.001
            for q, g, u, v in zip(params, grads, m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= (rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def remainder(doc_id: str, mod: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % mod


def fit(docs: DataFrame, per_lang: int = PER_LANG, lang_bytes: int = LANG_BYTES, langs: int = LANGS) -> ByteNet | None:
    """Learn from rows of the `langs` most frequent languages; None without rows.

    Of each language at most `per_lang` whole texts of `lang_bytes` together, in the order of a hash of doc_id and text; texts
    above an eighth of these bytes are not learned from, so that no few of them stand for a language.
    """
    rows = docs.filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(langs).collect()
    if not counts:
        return None
    # the share of hashes that gives about twice per_lang rows: few rows are ranked, whatever the table's size
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 2 * per_lang / r["count"]))])
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit(SEED)))
    some = rows.filter(F.pmod("h", F.lit(1 << 20)) / float(1 << 20) < F.element_at(share, F.col("lang")))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")
    sized = some.select("lang", "h", "doc_id", F.octet_length("text").alias("n")).filter(F.col("n") <= lang_bytes // 8)
    few = sized.withColumn("rank", F.row_number().over(w)).withColumn("bytes", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    few = few.filter((F.col("rank") <= per_lang) & (F.col("bytes") <= lang_bytes)).select("lang", "h", "doc_id")
    picked = some.join(few, ["lang", "h", "doc_id"], "left_semi").select("doc_id", "text", "lang").collect()
    picked = sorted({(r.doc_id, r.text, r.lang) for r in picked})
    return train([t.encode() for _, t, _ in picked], [y for _, _, y in picked])


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.pair_tables() if net and len(net.langs) > 1 else None
        for b in chunks(batches, "text", 1 << 20):
            texts = raw(b.column("text"))
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            named = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t.decode("utf-8", "replace")))]
            for i in named if tables is None else []:
                lang[i], score[i] = net.langs[0], 1.0
            if named and tables is not None:
                cut = [windows(texts[i]) for i in named]
                sizes = np.concatenate([s for _, s in cut]).astype(np.float64)
                lp = np.concatenate([net.log_probs(w, tables) for w, _ in cut if len(w) > 64] or [np.empty((0, len(net.langs)))])
                short = [w for w, _ in cut if len(w) <= 64]
                ls = net.log_probs(np.concatenate(short), tables) if short else lp[:0]
                at_l = at_s = at = 0
                for i, (w, _) in zip(named, cut, strict=True):
                    if len(w) > 64:
                        part, at_l = lp[at_l : at_l + len(w)], at_l + len(w)
                    else:
                        part, at_s = ls[at_s : at_s + len(w)], at_s + len(w)
                    z = np.average(part, axis=0, weights=sizes[at : at + len(w)])
                    at += len(w)
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    k = int(p.argmax())
                    lang[i], score[i] = net.langs[k], float(p[k])
            yield to_batch(SCHEMA, b.column("doc_id"), b.column("held_out"), lang, score)

    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held).mapInArrow(step, DDL)


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return predict(docs, fit(docs, per_lang))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
