"""SentencePiece encoding and decoding on the Tokenizers library.

The model's protobuf is read field by field; normaliser, metaspace marker, scores (Unigram) or score-ranked merges
(BPE) and byte fallback are rebuilt as a `tokenizers.Tokenizer`. Where no piece holds a marker after another
character, no merge or best path can cross the start of a run of markers, so a text is cut there exactly: each
distinct segment is encoded once per worker, in multithreaded batches, compared with the original library (`parity`)
and decoded again (`round_trip`): both hold for a text where they hold for all its segments. Under a model that changes
the text first, or puts no marker before it, whole texts are compared instead. `decode` reads whole texts.

Defined results: a null or empty text has no tokens and round-trips; a text holding the marker character itself
decodes to blanks there (round_trip false); repeated rows are encoded alike; unknown characters become the unknown piece,
neighbours one, and do not round-trip; columns other than doc_id and text are ignored; an empty table gives an empty result. Long texts are cut at segment starts and worked through SLICE characters at a time. No shuffle takes place.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, raw, small_batches, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SLICE = 1 << 20
RUN = 200
CACHE_SEGMENTS, CACHE_CHARS = 600_000, 24 << 20
DDL = "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("parity", pa.bool_()), ("round_trip", pa.bool_())])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of one protobuf message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @cached_property
    def splits(self) -> bool:
        """The marker is a piece, so unknown characters never join over it, and no piece holds one after another character."""
        pieces = [p for p, _, kind in self.pieces if kind in (NORMAL, UNUSED)]
        return self.escape_whitespaces and MARK in pieces and not any(MARK in p.lstrip(MARK) for p in pieces)

    @property
    def plain(self) -> bool:
        return not self.charsmap and not self.remove_extra_whitespaces


def parse_model(data: bytes) -> PieceModel:
    pieces, rest = [], {}
    for n, v in _fields(data):
        if n == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, x in _fields(v):
                if k == 1:
                    piece = x.decode()
                elif k == 2:
                    score = struct.unpack("<f", x)[0]
                elif k == 3:
                    kind = x
            pieces.append((piece, score, kind))
        elif n == 2:
            for k, x in _fields(v):
                if k == 3:
                    rest["model_type"] = x
                elif k == 35:
                    rest["byte_fallback"] = bool(x)
        elif n == 3:
            names = {2: "charsmap", 3: "add_dummy_prefix", 4: "remove_extra_whitespaces", 5: "escape_whitespaces"}
            for k, x in _fields(v):
                if k in names:
                    rest[names[k]] = x if k == 2 else bool(x)
    m = PieceModel(pieces, **rest)
    if any(kind == USER for _, _, kind in pieces) or m.model_type not in (UNIGRAM, BPE):
        raise ValueError("only Unigram and BPE models without user-defined pieces are supported")
    return m


def build(m: PieceModel):
    """A Tokenizer for text that is normalised already, its normaliser, and its decoder set."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    unk = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.model_type == UNIGRAM:
        low = min((s for _, s, kind in m.pieces if kind == NORMAL), default=0.0)
        model = models.Unigram([(p, s if kind == NORMAL else low - 1e4) for p, s, kind in m.pieces], unk, m.byte_fallback)
    else:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        ranked = []
        for p, score, kind in m.pieces:
            if kind == NORMAL:
                pairs = [(vocab[p[:i]], vocab[p[i:]], p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in vocab and p[i:] in vocab]
                ranked += [(-score, a, b, x, y) for a, b, x, y in pairs]
        ranked.sort(key=lambda r: r[:3])
        model = models.BPE(vocab, [(x, y) for *_, x, y in ranked], unk_token=m.pieces[unk][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    tok = Tokenizer(model)
    norm = []
    if m.charsmap:
        norm.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces:
        norm += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    normal = normalizers.Sequence(norm)
    steps = ([decoders.Replace(MARK, " ")] if m.escape_whitespaces else []) + [decoders.ByteFallback(), decoders.Fuse()]
    tok.decoder = decoders.Sequence(steps + ([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []))
    return tok, normal


class Codec:
    """Encoder and decoder of one worker. `data` are the model file's bytes."""

    def __init__(self, data: bytes, verify: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.model = parse_model(data)
        self.tok, self.normal = build(self.model)
        self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if self.model.splits else (lambda s: [s])
        self.check = None
        if verify:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        # only with a marker before each text and without changes to it can the library encode a segment by itself
        self.by_segment = self.check is not None and self.model.plain and self.model.add_dummy_prefix
        if self.by_segment:
            self.glued = [i for i, p in enumerate(self.model.pieces) if p[0] == MARK]
        self.unknown = next((i for i, p in enumerate(self.model.pieces) if p[2] == UNKNOWN), None)
        self.bytes_of = np.array([1 if kind == BYTE else len(p.encode()) for p, _, kind in self.model.pieces], np.int64)
        self._forget()

    def _forget(self) -> None:
        """Known segments: number by text; ids of all in one array, with where each begins; both verdicts."""
        self.index: dict[str, int] = {}
        self.chars = 0
        self.ids, self.at = np.empty(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.same, self.back = np.zeros(1 << 14, bool), np.zeros(1 << 14, bool)

    def _learn(self, segments: list[str]) -> None:
        """Encode segments not met before, compare with the original library and decode them again."""
        joined = [s for s in segments if s[0] == MARK != s[-1]] if self.model.splits else []
        rest = [s for s in segments if s[0] != MARK or s[-1] == MARK] if joined else segments
        if joined:
            rest += self._together(joined)
        if rest:
            got = [e.ids for e in self.tok.encode_batch_fast(rest, add_special_tokens=False)]
            decoded = self.tok.decode_batch(got, skip_special_tokens=False)
            back = [d == self._plain(s) for d, s in zip(decoded, rest, strict=True)]
            same = self._compare(rest, got) if self.by_segment else [True] * len(got)
            self._store(rest, np.fromiter((i for x in got for i in x), np.int32), np.cumsum(np.fromiter(map(len, got), np.int64, len(got))), same, back)

    def _store(self, segments: list[str], ids: np.ndarray, ends: np.ndarray, same, back) -> None:
        n, m = len(self.index), len(segments)
        while n + m + 1 > len(self.at):
            self.at, self.same, self.back = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.same, self.back))
        self.index.update(zip(segments, range(n, n + m), strict=True))
        self.chars += sum(map(len, segments))
        self.at[n + 1 : n + m + 1] = self.at[n] + ends
        while self.at[n + m] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.at[n] : self.at[n + m]] = ids
        self.same[n : n + m], self.back[n : n + m] = same, back

    def _plain(self, segment: str) -> str:
        return (segment[1:] if self.model.add_dummy_prefix and segment[0] == MARK else segment).replace(MARK, " ")

    def _together(self, segments: list[str]) -> list[str]:
        """Encode segments that start with a marker as running text: a cut before each is exact, so nothing changes.

        Where each segment's ids end is told by the bytes that the pieces stand for. Runs with an unknown piece, which
        stands for any bytes, come back to be encoded one by one, as do runs that the library or decoding disagree with.
        """
        back, again = [], []
        for at in range(0, len(segments), RUN * 64):
            groups = [segments[i : i + RUN] for i in range(at, min(at + RUN * 64, len(segments)), RUN)]
            texts = ["".join(g) for g in groups]
            got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
            plain = [t[self.model.add_dummy_prefix :].replace(MARK, " ") for t in texts]
            lib = self.check.encode(plain, num_threads=1) if self.by_segment else got
            good = [d == t and x == y for x, y, d, t in zip(got, lib, self.tok.decode_batch(got, skip_special_tokens=False), plain, strict=True)]
            good = [g and not (self.unknown is not None and self.unknown in x) for g, x in zip(good, got, strict=True)]
            again += [s for g, ok in zip(groups, good, strict=True) if not ok for s in g]
            back = [s for g, ok in zip(groups, good, strict=True) if ok for s in g]
            if not back:
                continue
            ids = np.fromiter(chain.from_iterable(x for x, ok in zip(got, good, strict=True) if ok), np.int32)
            covered = np.cumsum(self.bytes_of[ids])
            want = np.cumsum(np.fromiter((len(s.encode()) for s in back), np.int64, len(back)))
            ends = np.searchsorted(covered, want) + 1
            if not np.array_equal(covered[ends - 1], want):
                raise ValueError("a piece reaches over the start of a segment")
            self._store(back, ids, ends, True, True)
        return again

    def _compare(self, segments: list[str], got: list[list[int]]) -> list[bool]:
        # the library puts a marker of its own before each text: a segment that starts with one stands for itself
        own = [s[1:] if s.startswith(MARK) else s for s in segments]
        want = self.check.encode([s.replace(MARK, " ") for s in own], num_threads=1)
        same = []
        for s, o, a, b in zip(segments, own, got, want, strict=True):
            if o and s is not o:
                same.append(a == b)
            elif s == MARK:
                same.append(a == self.glued)
            else:  # a segment without its marker can't be handed to the library alone
                same.append(self.tok.encode(MARK + s, add_special_tokens=False).ids == b if s else not a)
        return same

    def slices(self, text: str) -> Iterator[str]:
        """Normalised text in parts that start where a segment does."""
        if not text:
            return
        if not self.model.plain:
            text = self.normal.normalize_str(text)
        if self.model.escape_whitespaces:
            text = text.replace(" ", MARK)
        if self.model.add_dummy_prefix and text:
            text = (MARK if self.model.escape_whitespaces else " ") + text
        at = 0
        while at < len(text):
            end = len(text)
            if self.model.splits and end - at > SLICE:
                m = re.compile(f"[^{MARK}](?={MARK})").search(text, at + SLICE)
                end = m.end() if m else end
            yield text[at:end]
            at = end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, where each text's begin (one more: the end), and per text: as the library, decodes to itself."""
        cut = [[s for part in self.slices(t) for s in self.cut(part)] for t in texts]
        if len(self.index) > CACHE_SEGMENTS or self.chars > CACHE_CHARS:
            self._forget()
        known = self.index
        self._learn(list({s for parts in cut for s in parts if s not in known}))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        k = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        sizes = self.at[k + 1] - self.at[k]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.at[k] - ends[:-1], sizes)]
        first = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[[0, 0]], np.cumsum(np.column_stack([~self.same[k], ~self.back[k]]), axis=0)])
        wrong = bad[first[1:]] - bad[first[:-1]]
        same = wrong[:, 0] == 0
        if self.check and not self.by_segment:  # whole texts with the library
            same = np.array([ids[a:z].tolist() == want for a, z, want in zip(ends[first], ends[first[1:]], self.check.encode(texts, num_threads=1), strict=False)], bool)
        return ids, ends[first], same, (wrong[:, 1] == 0) & np.array([MARK not in t and (self.model.plain or self.normal.normalize_str(t) == t) for t in texts], bool)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def encode(docs: DataFrame, model_path: str = MODEL_PATH, verify: bool = True) -> DataFrame:
    """Ids of every text, as in DDL. The model (under 1 MB for public vocabularies) travels to the executors."""
    with open(model_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value, verify)
        for b in chunks(batches, "text", 1 << 20):
            texts = [t.decode("utf-8", "replace") for t in raw(b.column("text"))]
            ids, starts, same, back = codec.encode(texts)
            lists = pa.ListArray.from_arrays(starts.astype(np.int32), ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(starts)), lists, pa.array(same), pa.array(back)], schema=SCHEMA)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(step, DDL)


def decode(coded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids give an empty text."""
    with open(model_path, "rb") as f:
        data = coded.sparkSession.sparkContext.broadcast(f.read())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data.value, False)
        for b in batches:
            ids = [np.array(x or [], np.int32) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(codec.decode(ids), pa.string())], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(step, "doc_id long, text string")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))
