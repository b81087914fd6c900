"""Language identification: script ranges, per-word scores, and Viterbi with a switching penalty.

Training counts hashed byte n-grams (2 to 4, word ends included) and letters by script for each language,
over all training rows; the table has a fixed size for each language. A word's candidates are the
languages that write its script, its score for each is the mean log-probability of its n-grams
times its letters. Viterbi over a text's words, where changing the language costs ``SWITCH``, labels
spans; the text's language is that of most letters, and its score the share of those.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and where nothing was
learned; a letter is a character of Unicode's letter categories, whatever stands beside it. Ties go to the first
language by name. Texts are read whole, whatever their length. Repeated rows and null ids are kept, a row each. Columns
other than those named are not read; ``known`` passes them on.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .messages import trim
from .shared import small_batches
from .words import blocks

SWITCH = 6.0
GRAMS = (1 << 16, 1 << 16, 1 << 17)
TABLE = sum(GRAMS)
SMOOTH = 0.5
#: Rows read at once, and bytes of their n-grams.
ROWS, PIECE = 2500, 1 << 18
#: Inclusive ranges of code points by script; other letters are of script 1.
RANGES = [
    (2, 0x41, 0x24F), (2, 0x1E00, 0x1EFF), (3, 0x370, 0x3FF), (3, 0x1F00, 0x1FFF), (4, 0x400, 0x52F), (5, 0x530, 0x58F), (6, 0x590, 0x5FF),
    (7, 0x600, 0x77F), (7, 0x8A0, 0x8FF), (7, 0xFB50, 0xFDFF), (7, 0xFE70, 0xFEFF), (8, 0x900, 0x97F), (9, 0x980, 0x9FF), (10, 0xA00, 0xA7F),
    (11, 0xA80, 0xAFF), (12, 0xB80, 0xBFF), (13, 0xC00, 0xC7F), (14, 0xC80, 0xCFF), (15, 0xD00, 0xD7F), (16, 0xE00, 0xE7F), (17, 0x10A0, 0x10FF),
    (18, 0x1100, 0x11FF), (18, 0xAC00, 0xD7AF), (19, 0x1200, 0x137F), (20, 0x3040, 0x30FF), (21, 0x3400, 0x4DBF), (21, 0x4E00, 0x9FFF), (21, 0xF900, 0xFAFF),
]
SCRIPTS = 22
RARE = 1e-3
OUT = "id long, lang_pred string, score double, n_spans int"
_OUT = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_spans", pa.int32())])
SPAN_OUT = OUT + ", spans array<struct<first_word:int,words:int,lang:string>>"


@lru_cache
def _scripts() -> np.ndarray:
    """Script by code point; beyond the last plane with letters there are none."""
    out = np.zeros(1 << 18, np.uint8)
    out[[c for c in range(1 << 18) if unicodedata.category(chr(c))[0] == "L"]] = 1
    for s, a, b in RANGES:
        out[a : b + 1] *= s
    return out


def _kinds(b: np.ndarray, c: np.ndarray, d: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Script of the character that begins with byte ``b`` and goes on with the others; 0 within one."""
    table = _scripts()
    kind = np.where(b < 128, table[np.minimum(b, 127)], np.where(b >= 0xC0, table[((b & 31) << 6) | (c & 63)], 0)).astype(np.uint8)
    long = np.flatnonzero(b >= 0xE0)
    if len(long):
        b, c, d, e = b[long], c[long] & 63, d[long] & 63, e[long] & 63
        point = np.where(b < 0xF0, ((b & 15) << 12) | (c << 6) | d, ((b & 7) << 18) | (c << 12) | (d << 6) | e)
        kind[long] = np.where(point < len(table), table[np.minimum(point, len(table) - 1)], 0)
    return kind


def spaced(texts: pa.Array) -> pa.Array:
    """Lower case, and a space after each, so that n-grams don't join texts."""
    return pa.array([(t or "").lower().encode() + b" " for t in texts.to_pylist()], pa.binary())


def features(w) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes in words: n-gram numbers [bytes, 3] and each word's first row; letters and script of each word."""
    solid = np.zeros(len(w.data) + 1, np.int32)
    solid[w.starts] = 1
    solid[w.ends] -= 1
    at = np.flatnonzero(np.cumsum(solid)[:-1])
    d = w.data.astype(np.uint32)
    pad = np.concatenate([[32], np.where((d == 32) | ((d >= 9) & (d <= 13)), 32, d), [32, 32, 32]]).astype(np.uint32)
    a, b, c, e = pad[at], pad[at + 1], pad[at + 2], pad[at + 3]
    g2 = (a << 8) | b
    g3 = (((g2 << 8) | c) * np.uint32(2654435761)) >> np.uint32(16)
    g4 = ((((g2 << 16) | (c << 8) | e) * np.uint32(2246822519)) ^ (g2 * np.uint32(40503))) >> np.uint32(15)
    grams = np.stack([g2, g3 + GRAMS[0], g4 + GRAMS[0] + GRAMS[1]], axis=1)
    size = w.ends - w.starts
    first = np.cumsum(size) - size
    kind = _kinds(b, c, e, pad[at + 4])
    letter = kind > 0
    if not len(first):
        return grams, first, first, first
    letters = np.add.reduceat(letter.astype(np.int64), first)
    return grams, first, letters, np.maximum.reduceat(kind, first).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for w in blocks(spaced(batch.column(0)), PIECE):
            grams, first, letters, script = features(w)
            word_doc = w.doc_of()
            byte_doc = np.repeat(word_doc, w.ends - w.starts)
            own = langs[w.lo : w.hi]
            for lang in set(own):
                mine = own == lang
                s = sums.setdefault(lang, np.zeros(TABLE + SCRIPTS, np.int64))
                s[:TABLE] += np.bincount(grams[mine[byte_doc]].ravel(), minlength=TABLE)
                m = mine[word_doc]
                s[TABLE:] += np.bincount(script[m], weights=letters[m], minlength=SCRIPTS).astype(np.int64)
    yield from _sums(sums)
    trim()


def _sums(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, s in sums.items():
        yield pa.RecordBatch.from_pydict({"lang": [lang], "body": pa.array([zstandard.compress(s.tobytes(), 3)], pa.binary()), "part": pa.array([hash(s.tobytes()) % 16], pa.int32())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            s = np.frombuffer(zstandard.decompress(body.as_py()), np.int64)
            sums[lang] = sums[lang] + s if lang in sums else s
    yield from _sums(sums)


class Model:
    """Log-probabilities of n-grams by language, and the languages of each script."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        c = np.stack([counts[x] for x in self.langs]).astype(np.float64) if counts else np.zeros((0, TABLE + SCRIPTS))
        logs, lo = [], 0
        for g in GRAMS:
            part = c[:, lo : lo + g] + SMOOTH
            logs.append(np.log(part / part.sum(axis=1, keepdims=True)))
            lo += g
        self.logs = np.ascontiguousarray(np.concatenate(logs, axis=1).T.astype(np.float32))
        scripts = c[:, TABLE:]
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.writes = (share >= RARE).T
        self.writes[~self.writes.any(axis=1)] = True
        self.writes[0] = True

    def scores(self, w) -> tuple[np.ndarray, np.ndarray]:
        """Scores [words, languages] and letters of each word."""
        grams, first, letters, script = features(w)
        if not len(first) or not self.langs:
            return np.zeros((len(first), len(self.langs)), np.float32), letters
        s = self.logs[grams[:, 0]]
        s += self.logs[grams[:, 1]]
        s += self.logs[grams[:, 2]]
        s = np.add.reduceat(s, first, axis=0) / 3
        s[letters == 0] = 0
        return np.where(self.writes[script], s, s.min(axis=1, keepdims=True) - 50).astype(np.float32), letters


def viterbi(s: np.ndarray, docs: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word; all texts go on step by step together."""
    n, k = np.diff(docs), s.shape[1]
    path = np.zeros(len(s), np.uint8)
    order = np.argsort(-n, kind="stable")
    n, start = n[order], docs[:-1][order]
    if not len(s):
        return path
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")
    best = np.zeros(len(s), np.uint8)
    stay = np.ones((len(s), k), bool)
    live = active[0]
    v = s[start[:live]].copy()
    final = np.empty((len(n), k), np.float32)
    for t in range(1, n[0]):
        now = active[t]
        if now < live:
            final[now:live] = v[now:live]
            v, live = v[:now], now
        at = start[:live] + t
        b = v.argmax(axis=1)
        jump = v[np.arange(live), b] - switch
        best[at] = b
        stay[at] = v >= jump[:, None]
        v = np.maximum(v, jump[:, None]) + s[at]
        v -= v.max(axis=1, keepdims=True)
    final[:live] = v
    live = active[0]
    state = final[:live].argmax(axis=1).astype(np.uint8)
    for t in range(n[0] - 1, -1, -1):
        now = active[t]
        at = start[:now] + t
        path[at] = state[:now]
        keep = stay[at, state[:now]]
        state[:now] = np.where(keep, state[:now], best[at])
    return path


@lru_cache(maxsize=1)
def _model(parts: tuple) -> Model:
    return Model({lang: np.frombuffer(zstandard.decompress(b), np.int64) for lang, b in parts})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)
    trim()


def _read(m: Model, texts: pa.Array):
    """Of each text: language number (that after the last for ``und``), score, first word; of each word: text and language."""
    scores, letters, docs = [np.zeros((0, len(m.langs)), np.float32)], [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
    for w in blocks(spaced(texts), PIECE):
        s, n = m.scores(w)
        scores.append(s)
        letters.append(n)
        docs.append(w.docs[1:] + docs[-1][-1])
    s, n, d = np.concatenate(scores), np.concatenate(letters), np.concatenate(docs)
    k, rows = len(m.langs), len(d) - 1
    path = viterbi(s, d) if k else np.zeros(len(s), np.uint8)
    doc = np.repeat(np.arange(rows), np.diff(d))
    share = np.bincount(doc * max(1, k) + path, weights=n, minlength=rows * max(1, k)).reshape(rows, max(1, k))
    total = share.sum(axis=1)
    pick = np.where((total > 0) & (k > 0), share.argmax(axis=1), k)
    score = np.where(pick < k, share.max(axis=1) / np.maximum(total, 1), 0.0)
    return pick, score, d, doc, path


def _label(model, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        names = np.array([*m.langs, "und"], object)
        for batch in _pieces(batches):
            pick, score, d, doc, path = _read(m, batch.column(1))
            new = np.append(True, (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])) if len(doc) else np.empty(0, bool)
            spans = np.bincount(doc[new], minlength=len(d) - 1)
            columns = [batch.column(0), pa.array(names[pick], pa.string()), pa.array(score), pa.array(spans, pa.int32())]
            if not with_spans:
                yield pa.RecordBatch.from_arrays(columns, schema=_OUT)
                continue
            at = np.flatnonzero(new)
            size = np.diff(np.append(at, len(doc)))
            rows = [[] for _ in range(len(d) - 1)]
            for i, z, x, p in zip(doc[at].tolist(), size.tolist(), (at - d[doc[at]]).tolist(), path[at].tolist()):
                rows[i].append({"first_word": x, "words": z, "lang": str(names[p])})
            kind = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], names=[*_OUT.names, "spans"])

    return run


def _known(model, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for batch in _pieces(batches):
            yield batch.filter(pa.array(_read(m, batch.column(column))[0] < len(m.langs)))

    return run


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang"):
    """A broadcast model from the rows whose language is known. It holds two MB for each language."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    schema = "lang string, body binary, part int"
    sums = rows.mapInArrow(_count, schema).repartition("lang", "part").mapInArrow(_add, schema).repartition("lang").mapInArrow(_add, schema)
    return sc.broadcast(tuple(sorted((r.lang, bytes(r.body)) for r in sums.collect())))


def label(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``id, lang_pred, score, n_spans`` for each row, on demand with the spans."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_label(model, spans), SPAN_OUT if spans else OUT)


def known(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows, as they are, whose language isn't ``und``."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_known(model, docs.columns.index(text_col)), docs.schema)


def remainder(id_col: str, by: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by


def predict(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learns from the rows whose remainder by 3 is not 1 and labels all rows."""
    model = train(docs.where(remainder(id_col, 3) != 1))
    return label(docs, model, id_col).withColumn("held_out", F.coalesce(remainder("id", 3) == 1, F.lit(False)))
