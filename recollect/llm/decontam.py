"""Benchmark decontamination by spaced-seed hashing.

Tokens are the words of the lower-cased text with ASCII punctuation taken as space. Each mask looks at two runs of
successive tokens, ``RUN`` each, some tokens apart, and ignores those between, so a substituted token leaves other
seeds whole. Seeds of training texts are joined with those of the benchmark; around a hit
both texts are compared along its diagonal, a match counting 1 and a substitution ``-MISMATCH``, and
the best stretch is an overlap if it has ``MATCHES`` equal tokens. Of an item of fewer than ``LONG`` tokens four fifths
must be equal, wherever they stand in it. Items below ``SHORT`` tokens have masks of runs of ``SMALL``. Those below
``WHOLE`` have one seed of all their tokens, and must occur whole. Three substitutions in 15 tokens (of shorter items: a
fifth) leave two runs whole wherever they stand, so these are always found.

The benchmark is broadcast in parts of at most ``PART`` characters. A larger one takes a pass for each, which adds to the
rows' overlaps and is written to the shared folder; so a row needs no key.

Defined results: null texts and items have no tokens; items without tokens or without id match nothing; null ids and
repeated rows are kept, a row each, whatever the number of parts; an empty benchmark matches nothing. Texts are read
whole, whatever their length. Equal overlaps of one item are told once, in the order of item and place. Columns other
than id and text are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches
from .words import U, blocks, mix, windows

RUN, APART = 3, (3, 4, 5, 6, 7, 8, 9, 12)
SMALL, WHOLE, SHORT, LONG = 2, 11, 15, 17
MATCHES, MISMATCH, SHARE = 13, 2, 0.8
PART = 8 << 20
_SPACE = bytes(0x20 if chr(b) in string.punctuation else b for b in range(256))
OUT = "id long, n_tokens long, items array<long>, overlaps array<struct<item:long,start:int,tokens:int,equal:int>>"
_SPAN_TYPE = pa.struct([("item", pa.int64()), ("start", pa.int32()), ("tokens", pa.int32()), ("equal", pa.int32())])
_KEYS = ("item", "start", "tokens", "equal")
_OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("items", pa.list_(pa.int64())), ("overlaps", pa.list_(_SPAN_TYPE))])


def normal(texts: pa.Array) -> pa.Array:
    return pa.array([(t or "").lower().encode().translate(_SPACE) for t in texts.to_pylist()], pa.binary())


def seeds(runs: np.ndarray, apart: int) -> np.ndarray:
    """Hash of two runs, of each position and ``apart`` tokens on; ``runs`` are the hashes of one."""
    n = len(runs) - apart
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix(runs[:n] * U(0x9FB21C651E98DF25) + runs[apart:], apart)


def masks(n: int) -> list[tuple[int, int]]:
    """(run, apart) of the masks of an item of ``n`` tokens; ``(n, 0)`` is all of them."""
    if n < WHOLE:
        return [(n, 0)] if n else []
    return [(SMALL, d) for d in range(1, n - SMALL + 1)] if n < SHORT else [(RUN, d) for d in APART]


class Index:
    """Seeds of some benchmark items."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, found = ids, {}
        words, cuts = [np.empty(0, np.uint64)], [0]
        for w in blocks(normal(pa.array(texts, pa.string()))):
            h = w.hashes()
            for a, b in zip(w.docs[:-1], w.docs[1:]):
                item, own = len(cuts) - 1, h[a:b]
                words.append(own)
                cuts.append(cuts[-1] + len(own))
                for run, apart in masks(len(own)):
                    runs = windows(own, run)
                    found.setdefault((run, apart), []).append((seeds(runs, apart) if apart else runs, item))
        self.words, self.cuts = np.concatenate(words), np.array(cuts)
        n = np.diff(self.cuts)
        self.need = np.where(n < WHOLE, np.maximum(1, n), np.where(n < LONG, np.ceil(SHARE * n - 1e-9), MATCHES)).astype(np.int64)
        self.tables = {}
        for kind, parts in sorted(found.items()):
            s = np.concatenate([x for x, _ in parts])
            item = np.concatenate([np.full(len(x), i) for x, i in parts])
            at = np.concatenate([np.arange(len(x)) for x, _ in parts])
            order = np.argsort(s, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[s >> U(44)] = True
            self.tables[kind] = s[order], item[order], at[order], bits

    def hits(self, w, h) -> np.ndarray:
        """Distinct (text, item, diagonal) rows of a block, of which enough tokens are equal somewhere."""
        out, runs = [], {}
        for (run, apart), (s, item, at, bits) in self.tables.items():
            if run not in runs:
                runs[run] = windows(h, run)
            own = seeds(runs[run], apart) if apart else runs[run]
            p = np.flatnonzero(bits[own >> U(44)])
            lo, hi = np.searchsorted(s, own[p]), np.searchsorted(s, own[p], side="right")
            n = hi - lo
            if not n.any():
                continue
            p, lo, n = p[n > 0], lo[n > 0], n[n > 0]
            doc = np.searchsorted(w.docs, p, side="right") - 1
            n[p + apart + run > w.docs[doc + 1]] = 0
            pos, doc = np.repeat(p, n), np.repeat(doc, n)
            k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(pos))
            out.append(np.stack([doc, item[k], pos - w.docs[doc] - at[k]], axis=1))
        if not out:
            return np.empty((0, 3), np.int64)
        out = np.unique(np.concatenate(out), axis=0)
        keep = [self._equal(w, h, out[i : i + 4096]) >= self.need[out[i : i + 4096, 1]] for i in range(0, len(out), 4096)]
        return out[np.concatenate(keep)]

    def _equal(self, w, h, rows: np.ndarray) -> np.ndarray:
        """Equal tokens along each row's diagonal."""
        doc, item, diagonal = rows.T
        lo = np.maximum(0, -diagonal)
        hi = np.minimum(self.cuts[item + 1] - self.cuts[item], w.docs[doc + 1] - w.docs[doc] - diagonal)
        n = hi - lo
        row = np.repeat(np.arange(len(rows)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        same = h[w.docs[doc][row] + diagonal[row] + k] == self.words[self.cuts[item][row] + k]
        return np.bincount(row[same], minlength=len(rows))

    def overlap(self, text: np.ndarray, item: int, diagonal: int) -> tuple[int, int, int] | None:
        """Start, length and equal tokens of the best stretch along a diagonal, if long enough; of a short item, of all that is equal."""
        tokens = self.words[self.cuts[item] : self.cuts[item + 1]]
        lo, hi = max(0, diagonal), min(len(text), diagonal + len(tokens))
        same = text[lo:hi] == tokens[lo - diagonal : hi - diagonal]
        if len(tokens) < LONG:
            at = np.flatnonzero(same)
            start, end = (int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0)
        else:
            sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
            low = np.minimum.accumulate(sums)
            end = int(np.argmax(sums - low))
            start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
        equal = int(same[start:end].sum())
        return (lo + start, end - start, equal) if equal >= self.need[item] else None


@lru_cache(maxsize=2)
def _index(ids: tuple, texts: tuple) -> Index:
    return Index(list(ids), list(texts))


def _spans(index: Index, texts: pa.Array) -> tuple[list[int], list[list[tuple]]]:
    """Tokens and overlaps (item, start, tokens, equal) of each text."""
    tokens, spans = [], []
    for w in blocks(normal(texts)):
        h = w.hashes()
        found: dict[int, set] = {}
        for doc, item, diagonal in index.hits(w, h).tolist():
            if x := index.overlap(h[w.docs[doc] : w.docs[doc + 1]], item, diagonal):
                found.setdefault(doc, set()).add((index.ids[item], *x))
        tokens += np.diff(w.docs).tolist()
        spans += [sorted(found.get(i, ())) for i in range(w.hi - w.lo)]
    return tokens, spans


def _find(part, more: bool):
    """With ``more``, rows (id, text, n_tokens, items, overlaps) to such rows, with this part's overlaps added; else from (id, text), and without the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*part.value)
        for batch in batches:
            tokens, spans = _spans(index, batch.column(1))
            if batch.num_columns > 2:
                before = [[tuple(x[k] for k in _KEYS) for x in s] for s in batch.column(4).to_pylist()]
                spans = [sorted({*a, *b}) for a, b in zip(before, spans)]
            items = [sorted({x[0] for x in s}) for s in spans]
            spans = [[dict(zip(_KEYS, x)) for x in s] for s in spans]
            columns = [pa.array(tokens, pa.int64()), pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(_SPAN_TYPE))]
            if more:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "text", *_OUT.names[1:]])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_OUT)

    return run


def _drop(part, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(*part.value)
        for batch in batches:
            yield batch.filter(pa.array([not s for s in _spans(index, batch.column(column))[1]], pa.bool_()))

    return run


def _parts(benchmark: DataFrame):
    """The benchmark's (ids, texts), part by part; the driver holds one part at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.where("id is not null and text is not null").toLocalIterator():
        if size + len(row.text) > PART and ids:
            yield tuple(ids), tuple(texts)
            ids, texts, size = [], [], 0
        ids.append(row.id)
        texts.append(row.text)
        size += len(row.text)
    if ids:
        yield tuple(ids), tuple(texts)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that overlap no item. Nothing is shuffled."""
    benchmark = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    small_batches(docs.sparkSession)
    sc, column = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for i, p in enumerate(_parts(benchmark)):
        docs = (materialize(docs, "clean") if i else docs).mapInArrow(_drop(sc.broadcast(p), column), docs.schema)
    return docs


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id, n_tokens, items, overlaps`` for each row of ``docs``: benchmark items it overlaps, and where (in tokens)."""
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    benchmark = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).alias("text"))
    parts = _parts(benchmark)
    p = next(parts, ((), ()))
    while (after := next(parts, None)) is not None:
        rows = materialize(rows.mapInArrow(_find(sc.broadcast(p), True), OUT.replace("id long,", "id long, text string,", 1)), "overlaps")
        p = after
    return rows.mapInArrow(_find(sc.broadcast(p), False), OUT)
