"""Exact substring dedup by fixed-block anchors.

The reference blocks are the non-overlapping blocks of ``BLOCK`` words of each document, so each window
of ``WINDOW`` words holds a whole one. Every rolling window of ``BLOCK`` words probes them. A hit whose
words occur in two documents or more is an anchor; it is extended to the windows of ``WINDOW`` words
around it, those occurring in a document with a smaller id are repeats, and repeats that touch join
to maximal ones.

Probes travel to their hash's bucket packed to about six bytes each, anchors and repeats travel back to
their documents' bucket. A task has one bucket of hashes; its occurrences are kept packed, what it holds unpacked are
its distinct hashes; a passage in a third of all documents is one hash there. No pair of documents is ever formed.
Equality is that of 64-bit hashes and, within it, of an anchor.

Defined results: null text has no words; documents of one id don't repeat each other; null ids neither
repeat nor are repeated, their rows are returned unchanged. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .messages import MESSAGE, bucket_of, pack_places, rows, send_texts, split, trim, unpack_places, unpack_table
from .shared import small_batches
from .words import U, blocks, inside, windows

WINDOW, BLOCK = 50, 25
#: Buckets for each of Spark's shuffle partitions: of hashes, and of documents.
FINER, GROUPS = 4, 4
FLUSH, MERGE = 1_000_000, 1 << 20
OUT = "id long, n_words long, n_removed long, kept_text string"


def _probe(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            h, ids, pos = (np.concatenate(x) for x in zip(*held))
            held.clear()
            low = h.astype(np.uint32)
            parts = split(((h >> U(32)) % U(count)).astype(np.int64), count)
            return rows([(b, pack_places(ids[i], pos[i], low[i])) for b, i in parts])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for w in blocks(batch.column(1)):
                at = inside(w, BLOCK)
                if len(at):
                    doc = w.doc_of()[at]
                    held.append((windows(w.hashes(), BLOCK)[at], ids[doc + w.lo], at - w.docs[doc]))
                    if sum(len(x[0]) for x in held) > FLUSH:
                        yield flush()
        if held:
            yield flush()
        trim()

    return run


class _Distinct:
    """Distinct hashes with the least and greatest id of each, and whether a reference block has it."""

    def __init__(self):
        self.h = np.empty(0, np.uint64)
        self.low = self.high = np.empty(0, np.int64)
        self.ref = np.empty(0, bool)

    def add(self, fresh: list[tuple[np.ndarray, ...]]):
        """Takes in (hashes, ids, references) and empties the list; one column after the other, to hold little at once."""
        h = np.concatenate([self.h, *(x[0] for x in fresh)])
        order = np.argsort(h, kind="stable")
        h = h[order]
        at = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        self.h = h[at]
        del h
        for name, column, reduce in (("low", 1, np.minimum), ("high", 1, np.maximum), ("ref", 2, np.logical_or)):
            x = np.concatenate([getattr(self, name), *(y[column] for y in fresh)])[order]
            setattr(self, name, reduce.reduceat(x, at) if len(at) else x)
        fresh.clear()

    def find(self, h):
        return np.searchsorted(self.h, h)

    def has(self, h):
        at = self.find(h)
        at[at == len(self.h)] = 0
        return self.h[at] == h if len(self.h) else np.zeros(len(h), bool)


def _answer(count: int, anchors: bool):
    """A partition is one bucket of hashes: which places are anchors, or else repeats; to the documents' buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, fresh, new, bodies = _Distinct(), [], 0, []

        def read(bucket, body):
            ids, pos, h = unpack_places(body, "u4" if anchors else "u8")
            return ids, pos, (U(bucket) << U(32)) | h.astype(np.uint64) if anchors else h

        for batch in batches:
            for bucket, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = body.as_py()
                bodies.append((bucket, body))
                ids, pos, h = read(bucket, body)
                fresh.append((h, ids, (pos % BLOCK == 0) if anchors else np.ones(len(h), bool)))
                new += len(h)
                if new > MERGE:
                    seen.add(fresh)
                    new = 0
        seen.add(fresh)
        shared = seen.ref & (seen.low < seen.high)
        if anchors:
            # of the hashes only those of anchors are asked for
            seen.h, shared = seen.h[shared], None
            seen.low = seen.high = seen.ref = None
        held, n = [], 0

        def flush():
            ids, pos = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((pos, ids))
            ids, pos = ids[order], pos[order]
            return rows([(b, pack_places(ids[i], pos[i])) for b, i in split(bucket_of(ids, count), count)])

        for bucket, body in bodies:
            ids, pos, h = read(bucket, body)
            if anchors:
                hit = seen.has(h)
            else:
                hit = seen.low[seen.find(h)] < ids
            if hit.any():
                held.append((ids[hit], pos[hit]))
                n += int(hit.sum())
                if n > FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        del seen, bodies, held
        trim()

    return run


def _texts(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The rows of a bucket by id and text, each with its text's number among those of its id."""
    t = pa.concat_tables([unpack_table(x.as_py()) for x in table.column("body")]) if table.num_rows else schema.empty_table()
    t = t.set_column(1, "text", pc.fill_null(t.column(1), "")).sort_by([("id", "ascending"), ("text", "ascending")])
    if not t.num_rows:
        return t.append_column("variant", pa.array([], pa.int64()))
    ids, text = t.column("id").to_numpy(), t.column("text")
    new = np.append(True, ids[1:] != ids[:-1])
    other = np.append(False, pc.not_equal(text[1:], text[:-1]).to_numpy())
    sums = np.cumsum(other & ~new)
    return t.append_column("variant", pa.array(sums - np.repeat(sums[new], np.diff(np.append(np.flatnonzero(new), len(ids))))))


def _places(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(id, position) pairs of a bucket's messages, in order."""
    if not table.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, pos = (np.concatenate(x) for x in zip(*(unpack_places(x.as_py()) for x in table.column("body"))))
    order = np.lexsort((pos, ids))
    return ids[order], pos[order]


def _marks(w, ids: np.ndarray, variant: np.ndarray | None, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each word of a block, whether it's a place of its document (and variant)."""
    mark = np.zeros(len(w.starts) + 1, np.int8)
    own = ids[w.lo : w.hi]
    lo, hi = np.searchsorted(at[0], own), np.searchsorted(at[0], own, side="right")
    n = hi - lo
    doc = np.repeat(np.arange(len(own)), n)
    pos = at[1][np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(doc))]
    if variant is not None:
        keep = (pos >> 40) == variant[w.lo : w.hi][doc]
        doc, pos = doc[keep], pos[keep] & ((1 << 40) - 1)
    keep = pos < np.diff(w.docs)[doc]
    mark[w.docs[doc[keep]] + pos[keep]] = 1
    return mark[:-1]


def _reach(mark: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """Whether one of the ``mark`` values from ``back`` before to ``ahead`` after each place is set."""
    sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
    i = np.arange(len(mark))
    return sums[np.minimum(i + ahead + 1, len(mark))] > sums[np.maximum(i - back, 0)]


def _extend(count: int, schema: pa.Schema):
    def run(texts: pa.Table, anchors: pa.Table) -> pa.Table:
        out, at = [], _places(anchors)
        if len(at[0]):
            t = _texts(texts, schema)
            t = t.filter(pc.is_in(t.column("id"), pa.array(np.unique(at[0]))))
            ids, variant = t.column("id").to_numpy(), t.column("variant").to_numpy()
            for w in blocks(t.column("text")):
                near = _reach(_marks(w, ids, None, at), 0, WINDOW - BLOCK)
                p = inside(w, WINDOW)
                p = p[near[p]]
                if len(p):
                    h, doc = windows(w.hashes(), WINDOW)[p], w.doc_of()[p]
                    pos = (p - w.docs[doc]) | (variant[doc + w.lo] << 40)
                    own = ids[doc + w.lo]
                    out += [(b, pack_places(own[i], pos[i], h[i])) for b, i in split((h % U(count)).astype(np.int64), count)]
        trim()
        return pa.Table.from_batches([rows(out)])

    return run


def _kept(t: pa.Table, at, layout: bool) -> pa.Table:
    ids, variant = t.column("id").to_numpy(), t.column("variant").to_numpy()
    kept, total, removed = [], [], []
    for w in blocks(t.column("text")):
        gone = _reach(_marks(w, ids, variant, at), WINDOW - 1, 0)
        data = w.data.tobytes()
        sums = np.concatenate([[0], np.cumsum(gone)])
        n = sums[w.docs[1:]] - sums[w.docs[:-1]]
        for i, (a, b) in enumerate(zip(w.docs[:-1].tolist(), w.docs[1:].tolist())):
            if layout and not n[i]:
                kept.append(t.column("text")[w.lo + i].as_py())
                continue
            stay = np.flatnonzero(~gone[a:b]) + a
            kept.append(b" ".join([data[s:e] for s, e in zip(w.starts[stay].tolist(), w.ends[stay].tolist())]).decode())
        total.append(np.diff(w.docs))
        removed.append(n)
    none = [np.empty(0, np.int64)]
    new = pa.table({"id": t.column("id"), "n_words": np.concatenate(none + total).astype(np.int64), "n_removed": np.concatenate(none + removed).astype(np.int64), "kept_text": pa.array(kept, pa.string())})
    for c in t.column_names[2:-1]:
        new = new.append_column(c, t.column(c))
    return new


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), layout: bool = False, map_out=None, out: str = OUT) -> DataFrame:
    """``id, n_words, n_removed, kept_text`` and the columns ``carry`` for each row.

    Kept words are joined by one space; with ``layout`` a text of which nothing goes stays as it is.
    ``map_out`` turns a table of the first four into one of the columns ``out`` before it leaves the task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"c_{c}") for c in carry))
    schema = to_arrow_schema(docs.schema)
    out += "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema.fields[2:])
    known = docs.where("id is not null")
    fine, groups = FINER * count, GROUPS * count
    texts = known.mapInArrow(send_texts(groups), MESSAGE)
    finish = map_out or (lambda t: t)

    def to_buckets(df: DataFrame) -> DataFrame:
        return df.repartitionById(fine, "bucket")

    def with_texts(places: DataFrame, f, schema: str) -> DataFrame:
        return texts.groupBy("bucket").cogroup(places.groupBy("bucket")).applyInArrow(f, schema)

    def cut(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        out = finish(_kept(_texts(texts, schema), _places(repeats), layout))
        trim()
        return out

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).set_column(0, "id", pa.array(np.zeros(batch.num_rows, np.int64)))
            t = t.set_column(1, "text", pc.fill_null(t.column(1), "")).append_column("variant", pa.array(np.zeros(batch.num_rows, np.int64)))
            t = finish(_kept(t, (np.empty(0, np.int64),) * 2, layout))
            yield from t.set_column(0, "id", pa.nulls(t.num_rows, pa.int64())).to_batches()

    anchors = to_buckets(known.mapInArrow(_probe(fine), MESSAGE)).mapInArrow(_answer(groups, True), MESSAGE)
    repeats = to_buckets(with_texts(anchors, _extend(fine, schema), MESSAGE)).mapInArrow(_answer(groups, False), MESSAGE)
    found = with_texts(repeats, cut, out).unionByName(docs.where("id is null").mapInArrow(unchanged, out))
    return found.select(*(c for c in found.columns if not c.startswith("c_")), *(F.col(f"c_{c}").alias(c) for c in carry))


def digest(t: pa.Table) -> pa.Table:
    """The kept text as a hash."""
    sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in t.column("kept_text")]
    return t.set_column(3, "kept_sha256", pa.array(sha, pa.string()))


DIGEST = "id long, n_words long, n_removed long, kept_sha256 string"
