"""Packed columns: many small values for one bucket travel as one row, so a shuffle writes little more than they hold."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard

from .words import U, mix

MESSAGE = "bucket int, body binary"
SCHEMA = pa.schema([("bucket", pa.int32()), ("body", pa.binary())])


def pack(*columns: np.ndarray, level: int = 1) -> bytes:
    """Columns of one length; each is cut in byte planes, which lets runs of small numbers shrink."""
    n = len(columns[0])
    head = np.array([n, *(c.dtype.itemsize for c in columns)], np.int64).tobytes()
    body = b"".join(c.view(np.uint8).reshape(n, -1).T.tobytes() for c in map(np.ascontiguousarray, columns))
    return zstandard.compress(head + body, level)


def unpack(body: bytes, *dtypes: str) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (1 + len(dtypes)), []
    for t in map(np.dtype, dtypes):
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * t.itemsize
    return out


def deltas(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Differences of ``x`` within runs of ``group``; a run begins with the value itself."""
    d = np.diff(x, prepend=0)
    new = np.ones(len(x), bool)
    new[1:] = group[1:] != group[:-1]
    d[new] = x[new]
    return d


def undelta(group: np.ndarray, d: np.ndarray) -> np.ndarray:
    new = np.ones(len(d), bool)
    new[1:] = group[1:] != group[:-1]
    sums = np.cumsum(d)
    starts = np.flatnonzero(new)
    return sums - np.repeat(sums[starts] - d[starts], np.diff(np.append(starts, len(d))))


def pack_places(ids: np.ndarray, pos: np.ndarray, *more: np.ndarray) -> bytes:
    """(id, position) pairs, best sorted, with further columns."""
    return pack(np.diff(ids, prepend=0), deltas(ids, pos), *more)


def unpack_places(body: bytes, *dtypes: str) -> list[np.ndarray]:
    ids, pos, *more = unpack(body, "i8", "i8", *dtypes)
    ids = np.cumsum(ids)
    return [ids, undelta(ids, pos), *more]


def split(bucket: np.ndarray, count: int) -> list[tuple[int, np.ndarray]]:
    """For each bucket in use, its rows in their order."""
    order = np.argsort(bucket.astype(np.uint16 if count <= 65536 else np.uint32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(count + 1))
    return [(b, order[cuts[b] : cuts[b + 1]]) for b in range(count) if cuts[b] < cuts[b + 1]]


def bucket_of(ids: np.ndarray, count: int) -> np.ndarray:
    return (mix(ids.view(np.uint64), 21) % U(count)).astype(np.int64)


def rows(items: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in items], pa.int32()), pa.array([x for _, x in items], pa.binary())], schema=SCHEMA)


def pack_table(table: pa.Table) -> bytes:
    """A small table as compressed Arrow."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def unpack_table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(body)).read_all()


def send_texts(count: int):
    """A mapInArrow function: rows that begin with an id to one message for each bucket of ids."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                ids = batch.column(0).to_numpy()
                yield rows([(b, pack_table(table.take(pa.array(i)))) for b, i in split(bucket_of(ids, count), count)])

    return run


@lru_cache
def _libc():
    lib = ctypes.CDLL(None)
    return lib if hasattr(lib, "malloc_trim") else None


def trim() -> None:
    """Gives freed memory back; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if lib := _libc():
        lib.malloc_trim(0)
