"""SimHash near-duplicates by navigable small-world graphs over Hamming distance.

Fingerprints are of a document's set of five-word shingles (one shingle of all its words if there are
fewer). Documents of one set form one class at once; a representative of each set goes on.

Shards: a representative belongs to one shard in each of ``TABLES`` tables, chosen by a min-hash of
its shingles, so two documents of similarity J share a shard with probability 1 - (1 - J)^TABLES.
Each shard builds a small-world graph of its fingerprints. A query reaches its shard in every table;
a shard over ``SHARD`` rows (one min-hash value may have a third of all rows) is split, its queries
are then broadcast to all parts. A search starts with a narrow beam, which doubles while all it
holds is within the radius. Each part audits a sample of its queries against exact search; a part
below ``RECALL`` searches with wider beams and at last exactly. A query is linked with the ``LINKS`` nearest that are
found, and with the least id of all found: in a crowd of near texts that joins all by links in proportion to their number.

Beside the graphs, which miss pairs whose min-hashes all differ or whose codes are farther apart than
``RADIUS``, a complete route: sets of similarity ``SIMILARITY`` share one of the first n - ceil(0.8 n) + 1 shingles of
each in any fixed order. Those prefixes, of the rarest shingles first, meet by shingle; pairs go
on whose sizes and whose places of the shingle allow the similarity. No similar pair is left out. How rare a
shingle is, counters tell that the fingerprints' tasks fill from all texts; shingles of one counter count together.

Sets are large and most candidate links are of sets less similar than that, so a link goes on only if the sets' odd
sketches allow it: a sketch has a bit for each bin of hashes, set if an odd number of shingles is in it. A bit that differs needs a
shingle that one set has alone, so no link of ``SIMILARITY`` is left out, whatever falls into one bin.

Candidate links are verified by the exact Jaccard similarity of shingle sets, first those of a
minimum spanning forest, then each one left between documents that are still apart. Classes are the
components of the verified links.

Defined results: null text and texts without words have no shingles and link with nothing. Equal
texts are one class. Repeated ids are taken once, null ids are a class of their own (null). Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .messages import MESSAGE, pack, rows, split, trim, unpack
from .shared import components, id_filter, materialize, passes, small_batches
from .words import U, blocks, mix, windows

SHINGLE, SIMILARITY = 5, 0.8
TABLES, SHARD, PER_SHARD = 4, 16384, 3000
#: Of 128 bits. At J = 0.8 two sets differ in 19.4 bits on average, with deviation 4.1.
RADIUS = 36
FARTHEST = 128
BEAM, MOST, RECALL, AUDIT, LINKS = 12, 96, 0.95, 16, 48
#: Counters of shingles, the parts in which they travel, steps of the logarithm that are told apart, and rows and pairs that a task holds.
COUNTERS, SLICES, STEPS, HELD, PAIRS = 1 << 23, 16, 8, 1_000_000, 1_000_000
#: Candidate links of which one task takes a spanning forest.
FOREST = 200_000
FORWARD, EARLY, NEAR = 8, 8, 8

_SPREAD = np.array([sum(((i >> (7 - b)) & 1) << (8 * b) for b in range(8)) for i in range(256)], np.uint64)
_FP = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("mins", pa.list_(pa.int64())), ("odd", pa.binary())])
_FP_SQL = "id long, n long, s1 long, s2 long, c1 long, c2 long, mins array<long>, odd binary"
_COUNTED = pa.schema([*_FP, ("slice", pa.int32()), ("seen", pa.binary())])


def shingles(w) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block: (text, hash), sorted."""
    h, counts = w.hashes(), np.diff(w.docs)
    win = windows(h, SHINGLE)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    at = np.repeat(w.docs[:-1] - first, n) + np.arange(len(doc))
    out = np.empty(len(doc), np.uint64)
    long = counts[doc] >= SHINGLE
    out[long] = win[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        out[first[i]] = windows(h[w.docs[i] : w.docs[i + 1]], int(counts[i]))[0]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (out[1:] != out[:-1])
    return doc[new], out[new]


def _segments(n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of at most ``step`` rows within groups of ``n`` rows; first run of each group."""
    parts = -(-n // step)
    first = np.cumsum(parts) - parts
    group = np.repeat(np.arange(len(n)), parts)
    return (np.cumsum(n) - n)[group] + (np.arange(len(group)) - first[group]) * step, first


def simhash(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """128-bit SimHash of groups of ``n`` (at least one) hashes each, as [groups, 2] uint64."""
    starts, first = _segments(n, 255)
    votes = []
    for salt in (11, 12):
        rows = mix(h, salt).view(np.uint8).reshape(-1, 8)
        lanes = np.add.reduceat(_SPREAD[rows], starts, axis=0)
        votes.append(np.add.reduceat(lanes.view(np.uint8).astype(np.int32), first, axis=0))
    ones = np.concatenate(votes, axis=1) * 2 > n[:, None]
    return np.packbits(ones, axis=1).view(np.uint64)


def odd_sketches(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """For groups of ``n`` (at least one) hashes, whether each of at least as many bins, a power of two, holds an odd number of them."""
    bins = np.maximum(64, 1 << np.ceil(np.log2(n)).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(bins)])
    at = np.repeat(ends[:-1], n) + (h & np.repeat(bins - 1, n).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends >> 3).astype(np.int32)), pa.py_buffer(bits)])


def apart(x: pa.Array, y: pa.Array) -> np.ndarray:
    """For pairs of sketches, how many hashes are in one of the sets only, at least."""
    (off_x, data_x), (off_y, data_y) = ((np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1].astype(np.int64), np.frombuffer(v.buffers()[2], np.uint8)) for v in (x, y))
    size_x, size_y, out = np.diff(off_x), np.diff(off_y), np.zeros(len(x), np.int64)
    for p, q in np.unique(np.stack([size_x, size_y], axis=1), axis=0).tolist():
        i = np.flatnonzero((size_x == p) & (size_y == q))
        # the larger one is folded to the bins of the smaller
        a, b = (np.bitwise_xor.reduce(data[off[i, None] + np.arange(size)].reshape(len(i), -1, min(p, q)), axis=1) for off, data, size in ((off_x, data_x, p), (off_y, data_y, q)))
        out[i] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], seen: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each text with words; ``seen`` counts its shingles, if given."""
    for batch in batches:
        ids = batch.column(0)
        for w in blocks(batch.column(1)):
            doc, h = shingles(w)
            if seen is not None:
                np.add.at(seen, (h % U(COUNTERS)).astype(np.int64), np.uint32(1))
            n = np.bincount(doc, minlength=w.hi - w.lo)
            has = np.flatnonzero(n)
            if not len(has):
                continue
            n, at = n[has], (np.cumsum(n) - n)[has]
            code = simhash(h, n).view(np.int64)
            with np.errstate(over="ignore"):
                sums = [np.add.reduceat(mix(h, s), at).view(np.int64) for s in (1, 2)]
            mins = np.stack([np.minimum.reduceat(mix(h, 100 + t), at) for t in range(TABLES)], axis=1).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, mins.size + 1, TABLES, dtype=np.int32), mins.ravel())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(has + w.lo)), pa.array(n), *map(pa.array, sums), pa.array(code[:, 0].copy()), pa.array(code[:, 1].copy()), lists, odd_sketches(h, n)], schema=_FP)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints, then a task's counters as rows of their own."""
    seen = np.zeros(COUNTERS, np.uint32)
    for batch in _fingerprints(batches, seen):
        none = [pa.nulls(batch.num_rows, t) for t in _COUNTED.types[-2:]]
        yield pa.RecordBatch.from_arrays([*batch.columns, *none], schema=_COUNTED)
    for i, part in enumerate(np.split(seen, SLICES) if seen.any() else []):
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in _FP.types), pa.array([i], pa.int32()), pa.array([pack(part)], pa.binary())], schema=_COUNTED)
    trim()


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


class SmallWorld:
    """A navigable small-world graph of 128-bit codes.

    Nodes are added in growing batches, each searched in the graph so far. A node keeps its
    ``FORWARD`` links for good, its first ``EARLY`` back links (the long ones) and its ``NEAR``
    closest back links.
    """

    FAR = 999

    def __init__(self, codes: np.ndarray):
        self.codes, self.size = codes, 0
        n = len(codes)
        self.adj = np.full((n, FORWARD + EARLY + NEAR), -1, np.int32)
        self.near = np.full((n, NEAR), self.FAR, np.int16)
        self.early = np.zeros(n, np.int32)
        step = 48
        while self.size < n:
            lo, hi = self.size, min(n, self.size + step)
            rows = np.arange(lo, hi)
            if lo == 0:
                d = hamming(codes[rows][:, None], codes[rows][None])
                d[rows, rows] = self.FAR
                ids = np.argsort(d, axis=1, kind="stable")[:, :FORWARD]
                d = np.take_along_axis(d, ids, 1)
            else:
                ids, d = self.search(codes[rows], BEAM)
                ids, d = ids[:, :FORWARD], d[:, :FORWARD]
            d = np.where(ids >= 0, d, self.FAR)
            self.adj[rows, : ids.shape[1]] = np.where(d < self.FAR, ids, -1)
            self._back(np.repeat(rows, ids.shape[1]), ids.ravel(), d.ravel())
            self.size, step = hi, max(48, hi // 2)

    def _back(self, src, dst, d):
        use = d < self.FAR
        src, dst, d = src[use], dst[use], d[use]
        order = np.argsort(dst, kind="stable")
        src, dst, d = src[order], dst[order], d[order]
        rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
        slot = self.early[dst] + rank
        e = slot < EARLY
        self.adj[dst[e], FORWARD + slot[e]] = src[e]
        np.maximum.at(self.early, dst[e], slot[e] + 1)
        src, dst, d = src[~e], dst[~e], d[~e]
        touched = np.unique(dst)
        old = self.adj[touched, FORWARD + EARLY :]
        s = np.concatenate([src, old.ravel()])
        t = np.concatenate([dst, np.repeat(touched, NEAR)])
        w = np.concatenate([d, self.near[touched].ravel()])
        keep = s >= 0
        s, t, w = s[keep], t[keep], w[keep]
        order = np.lexsort((s, w, t))
        s, t, w = s[order], t[order], w[order]
        rank = np.arange(len(t)) - np.searchsorted(t, t)
        k = rank < NEAR
        self.adj[t[k], FORWARD + EARLY + rank[k]] = s[k]
        self.near[t[k], rank[k]] = w[k]

    def search(self, q: np.ndarray, beam: int, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Nearest nodes of each query, with distances, best first, -1 for none. With ``most``, beams whose farthest node is within the radius double up to it."""
        step = max(1, (1 << 22) // max(1, self.size))
        found = [self._search(q[i : i + step], beam) for i in range(0, len(q), step)]
        if not found:
            return np.empty((0, beam), np.int32), np.empty((0, beam), np.int16)
        ids, d = (np.concatenate(x) for x in zip(*found))
        while beam < most and beam < self.size:
            wide = np.flatnonzero(d[:, -1] <= RADIUS)
            beam *= 2
            more = max(0, beam - d.shape[1])
            ids = np.pad(ids, ((0, 0), (0, more)), constant_values=-1)
            d = np.pad(d, ((0, 0), (0, more)), constant_values=self.FAR)
            if not len(wide):
                break
            ids[wide], d[wide] = (x[:, : d.shape[1]] for x in self.search(q[wide], beam))
        return ids, d

    def _search(self, q, beam):
        n, b = self.size, len(q)
        entries = np.unique(np.linspace(0, n - 1, 8).astype(np.int32))
        width = max(beam, len(entries))
        ids = np.full((b, width), -1, np.int32)
        d = np.full((b, width), self.FAR, np.int16)
        open_ = np.zeros((b, width), bool)
        seen = np.full(b * n, -1, np.int32)
        k = len(entries)
        ids[:, :k], d[:, :k], open_[:, :k] = entries, hamming(q[:, None], self.codes[entries][None]), True
        seen[(np.arange(b)[:, None] * n + entries).ravel()] = 0
        rows = np.arange(b)
        while len(rows):
            score = np.where(open_[rows], d[rows], self.FAR)
            pick = np.argpartition(score, 2, axis=1)[:, :3] if width > 3 else np.argsort(score, axis=1)
            ok = np.take_along_axis(score, pick, 1) < self.FAR
            live = ok.any(axis=1)
            rows, pick, ok = rows[live], pick[live], ok[live]
            if not len(rows):
                break
            open_[rows[:, None], pick] = False
            nodes = np.where(ok, ids[rows[:, None], pick], 0)
            nb = self.adj[nodes]
            nb[~ok] = -1
            nb = nb.reshape(len(rows), -1)
            flat = rows[:, None] * n + nb
            r, c = np.nonzero(nb >= 0)
            f = flat[r, c]
            new = seen[f] < 0
            r, c, f = r[new], c[new], f[new]
            stamp = np.arange(len(f), dtype=np.int32)
            seen[f] = stamp
            new = seen[f] == stamp
            r, c = r[new], c[new]
            nd = np.full(nb.shape, self.FAR, np.int16)
            nd[r, c] = hamming(self.codes[nb[r, c]], q[rows[r]])
            all_d = np.concatenate([d[rows], nd], axis=1)
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            d[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(np.concatenate([ids[rows], nb], axis=1), best, 1)
            open_[rows] = np.take_along_axis(np.concatenate([open_[rows], nd < self.FAR], axis=1), best, 1)
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        d = np.take_along_axis(d, order, 1)
        return np.where(d < self.FAR, np.take_along_axis(ids, order, 1), -1), d


def exact(codes: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (query, node, distance) within the radius, block by block."""
    out, step = [], max(1, (1 << 21) // max(1, len(codes)))
    for i in range(0, len(q), step):
        d = hamming(q[i : i + step, None], codes[None])
        r, c = np.nonzero(d <= RADIUS)
        out.append((r + i, c, d[r, c]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


class Part:
    """A shard part: its graph, and the beam that its audit settled on (0: exact search)."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(mix(ids.view(np.uint64), 7), kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        self.graph = SmallWorld(self.codes)
        sample = np.flatnonzero(mix(self.ids.view(np.uint64), 8) % U(AUDIT) == 0)
        self.beam, self.recall = BEAM, 1.0
        # how many each sampled query should find, itself left out; a beam holds MOST at most
        step = max(1, (1 << 21) // max(1, len(self.codes)))
        near = [(hamming(self.codes[sample[i : i + step], None], self.codes[None]) <= RADIUS).sum(axis=1) - 1 for i in range(0, len(sample), step)]
        want = np.minimum(np.concatenate([np.empty(0, np.int64), *near]), MOST - 1)
        while want.any() and self.beam:
            ids, d = self.graph.search(self.codes[sample], self.beam, MOST)
            got = np.minimum(((ids >= 0) & (d <= RADIUS) & (ids != sample[:, None])).sum(axis=1), want)
            self.recall = got.sum() / want.sum()
            if self.recall >= RECALL:
                break
            self.beam = self.beam * 2 if self.beam < MOST else 0

    def _nearest(self, q: np.ndarray):
        """Nodes and distances of each query, nearest first, and the node of the least id among those within the radius."""
        if self.beam:
            nodes, d = self.graph.search(q, self.beam, MOST)
            named = np.where((nodes >= 0) & (d <= RADIUS), self.ids[nodes], np.iinfo(np.int64).max)
            return nodes[:, :LINKS], d[:, :LINKS], np.take_along_axis(nodes, named.argmin(axis=1)[:, None], 1), np.take_along_axis(d, named.argmin(axis=1)[:, None], 1)
        d = hamming(q[:, None], self.codes[None])
        nodes = np.argpartition(d, LINKS - 1, axis=1)[:, :LINKS] if len(self.codes) > LINKS else np.tile(np.arange(len(self.codes)), (len(q), 1))
        least = np.where(d <= RADIUS, self.ids, np.iinfo(np.int64).max).argmin(axis=1)[:, None]
        return nodes, np.take_along_axis(d, nodes, 1), least, np.take_along_axis(d, least, 1)

    def links(self, ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        out, step = [], 4096 if self.beam else max(1, (1 << 20) // len(self.codes))
        for i in range(0, len(ids), step):
            nodes, d, least, far = self._nearest(codes[i : i + step])
            nodes, d = np.concatenate([nodes, least], axis=1), np.concatenate([d, far], axis=1)
            r, c = np.nonzero((nodes >= 0) & (d <= RADIUS))
            out.append((ids[i + r], self.ids[nodes[r, c]], d[r, c]))
        a, b, d = (np.concatenate(x) for x in zip(*out))
        keep = a != b
        a, b, d = a[keep], b[keep], d[keep]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (shard, part), a part's nodes before its queries from elsewhere."""
    key, nodes, part = None, [], None

    def close():
        ids, codes = (np.concatenate(x) for x in zip(*nodes))
        p = Part(ids, codes)
        return p, [p.links(ids[i : i + 4096], codes[i : i + 4096]) for i in range(0, len(ids), 4096)]

    for batch in batches:
        shard, sub, ids, c1, c2, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        codes = np.stack([c1, c2], axis=1).view(np.uint64)
        cut = np.flatnonzero((shard[1:] != shard[:-1]) | (sub[1:] != sub[:-1]) | (asks[1:] != asks[:-1])) + 1
        for lo, hi in zip([0, *cut], [*cut, len(ids)]):
            if lo == hi:
                continue
            now = (shard[lo], sub[lo])
            if now != key:
                if nodes and part is None:
                    yield from close()[1]
                key, nodes, part = now, [], None
            if not asks[lo]:
                nodes.append((ids[lo:hi].copy(), codes[lo:hi].copy()))
                continue
            if part is None:
                part, own = close()
                yield from own
            for i in range(lo, hi, 4096):
                yield part.links(ids[i : min(hi, i + 4096)], codes[i : min(hi, i + 4096)])
    if nodes and part is None:
        yield from close()[1]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links in a partition, those of a spanning forest, closest first."""
    table = pa.Table.from_batches([*batches], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())]))
    table = table.sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
    a, b = table.column(0).to_numpy(), table.column(1).to_numpy()
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    root, keep = list(range(len(names))), np.zeros(len(a), bool)

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)], keep[i] = min(x, y), True
    yield from table.filter(pa.array(keep, pa.bool_())).to_batches()


def _may_be_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of links with their sets' sizes and sketches, those that may have ``SIMILARITY``: at most a ninth of both sizes is in one set only."""
    for batch in batches:
        if batch.num_rows:
            na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
            keep = apart(batch.column("oa"), batch.column("ob")) * 9 <= na + nb
            yield batch.select(["a", "b", "d"]).filter(pa.array(keep))


def _sets(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column(0).to_numpy())))
            for w in blocks(batch.column(1)):
                doc, h = shingles(w)
                off = np.searchsorted(doc, np.arange(w.hi - w.lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.ListArray.from_arrays(off, pa.array(h.view(np.int64)))], names=["id", "h"])

    return run


def _verify(docs: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose shingle sets have Jaccard similarity ``SIMILARITY`` or more. Only sets that a filter of the links' ends lets pass are shuffled."""
    wanted = id_filter(links.select(F.explode(F.array("a", "b")).alias("id")))
    sets = docs.where("id is not null").mapInArrow(_sets(wanted), "id long, h array<long>")
    with_a = links.join(sets.select(F.col("id").alias("a"), F.col("h").alias("ha")), "a")
    both = with_a.join(sets.select(F.col("id").alias("b"), F.col("h").alias("hb")), "b")
    common = F.size(F.array_intersect("ha", "hb"))
    # |A n B| / |A u B| >= 4/5 without rounding
    return both.where(common * 5 >= (F.size("ha") + F.size("hb") - common) * 4).select("a", "b").distinct()


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(id, text)`` to a fingerprint for each text with words, and rows with a ``slice`` of each task's counters."""
    return docs.where("id is not null").select("id", "text").mapInArrow(_counted, _FP_SQL + ", slice int, seen binary")


def candidates(docs: DataFrame, reps: DataFrame, seen: bytes) -> DataFrame:
    """Links ``a < b, d`` found by the shards' graphs or by prefixes that sizes and sketches allow; ``seen`` are all texts' ``counters``."""
    spark = reps.sparkSession
    shards = max(1, reps.count() // PER_SHARD)
    routed = reps.select("id", "c1", "c2", F.posexplode("mins").alias("t", "m")).select(
        (F.pmod("m", F.lit(shards)) * TABLES + F.col("t")).alias("shard"), "id", "c1", "c2"
    )
    hot = routed.groupBy("shard").count().where(F.col("count") > SHARD)
    parts = routed.join(hot, "shard", "left").withColumn("k", F.coalesce(F.ceil(F.col("count") / SHARD), F.lit(1)).cast("int"))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    rows = parts.select("shard", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("sub"), "id", "c1", "c2", "own")
    rows = rows.select("shard", "sub", "id", "c1", "c2", (F.col("sub") != F.col("own")).alias("asks"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "shard", "sub").sortWithinPartitions("shard", "sub", "asks", "id")
    found = rows.mapInArrow(_search_shards, "a long, b long, d int").unionByName(sharing(docs, reps, seen)).groupBy("a", "b").agg(F.min("d").alias("d"))
    # sets of similarity 0.8 or more differ in size by that factor at most
    for end in "ab":
        found = found.join(reps.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("odd").alias(f"o{end}")), end)
    return found.where("least(na, nb) * 5 >= greatest(na, nb) * 4").mapInArrow(_may_be_similar, "a long, b long, d int")


def _sum_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of each slice over all tasks, as steps of their logarithm."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums.setdefault(i, np.zeros(COUNTERS // SLICES, np.int64))
            sums[i] += unpack(body.as_py(), "u4")[0]
    for i, n in sums.items():
        levels = np.minimum(np.rint(STEPS * np.log2(1 + n)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pack(levels)], pa.binary())], names=["slice", "seen"])


def counters(counted: DataFrame) -> bytes:
    """Packed, for each counter, how often its shingles occur in all texts of ``counted``."""
    parts = counted.where("slice is not null").select("slice", "seen")
    levels = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for r in parts.repartition(SLICES, "slice").mapInArrow(_sum_counters, parts.schema).collect():
        levels[r.slice] = unpack(bytes(r.seen), "u1")[0]
    return pack(levels.ravel())


def prefixes(doc: np.ndarray, h: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted (set, shingle) the prefixes: set, shingle, the set's size, place in it."""
    order = np.lexsort((h, seen[(h % U(COUNTERS)).astype(np.int64)], doc))
    h = h[order]
    n = np.bincount(doc)[doc] if len(doc) else doc
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    first = place <= n - (4 * n + 4) // 5
    return doc[first], h[first], n[first], place[first]


def _prefixes(wanted, known, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = unpack(known.value, "u1")[0], [], 0

        def flush():
            h, ids, n, place = (np.concatenate(x) for x in zip(*held))
            return rows([(b, pack(ids[i], h[i], n[i], place[i])) for b, i in split((mix(h, 31) % U(count)).astype(np.int64), count)])

        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column(0).to_numpy())))
            for w in blocks(batch.column(1)):
                doc, h, n, place = prefixes(*shingles(w), seen)
                ids = batch.column(0).to_numpy()[w.lo : w.hi][doc]
                held.append((h, ids, n.astype(np.uint32), place.astype(np.uint32)))
                size += len(h)
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        trim()

    return run


def meetings(h: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets with a shingle in common whose sizes and places allow ``SIMILARITY``, in pieces."""
    order = np.lexsort((ids, n, h))
    h, ids, n, place = h[order], ids[order], n[order].astype(np.int64), place[order].astype(np.int64)
    at, step = np.arange(len(h)), 1
    while True:
        at = at[at + step < len(h)]
        # groups are sorted by size, so what is too long now stays so
        at = at[(h[at + step] == h[at]) & (n[at + step] * 4 <= n[at] * 5)]
        if not len(at):
            return
        to = at + step
        most = np.minimum(n[at] - place[at], n[to] - place[to])
        keep = (ids[at] != ids[to]) & (most * 9 >= (n[at] + n[to]) * 4)
        a, b = ids[at[keep]], ids[to[keep]]
        yield np.minimum(a, b), np.maximum(a, b)
        step += 1


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each bucket; rows come sorted by bucket."""
    now, held = None, []

    def pairs():
        found, size = [], 0
        for x in meetings(*(np.concatenate(x) for x in zip(*held))):
            found.append(x)
            size += len(x[0])
            if size > PAIRS:
                yield batch_of(found)
                found, size = [], 0
        if size:
            yield batch_of(found)

    def batch_of(found):
        a, b = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new]), pa.array(np.full(new.sum(), FARTHEST, np.int32))], names=["a", "b", "d"])

    for batch in batches:
        for b, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != now and held:
                yield from pairs()
                held = []
            now = b
            ids, h, n, place = unpack(body.as_py(), "i8", "u8", "u4", "u4")
            held.append((h, ids, n, place))
    if held:
        yield from pairs()
    trim()


def sharing(docs: DataFrame, reps: DataFrame, seen: bytes) -> DataFrame:
    """Pairs ``a < b, d`` among ``reps`` that meet in a prefix: all of similarity ``SIMILARITY``, and others."""
    spark = docs.sparkSession
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = docs.where("id is not null")
    known = spark.sparkContext.broadcast(seen)
    sent = of.select("id", "text").mapInArrow(_prefixes(id_filter(reps.select("id")), known, count), MESSAGE)
    return sent.repartition(count, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "a long, b long, d int")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, class_id, n_shingles``: for each document the smallest id of its class."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counted = materialize(fingerprints(docs), "simhash")
    fp = counted.where("slice is null").drop("slice", "seen")
    reps = materialize(fp.groupBy("n", "s1", "s2").agg(F.min_by(F.struct("id", "c1", "c2", "mins", "odd"), "id").alias("r")).select("r.*", "n", "s1", "s2"), "reps")
    found = materialize(candidates(docs, reps, counters(counted)), "candidates")
    tasks = min(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + found.count() // FOREST)
    forest = materialize(found.repartition(tasks, "a").mapInArrow(_forest, found.schema), "forest")
    sure = materialize(_verify(docs, forest.select("a", "b")), "verified")
    roots = components(sure)
    left = found.join(forest, ["a", "b"], "left_anti")
    for end in "ab":
        left = left.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    left = materialize(left.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "left")
    if not left.isEmpty():
        roots = components(sure.unionByName(_verify(docs, left)))
    classes = reps.join(roots, reps.id == roots.node, "left").select("n", "s1", "s2", F.coalesce("root", "id").alias("class_id"))
    member = fp.join(classes, ["n", "s1", "s2"]).groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("n").alias("n_shingles"))
    out = docs.select("id").distinct().join(member, "id", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"))


def _pass(filter_, column: int, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(filter_, batch.column(column).to_numpy()) == wanted))

    return run


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, of each class's smallest id, once; rows without an id stay.

    Only rows whose id a filter lets pass (those to go, those that repeat, and a few) are shuffled.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    classes = materialize(near_duplicates(docs, id_col, text_col), "classes")
    gone = classes.where("id <> class_id").select("id")
    twice = ids.groupBy("id").count().where("count > 1").select("id")
    doubt = id_filter(gone.unionByName(twice))
    at = docs.columns.index(id_col)
    rows = docs.where(F.col(id_col).isNotNull())
    clear = rows.mapInArrow(_pass(doubt, at, False), docs.schema)
    check = rows.mapInArrow(_pass(doubt, at, True), docs.schema).join(gone.withColumnRenamed("id", id_col), id_col, "left_anti").select(*docs.columns)
    order = [F.hash(c) for c in docs.columns if c not in (id_col, text_col)]
    once = check.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col), *order))).where("_n = 1").drop("_n")
    return clear.unionByName(once).unionByName(docs.where(F.col(id_col).isNull()))
