"""Quality and toxicity by co-training.

Two views of a document: its text (chosen words' presence, and shares of characters, lines and words) and
its metadata (language, source, length). For each target both views' logistic classifiers are fitted on
labelled rows; in each of ``ROUNDS`` rounds each labels all unlabelled documents, and of what it is sure of (a share
of ``SURE`` right on the calibration fold) rows go as pseudo-labels to the other view's training rows. At last
each view's logit is calibrated on the fold that no round trains on, the calibrated views are combined
there by a logistic fit, and all documents are scored.

Every document's features are written once, packed to some 150 bytes, and read by each round and by the scoring. What
is bounded is what is fitted: ``LABELLED`` labelled rows and, of each target, view and round, ``PSEUDO`` pseudo-labelled
ones, the first by a hash of their id; the driver holds their features, some 60 MB.

Defined results: null text is empty; null metadata is a value of its own; labels that are null or
contradict each other are left out; with one class or none the score is the smoothed share of it
(0.5 without labels). A score of exactly one half counts as good, or toxic. Repeated rows and null ids are kept, a row
each; an id is taken into training once, null ids never. Texts are read whole, whatever their length. Columns of other
names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .messages import trim
from .shared import materialize, small_batches
from .words import LOWER, U, blocks, mix

LABELLED, PSEUDO, ROUNDS, SURE, WORDS = 8000, 1000, 4, 0.97, 400
BITS = 20
META = 32 + 64 + 24
TARGETS = ("quality", "toxic")
OUT = "id long, quality_score double, toxic_score double, text_quality double, meta_quality double"
_OUT = pa.schema([("id", pa.int64()), *((n, pa.float64()) for n in ("quality_score", "toxic_score", "text_quality", "meta_quality"))])
_LETTERS = LOWER.copy()
_LETTERS[[b for b in range(128) if not chr(b).isalpha() and b not in (0x20, *range(9, 14))]] = 0x20


def presence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, word number) pairs; words are lower-cased runs of letters."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    table = bytes(_LETTERS)
    plain = pa.array([x.translate(table) for x in raw.to_pylist()], pa.large_binary())
    out = [np.empty(0, np.int64)]
    for w in blocks(plain):
        h = (w.hashes() >> U(64 - BITS)).astype(np.int64)
        out.append(np.unique(((w.doc_of() + w.lo) << BITS) | h))
    pairs = np.concatenate(out)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _kind(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[ord(c) for c in chars]] = 1
    return t


_KINDS = [_kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789"), _kind("!?"), _kind("#$%&*@^~_=<>\\/+"), _kind("|{}[]()"), _kind(".,;:"), _kind("\n")]
STATS = len(_KINDS) + 7


def statistics(texts: pa.Array) -> np.ndarray:
    """Shares and sizes that don't depend on the language."""
    out = np.zeros((len(texts), STATS), np.float32)
    for w in blocks(texts):
        n = w.hi - w.lo
        counts = np.maximum(1, np.diff(w.docs))
        h, doc = w.hashes(), w.doc_of()
        size = w.ends - w.starts
        text_bytes = np.maximum(1, np.bincount(doc, weights=size, minlength=n))
        words = np.zeros(len(w.data) + 1, np.int64)
        for k, kind in enumerate(_KINDS):
            np.cumsum(kind[w.data], out=words[1:])
            out[w.lo : w.hi, k] = np.bincount(doc, weights=words[w.ends] - words[w.starts], minlength=n) / text_bytes
        order = np.lexsort((h, doc))
        same = np.zeros(len(h), bool)
        same[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (h[order[1:]] == h[order[:-1]])
        pair = np.append((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]), False) if len(h) else np.empty(0, bool)
        k = len(_KINDS)
        out[w.lo : w.hi, k] = np.bincount(doc[same], minlength=n) / counts
        out[w.lo : w.hi, k + 1] = np.bincount(doc[pair], minlength=n) / counts
        out[w.lo : w.hi, k + 2] = np.log1p(counts) / 5
        mean = text_bytes / counts
        out[w.lo : w.hi, k + 3] = np.minimum(mean, 50) / 10
        var = np.bincount(doc, weights=size.astype(float) ** 2, minlength=n) / counts - mean**2
        out[w.lo : w.hi, k + 4] = np.sqrt(np.clip(var, 0, 400)) / 5
        out[w.lo : w.hi, k + 5] = np.diff(w.docs) < 5
        # words that hold no letter at all, such as table bars
        np.cumsum((_LETTERS != 0x20)[w.data], out=words[1:])
        out[w.lo : w.hi, k + 6] = np.bincount(doc, weights=words[w.ends] == words[w.starts], minlength=n) / counts
    return out


def metadata(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Numbers of the hashed one-hot columns that are set, three a row."""
    number = lambda x, n: xxhash.xxh32_intdigest("" if x is None else "=" + x) % n
    columns = ([number(x, 32) for x in lang], [32 + number(x, 64) for x in source], [96 + (23 if x is None else min(22, int(max(0, x)).bit_length())) for x in n_chars])
    return np.array(columns, np.uint8).reshape(3, -1).T


def _one_hot(numbers: np.ndarray) -> np.ndarray:
    out = np.zeros((len(numbers), META), np.float32)
    out[np.arange(len(numbers))[:, None], numbers] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """L2-regularised logistic regression by accelerated gradient descent."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray = field(default=None)
    b: float = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, l2: float = 3.0, steps: int = 120) -> Logistic:
        z = (x - self.mean) / self.scale
        n = len(y)
        v = np.random.default_rng(0).normal(size=z.shape[1]).astype(z.dtype)
        for _ in range(12):
            v = z.T @ (z @ v)
            v /= np.linalg.norm(v) or 1
        lip = 0.25 * (float(v @ (z.T @ (z @ v))) + n) + l2
        w = np.zeros(z.shape[1]) if self.w is None else self.w
        b, pw, pb = self.b, w, self.b
        for t in range(steps):
            k = t / (t + 3)
            yw, yb = w + k * (w - pw), b + k * (b - pb)
            g = _sigmoid(z @ yw.astype(z.dtype) + yb) - y
            pw, pb = w, b
            w = yw - (z.T @ g.astype(z.dtype) + l2 * yw) / lip
            b = yb - g.sum() / lip
        self.w, self.b = w, float(b)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w.astype(np.float32) + self.b


def _line(x: np.ndarray, y: np.ndarray) -> Logistic:
    """A small logistic fit, for calibration and combination."""
    x = x.reshape(len(y), -1).astype(np.float64)
    return Logistic(x.mean(axis=0), x.std(axis=0) + 1e-9).fit(x, y, l2=0.5, steps=300)


@dataclass
class Target:
    """Calibrated views of one target and their combination; ``share`` where nothing can be fitted."""

    share: float
    views: list = None
    scales: list = None
    joint: Logistic = None

    def scores(self, xs: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        if self.joint is None:
            p = np.full(len(xs[0]), self.share)
            return p, [p, p]
        z = [s.logit(v.logit(x)[:, None].astype(np.float64)) for v, s, x in zip(self.views, self.scales, xs)]
        return _sigmoid(self.joint.logit(np.stack(z, axis=1))), [_sigmoid(a) for a in z]


class Training:
    """One target's labelled rows, and the rows that each view is fitted on."""

    def __init__(self, xs: list[np.ndarray], y: np.ndarray, fold: np.ndarray):
        """``xs``: both views' features of labelled rows; ``y``: 1, 0, or nan; ``fold``: rows kept for calibration."""
        known = ~np.isnan(y)
        train, held = np.flatnonzero(known & ~fold), np.flatnonzero(known & fold)
        self.share = float((np.nansum(y) + 1) / (known.sum() + 2))
        self.can = min(len(set(y[train])), len(set(y[held]))) > 1
        self.held, self.y_held = [x[held] for x in xs], y[held]
        self.rows, self.labels = [[x[train]] for x in xs], [[y[train]], [y[train]]]
        self.views = [Logistic(r[0].mean(axis=0), r[0].std(axis=0) + 0.05) for r in self.rows] if self.can else []
        self.taken = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def step(self, first: bool) -> None:
        for i, v in enumerate(self.views):
            v.fit(np.concatenate(self.rows[i]), np.concatenate(self.labels[i]), steps=120 if first else 50)

    def cuts(self) -> np.ndarray:
        """[view, class]: from which logit on, away from the other class, a view is sure."""
        z = [v.logit(x) for v, x in zip(self.views, self.held)]
        return np.array([[_cut((1, -1)[k] * a, self.y_held == 1 - k) for k in (0, 1)] for a in z])

    def limits(self) -> list[int]:
        """Rows of each class that go over in a round, in the classes' proportion."""
        one = int(np.ceil(PSEUDO * self.share))
        return [one, max(1, PSEUDO - one)]

    def add(self, view: int, ids: np.ndarray, x: np.ndarray, label: float) -> None:
        self.rows[view].append(x)
        self.labels[view].append(np.full(len(x), label))
        self.taken[view] = np.concatenate([self.taken[view], ids])

    def finish(self) -> Target:
        if not self.can:
            return Target(self.share)
        z = [v.logit(x)[:, None] for v, x in zip(self.views, self.held)]
        scales = [_line(a, self.y_held) for a in z]
        joint = _line(np.stack([s.logit(a.astype(np.float64)) for s, a in zip(scales, z)], axis=1), self.y_held)
        return Target(self.share, self.views, scales, joint)


def _cut(z: np.ndarray, right: np.ndarray) -> float:
    """The least logit from which on a share of ``SURE`` is right, given 20 rows at least; infinite if there is none."""
    order = np.argsort(-z, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(z) + 1)
    at = np.flatnonzero((good >= SURE) & (np.arange(len(z)) >= 19))
    return float(z[order[at[-1]]]) if len(at) else np.inf


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, word = presence(batch.column(1))
        off = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
        stats = statistics(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(off, pa.array(word, pa.int32())), pa.array(stats.tolist(), pa.list_(pa.float32())), *batch.columns[2:]],
            names=["id", "words", "stats", *batch.schema.names[2:]],
        )


def choose(words: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The words whose presence differs most between a target's classes, by z score."""
    size = 1 << BITS
    n1, n0 = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    count = lambda v: np.bincount(np.concatenate([np.empty(0, np.int64), *[w for w, k in zip(words, y) if k == v]]).astype(np.int64), minlength=size)
    c1, c0 = count(1), count(0)
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    z[c1 + c0 < 4] = 0
    top = np.argsort(-z, kind="stable")[:WORDS]
    return np.sort(top[z[top] > 3.5])


def _presence(number: np.ndarray, rows: int, doc: np.ndarray, word: np.ndarray, width: int) -> np.ndarray:
    x = np.zeros((rows, width), bool)
    at = number[word]
    x[doc[at >= 0], at[at >= 0]] = True
    return x


class Layout:
    """Features of a document in bytes: chosen words' bits of each target, statistics, metadata."""

    def __init__(self, chosen: list[np.ndarray]):
        self.chosen = chosen
        self.bits = [-(-len(c) // 8) for c in chosen]
        self.width = sum(self.bits) + 4 * STATS + 3

    def numbers(self) -> list[np.ndarray]:
        out = []
        for c in self.chosen:
            n = np.full(1 << BITS, -1, np.int32)
            n[c] = np.arange(len(c))
            out.append(n)
        return out

    def pack(self, doc: np.ndarray, word: np.ndarray, stats: np.ndarray, meta: np.ndarray, numbers: list[np.ndarray]) -> np.ndarray:
        parts = [np.packbits(_presence(n, len(stats), doc, word, len(c)), axis=1) for n, c in zip(numbers, self.chosen)]
        return np.ascontiguousarray(np.concatenate([*parts, np.ascontiguousarray(stats, np.float32).view(np.uint8).reshape(len(stats), 4 * STATS), meta], axis=1))

    def views(self, raw: np.ndarray) -> list[list[np.ndarray]]:
        """Of each target both views."""
        at, out = sum(self.bits), []
        stats = np.ascontiguousarray(raw[:, at : at + 4 * STATS]).view(np.float32)
        meta, lo = _one_hot(raw[:, -3:]), 0
        for c, b in zip(self.chosen, self.bits):
            words = np.unpackbits(raw[:, lo : lo + b], axis=1)[:, : len(c)].astype(np.float32)
            out.append([np.concatenate([words, stats], axis=1), meta])
            lo += b
        return out

    def read(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), self.width)


def _features(layout: Layout):
    """Rows (id, pool, text, lang, source, n_chars) to (id, pool, packed features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = layout.numbers()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                doc, word = presence(part.column(2))
                raw = layout.pack(doc, word, statistics(part.column(2)), metadata(*(part.column(i).to_pylist() for i in (3, 4, 5))), numbers)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in raw], pa.binary())], names=["id", "pool", "f"])
        trim()

    return run


def _sure(layout: Layout, asked, salt: int):
    """Of the pool what views are sure of: ``kind`` (target, view, class), the rows of least ``key`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), layout.read(batch.column(1))
            keys = (mix(ids.view(np.uint64), salt) >> U(1)).astype(np.int64)
            views = layout.views(raw)
            for t, views_of, cuts, limits, taken in asked.value:
                for i, v in enumerate(views_of):
                    z = v.logit(views[t][i])
                    for k in (0, 1):
                        pick = np.flatnonzero(((1, -1)[k] * z >= cuts[i, k]) & ~np.isin(ids, taken[1 - i]))
                        if not len(pick):
                            continue
                        kind = 4 * t + 2 * i + k
                        new = (keys[pick], ids[pick], raw[pick])
                        key, name, f = (np.concatenate(x) for x in zip(held[kind], new)) if kind in held else new
                        _, first = np.unique(np.stack([key, name], axis=1), axis=0, return_index=True)
                        first = first[: limits[k]]
                        held[kind] = (key[first], name[first], f[first])
        for kind, (key, name, f) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(name), pa.array([x.tobytes() for x in f], pa.binary())], names=["kind", "key", "id", "f"])
        trim()

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Layout, list[Target], DataFrame]:
    """The features' layout, each target's classifiers, and the features of all rows."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    known = labels.where("id is not null").groupBy("id").agg(*(F.when(F.min(t) == F.max(t), F.min(t)).alias(t) for t in TARGETS)).where("quality is not null or toxic is not null")
    known = materialize(known, "labels")
    taken = known.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(LABELLED)
    table = spark.createDataFrame([tuple(r) for r in taken.collect()], "id long, quality int, toxic int")
    features = docs.join(F.broadcast(table), "id").select("id", "text", "lang", "source", "n_chars", *TARGETS)
    schema = f"id long, words array<int>, stats array<float>, lang string, source string, n_chars long, {', '.join(f'{t} int' for t in TARGETS)}"
    data = features.mapInArrow(_sample, schema).dropDuplicates(["id"]).toArrow().sort_by("id")
    words = [np.array(x, np.int64) for x in data.column("words").to_pylist()]
    stats = np.array(data.column("stats").to_pylist(), np.float32).reshape(len(words), STATS)
    meta = metadata(*(data.column(c).to_pylist() for c in ("lang", "source", "n_chars")))
    doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
    word = np.concatenate([np.empty(0, np.int64), *words]).astype(np.int64)
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % 4 == 0 for i in data.column("id").to_pylist()], bool)
    ys = [np.array([np.nan if v is None else float(v > 0) for v in data.column(t).to_pylist()], np.float64) for t in TARGETS]
    layout = Layout([choose([w for w, f in zip(words, fold) if not f], y[~fold]) for y in ys])
    views = layout.views(layout.pack(doc, word, stats, meta, layout.numbers()))
    targets = [Training(x, y, fold) for x, y in zip(views, ys)]
    packed = docs.select("id", F.col("id").isNotNull().alias("pool"), "text", "lang", "source", "n_chars").mapInArrow(_features(layout), "id long, pool boolean, f binary")
    packed = materialize(packed, "features")
    pool = materialize(packed.where("pool").select("id", "f").join(known.select("id"), "id", "left_anti"), "pool")
    for r in range(ROUNDS + 1):
        able = [(t, x) for t, x in enumerate(targets) if x.can]
        for _, x in able:
            x.step(r == 0)
        if r == ROUNDS or not able:
            break
        asked = sc.broadcast([(t, x.views, x.cuts(), x.limits(), x.taken) for t, x in able])
        sure = pool.mapInArrow(_sure(layout, asked, 70 + r), "kind int, key long, id long, f binary")
        w = Window.partitionBy("kind").orderBy("key", "id")
        found = sure.dropDuplicates(["kind", "id"]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= PSEUDO).toArrow()
        kinds = found.column("kind").to_numpy()
        for t, x in able:
            for i in (0, 1):
                for k in (0, 1):
                    mine = found.filter(pa.array(kinds == 4 * t + 2 * i + k)).sort_by("n").slice(0, x.limits()[k])
                    if mine.num_rows:
                        x.add(1 - i, mine.column("id").to_numpy(), layout.views(layout.read(mine.column("f")))[t][1 - i], 1.0 - k)
    return layout, [x.finish() for x in targets], packed


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, targets = model.value
        for batch in batches:
            views = layout.views(layout.read(batch.column(1)))
            found = [target.scores(x) for target, x in zip(targets, views)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(x, np.float64)) for x in (found[0][0], found[1][0], *found[0][1]))], schema=_OUT)

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of each row of ``docs(doc_id, text, lang, source, n_chars)``, learned from ``labels(doc_id, quality, toxic)``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    labels = labels.select(F.col("doc_id").cast("long").alias("id"), *(F.col(t).cast("int").alias(t) for t in TARGETS))
    layout, targets, features = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((layout, targets))
    return features.select("id", "f").mapInArrow(_score(model), OUT)
