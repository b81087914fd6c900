"""Language-model scores by interpolated modified Kneser-Ney (Chen and Goodman, 1999), of any order from 2 on.

Counting: each task adds up its texts' n-grams of the highest order; they meet packed in the bucket of their
context (the words before), which sums them and writes sorted hash arrays with counts, and the statistics
of each context. Its distinct n-grams go on without their first word to the bucket of the shorter context, as one
more word seen before each; so down to single words. An n-gram that begins with the text's beginning has no longer
one and keeps its plain count, as usual. The n-grams of frequent contexts are spread over several buckets each.
A word is a 56-bit hash, or a small number if it is one of the ``FREQUENT`` that a sample of the rows knows; that only
makes messages small. Files are written under another name and then renamed, so a task that runs twice does no harm.

Arrays: keys are 64-bit hashes, sorted. Their leading bits, about as many as the number of keys over ``RUN``, are told by
offsets, the 24 bits after them are stored; so an entry takes three bytes and a part of a fourth, and another n-gram is
taken for it with a chance of ``RUN`` in 2^24. Values are a byte, or half of one for n-grams: a number in the file's list
of frequent ones, or else they stand whole at the file's end.

Scoring: workers map the arrays into memory and look sorted keys up. The folder is the shared one; the
workers must see it as a file system. A file or a count that is missing is an error.

Defined results: null text has the end token only; rows without an id are learned from; with nothing
learned every token has probability 1. Repeated rows are kept, and counted as often. Texts are read whole, whatever their
length. Columns other than id and text are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import remainder
from .messages import MESSAGE, pack, rows, split, trim, unpack
from .shared import local_path, shared_dir, small_batches
from .words import LOWER, U, blocks, mix

BEGIN, END = U(0x1B873593CC9E2D51), U(0xE6546B6485EBCA6B)
HOT, SAMPLED = 8, 64
#: Numbered words; 0 stands before a text's beginning, 1 is the beginning, 2 the end.
FREQUENT, RUN = 65_000, 16
FLUSH, MERGE, TOKENS = 2_500_000, 4_000_000, 1_000_000
MASK = U((1 << 56) - 1)
OUT = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


class Codes:
    """Words' hashes to numbers for frequent ones."""

    def __init__(self, frequent: np.ndarray):
        ends = np.array([BEGIN & MASK, END & MASK], np.uint64)
        rest = np.setdiff1d(frequent, ends)
        self.hashes = np.concatenate([ends, rest])
        order = np.argsort(self.hashes)
        self.sorted, self.numbers = self.hashes[order], (order + 1).astype(np.uint64)
        self.start = np.searchsorted(self.sorted, np.arange((1 << 17) + 1, dtype=np.uint64) << U(39)).astype(np.int32)

    def of(self, h: np.ndarray) -> np.ndarray:
        """Others get a bit above all numbers."""
        out, top = h | U(1 << 60), (h >> U(39)).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.sorted[at] == h[live]
            out[live[hit]] = self.numbers[at[hit]]
            more = np.flatnonzero(~hit & (at + 1 < end))
            live, at, end = live[more], at[more] + 1, end[more]
        return out


def grams(w, order: int, codes: Codes) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each token of a block, the end tokens included: the words before, farthest first and 0 before the beginning, and the word; the text. Words are codes."""
    h, n = codes.of(w.hashes(LOWER) & MASK), w.hi - w.lo
    word = np.full(len(h) + n, 2, np.uint64)
    word[np.arange(len(h)) + w.doc_of()] = h
    size = np.diff(w.docs) + 1
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    out = [word]
    for k in range(1, order):
        before = np.zeros_like(word)
        before[k:] = word[:-k]
        before[at == k - 1] = 1
        before[at < k - 1] = 0
        out.insert(0, before)
    return out, np.repeat(np.arange(n), size)


def key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(before, 51) ^ word, 52)


def context(words: list[np.ndarray]) -> np.ndarray:
    """One key of the words before."""
    return reduce(key, words)


class Buckets:
    """Buckets of pairs and words; ``hot`` are words before that take several buckets."""

    def __init__(self, count: int, hot: np.ndarray, spread: np.ndarray):
        self.count, self.hot, self.spread = count, hot, spread

    def of_word(self, word: np.ndarray) -> np.ndarray:
        return (mix(word, 61) % U(self.count)).astype(np.int64)

    def find_hot(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are hot, and their numbers."""
        if not len(self.hot):
            return np.zeros(len(before), bool), np.zeros(len(before), np.int64)
        at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
        return self.hot[at] == before, at

    def of_pair(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        b = mix(before, 62) % U(self.count)
        is_hot, at = self.find_hot(before)
        if is_hot.any():
            b[is_hot] = (b[is_hot] + mix(word[is_hot], 63) % self.spread[at[is_hot]]) % U(self.count)
        return b.astype(np.int64)


def _distinct(x: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each value occurs, in their order, and for each entry the number of its value. By another order, values that aren't neighbours count apart."""
    order = np.argsort(x) if order is None else order
    own = x[order]
    new = np.ones(len(x), bool)
    new[1:] = own[1:] != own[:-1]
    index = np.empty(len(x), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


def _order(x: np.ndarray) -> np.ndarray:
    """An order by the leading bits; the place stands in the others, as a plain sort takes a fourth of ``argsort``'s time."""
    bits = U(len(x).bit_length())
    return (np.sort((x >> bits << bits) | np.arange(len(x), dtype=np.uint64)) & ((U(1) << bits) - U(1))).astype(np.int64)


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """One number for each n-gram, in the order of the keys."""
    far = [np.flatnonzero(k >= U(1 << 16)) for k in keys]
    others = np.concatenate([k[i] for k, i in zip(keys, far)])
    place, number = _distinct(others)
    bits, used, done, out = int((1 << 16) + len(place)).bit_length(), 0, 0, np.zeros(len(keys[0]), np.uint64)
    for k, i in zip(keys, far):
        code = k.copy()
        code[i] = number[done : done + len(i)].astype(np.uint64) + U(1 << 16)
        done += len(i)
        if used + bits > 64:
            out = _distinct(out)[1].astype(np.uint64)
            used = len(out).bit_length()
        out, used = (out << U(bits)) | code, used + bits
    return out


def _sum(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums by the keys, in their order."""
    one = _ranked(keys)
    order = np.argsort(one)
    one = one[order]
    new = np.ones(len(one), bool)
    new[1:] = one[1:] != one[:-1]
    at = np.flatnonzero(new)
    first = order[at]
    return [k[first] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _low_bytes(x: np.ndarray) -> np.ndarray:
    """The low seven bytes of each value, as a column that ``pack`` cuts in planes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :7].copy().view("V7").ravel()


def _from_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :7] = x.view(np.uint8).reshape(-1, 7)
    return out.view(np.uint64).ravel()


def _messages(to: Buckets, bucket: np.ndarray, keys: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
    """N-grams with values, packed for their buckets: numbers and values in columns, then the hashes of the other words in their order."""
    codes, values = [np.minimum(k, U(0xFFFF)).astype(np.uint16) for k in keys], [v.astype(np.uint32) for v in values]
    items = []
    for b, i in split(bucket, to.count):
        own = [c[i] for c in codes]
        body = pack(*own, *(v[i] for v in values), level=3)
        others = np.concatenate([k[i[c == 0xFFFF]] for k, c in zip(keys, own)])
        items.append((b, len(body).to_bytes(4, "little") + body + pack(_low_bytes(others & MASK))))
    return rows(items)


def _reader(order: int, values: int):
    def read(body):
        size = int.from_bytes(body[:4], "little")
        columns = unpack(body[4 : 4 + size], *["u2"] * order, *["u4"] * values)
        others, at, keys = _from_bytes(unpack(body[4 + size :], "V7")[0]) | U(1 << 60), 0, []
        for c in columns[:order]:
            k, far = c.astype(np.uint64), np.flatnonzero(c == 0xFFFF)
            k[far] = others[at : at + len(far)]
            at += len(far)
            keys.append(k)
        return keys, [v.astype(np.int64) for v in columns[order:]]

    return read


def _count(to: Buckets, order: int, codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            keys = [np.concatenate(x) for x in zip(*held)]
            keys, values = _sum(keys, [np.ones(len(keys[0]), np.int64)])
            return _messages(to, to.of_pair(context(keys[:-1]), keys[-1]), keys, values)

        for batch in batches:
            for w in blocks(batch.column(0)):
                x, _ = grams(w, order, codes)
                held.append(x)
                n += len(x[0])
                if n * order > 2 * FLUSH:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        trim()

    return run


def _save(path: str, array: np.ndarray) -> None:
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, array)
    os.replace(part, path)


class Table:
    """A file of sorted keys with rows of values, mapped into memory."""

    @staticmethod
    def write(path: str, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        keys, values = keys[order], np.ascontiguousarray(values[order], np.int64)
        n, width = values.shape
        bits = max(0, int(np.ceil(np.log2(max(1, n / RUN)))))
        top = (keys >> U(64 - bits)).astype(np.int64) if bits else np.zeros(n, np.int64)
        offsets = np.searchsorted(top, np.arange((1 << bits) + 1)).astype(np.uint32)
        rest = ((keys << U(bits)) >> U(40)).astype(np.uint32)
        # a row as one number; rows with a number too large for that stand whole
        bits_each = 64 // width
        one = reduce(lambda x, y: (x << U(bits_each)) | y, values.view(np.uint64).T) if width > 1 else values.view(np.uint64)[:, 0]
        fits = np.flatnonzero((values >> (bits_each - 1) == 0).all(axis=1))
        place, number = _distinct(one[fits])
        none = 15 if width == 1 else 255
        first = np.argsort(-np.bincount(number, minlength=len(place)), kind="stable")[:none]
        code = np.full(len(place), none, np.uint8)
        code[first] = np.arange(len(first))
        kinds, own = values[fits[place]], code[number]
        code = np.full(n, none, np.uint8)
        code[fits] = own
        whole = np.flatnonzero(code == none)
        if width == 1:
            code = np.append(code, np.zeros(n % 2, np.uint8))
            code = code[::2] | (code[1::2] << 4)
        head = np.array([n, width, bits, len(first), len(whole)], np.int64)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            for x in (head, kinds[first], whole.astype(np.int64), values[whole], offsets, (rest >> 8).astype(np.uint16), (rest & 255).astype(np.uint8), code):
                f.write(np.ascontiguousarray(x).tobytes())
        os.replace(part, path)

    def __init__(self, path: str):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        self.n, width, self.bits, kinds, whole = np.frombuffer(raw[:40], np.int64).tolist()
        at = 40

        def take(count, dtype):
            nonlocal at
            size = count * np.dtype(dtype).itemsize
            out = raw[at : at + size].view(dtype)
            at += size
            return out

        # one row more for the code of those that stand whole
        self.values = np.append(take(kinds * width, np.int64), np.zeros(width, np.int64)).reshape(-1, width)
        self.whole_at, self.whole = take(whole, np.int64), take(whole * width, np.int64).reshape(-1, width)
        self.offsets, self.high, self.low, self.code = take((1 << self.bits) + 1, np.uint32), take(self.n, np.uint16), take(self.n, np.uint8), take((self.n + 1) // 2 if width == 1 else self.n, np.uint8)
        self.width = width

    def find(self, k: np.ndarray) -> np.ndarray:
        """Values of keys, best sorted; 0 for those that aren't there."""
        out = np.zeros((len(k), self.width), np.int64)
        if not self.n:
            return out
        top = (k >> U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(k), np.int64)
        lo, end = self.offsets.take(top).astype(np.int64), self.offsets.take(top + 1).astype(np.int64)
        rest = ((k << U(self.bits)) >> U(40)).astype(np.uint32)
        high, low = (rest >> 8).astype(np.uint16), (rest & 255).astype(np.uint8)
        for i in range(int((end - lo).max(initial=0)).bit_length() - 1, -1, -1):
            at = lo + ((1 << i) - 1)
            less = self.high.take(at, mode="clip") < high
            less &= at < end
            lo += less.astype(np.int64) << i
        live = np.arange(len(k))
        while len(live):
            live = live[lo[live] < end[live]]
            at = lo[live]
            same = self.high.take(at) == high[live]
            hit = same & (self.low.take(at) == low[live])
            found, place = live[hit], at[hit]
            code = (self.code[place >> 1] >> ((place & 1) << 2).astype(np.uint8)) & 15 if self.width == 1 else self.code[place]
            out[found] = self.values[np.minimum(code, len(self.values) - 1)]
            far = code == (15 if self.width == 1 else 255)
            if far.any():
                out[found[far]] = self.whole[np.searchsorted(self.whole_at, place[far])]
            live = live[same & ~hit]
            lo[live] += 1
        return out


def _by_bucket(batches: Iterator[pa.RecordBatch], read):
    """Sums of each bucket of a partition whose rows come sorted by bucket."""
    now, held, n = None, [], 0

    def merged():
        keys, values = ([np.concatenate(y) for y in zip(*x)] for x in zip(*held))
        return _sum(keys, values)

    for batch in batches:
        for b, body in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != now and held:
                yield now, merged()
                held, n = [], 0
            now = b
            x = read(body.as_py())
            held.append(x)
            n += len(x[0][0])
            if n * len(x[0]) > 2 * MERGE:
                held = [merged()]
                n = len(held[0][0][0]) // 2
    if held:
        yield now, merged()


def _write_grams(to: Buckets, lower: Buckets | None, folder: str, order: int, values: int):
    """Files of the n-grams of an order, which go on without their first word: to buckets of ``lower``, or of single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, (keys, counts) in _by_bucket(batches, _reader(order, values)):
            # in order, so those that begin before the text come first, and those of one context stand together
            real = int(np.searchsorted(keys[0], U(1)))
            own, mine = [k[real:] for k in keys[:-1]], counts[0][real:]
            new = np.ones(len(mine), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in own], axis=0)
            at = np.flatnonzero(new)
            own = context([k[at] for k in own])
            before = np.repeat(own, np.diff(np.append(at, len(mine))))
            Table.write(f"{folder}/grams{order}-{b}", key(before, keys[-1][real:]), mine[:, None])
            parts = [mine, *((mine == i).astype(np.int64) for i in (1, 2)), (mine > 2).astype(np.int64)]
            stats = np.stack([np.add.reduceat(x, at) if len(at) else x for x in parts], axis=1)
            Table.write(f"{folder}/before{order}-{b}", own, stats)
            hot = to.find_hot(own)[0]
            _save(f"{folder}/hot{order}-{b}.npy", np.concatenate([own[hot][:, None].view(np.int64), stats[hot]], axis=1))
            _save(f"{folder}/sums{order}-{b}.npy", np.array([counts[-1].sum(), len(mine), *((mine == i).sum() for i in (1, 2, 3, 4))], np.int64))
            # as many words before as n-grams, or the plain count at a text's beginning; with it the plain count
            kinds = np.ones_like(counts[0])
            kinds[:real] = counts[0][:real]
            keys, sums = _sum(keys[1:], [kinds, counts[-1]])
            bucket = lower.of_pair(context(keys[:-1]), keys[-1]) if lower else to.of_word(keys[0])
            yield _messages(to, bucket, keys, sums)
            trim()

    return run


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, ((w,), (types, count)) in _by_bucket(batches, _reader(1, 2)):
            Table.write(f"{folder}/words-{b}", mix(w, 64), np.stack([types, count], axis=1))
            sums = [len(w), types.sum(), count.sum(), *((types == i).sum() for i in (1, 2, 3, 4))]
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([[int(x) for x in sums]], pa.list_(pa.int64()))], names=["bucket", "sums"])
            trim()

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more; where counts of counts are missing, 0.5, 1 and 1.5 at most."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [i - (i + 1) * y * (b / a) if a else i / 2 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(float(min(max(x, 0.0), i)) for i, x in enumerate(d, 1))


class Model:
    """A model's arrays, mapped into memory."""

    def __init__(self, spec: dict):
        self.spec, self.to = spec, {n: Buckets(spec["count"], *x) for n, x in spec["hot"].items()}
        self.codes, self.files = Codes(spec["frequent"]), {}

    def _look(self, kind: str, bucket: np.ndarray, k: np.ndarray, width: int) -> np.ndarray:
        """Values of keys, bucket by bucket, 0 for those that aren't there."""
        out, bits = np.zeros((len(k), width), np.int64), self.spec["count"].bit_length()
        order = _order((bucket.astype(np.uint64) << U(64 - bits)) | (k >> U(bits)))
        cuts = np.searchsorted(bucket[order], np.arange(self.spec["count"] + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            if b not in self.spec["buckets"][kind]:
                continue
            if (kind, b) not in self.files:
                self.files[kind, b] = Table(f"{self.spec['folder']}/{kind}-{b}")
            i = order[cuts[b] : cuts[b + 1]]
            out[i] = self.files[kind, b].find(k[i])
        return out

    def _stats(self, n: int, contexts: np.ndarray) -> np.ndarray:
        """Statistics of contexts of an order."""
        out = self._look(f"before{n}", (mix(contexts, 62) % U(self.spec["count"])).astype(np.int64), contexts, 4)
        is_hot, at = self.to[n].find_hot(contexts)
        if is_hot.any():
            out[is_hot] = self.spec["hot_stats"][n][at[is_hot]]
        return out

    def score(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token of whole texts, its words before and itself: its count, log10 of its base and model probability. Words, contexts and n-grams of lower orders are looked up once each."""
        s, to = self.spec, self.to
        hashed = mix(words[-1], 64)
        place, index = _distinct(hashed, _order(hashed))
        single = words[-1][place]
        types, count = self._look("words", to[2].of_word(single), hashed[place], 2).T
        base = np.log10((count + 1) / (s["tokens"] + s["words"] + 1))[index]
        d = np.array([0.0, *s["d"][1]])
        p = ((types - d[np.minimum(types, 3)]) / max(1, s["pairs"]) + s["rest"] / (s["words"] + 1))[index]
        count = count[index]
        # the words before a token are the shorter n-gram of the token before it; the last context is a text's beginning
        contexts, before = np.append(single, U(1)), words[-2]
        index = np.append(len(single), index[:-1])
        index[before == U(1)] = len(single)
        for n in range(2, s["order"] + 1):
            has = words[-n] != 0
            every = has.all()
            word = words[-1]
            if not every:
                has = np.flatnonzero(has)
                before, index, word = before[has], index[has], word[has]
            grams = key(before, word)
            if n < s["order"]:
                place, own_index = _distinct(grams, _order(grams))
                own = self._look(f"grams{n}", to[n].of_pair(before[place], word[place]), grams[place], 1)[:, 0]
            else:
                own, own_index = self._look(f"grams{n}", to[n].of_pair(before, word), grams, 1)[:, 0], slice(None)
            stats = self._stats(n, contexts)
            d = np.array([0.0, *s["d"][n]])
            # once for each context, and without the linear algebra library, whose threads wait busily
            seen = np.maximum(stats[:, 0], 1)
            back = np.where(stats[:, 0] > 0, (stats[:, 1] * d[1] + stats[:, 2] * d[2] + stats[:, 3] * d[3]) / seen, 1.0)
            more = (own - d[np.minimum(own, 3)])[own_index] / seen[index]
            if every:
                p = more + back[index] * p
            else:
                p[has] = more + back[index] * p[has]
            if n < s["order"]:
                contexts = grams[place]
                if every:
                    before, index = np.append(U(0), grams[:-1]), np.append(0, own_index[:-1])
                else:
                    before, index = np.zeros(len(p), np.uint64), np.zeros(len(p), np.int64)
                    after = has[has < len(p) - 1] + 1
                    before[after], index[after] = grams[: len(after)], own_index[: len(after)]
        with np.errstate(divide="ignore"):
            return count, base, np.log10(p)


_models: dict[str, Model] = {}


def _model(folder: str, spec) -> Model:
    """The worker's model; the one before is let go."""
    if folder not in _models:
        _models.clear()
        _models[folder] = Model(spec.value)
    return _models[folder]


def _score(spec, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(folder, spec)
        held, n = [], 0

        def flush():
            words = [np.concatenate(x) for x in zip(*(x[1] for x in held))]
            size = np.concatenate([x[2] for x in held])
            doc = np.repeat(np.arange(len(size)), size)
            count, base, score = m.score(words)
            sums = [np.bincount(doc, weights=x, minlength=len(size)) for x in (count > 0, base, score)]
            ids = pa.concat_arrays([x[0] for x in held])
            return pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(size), m.spec["tokens"])), pa.array(sums[1]), pa.array(sums[2])], schema=_OUT)

        for batch in batches:
            for w in blocks(batch.column(1)):
                x, _ = grams(w, m.spec["order"], m.codes)
                held.append((batch.column(0).slice(w.lo, w.hi - w.lo), x, np.diff(w.docs) + 1))
                n += len(x[0])
                if n > TOKENS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        trim()

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts, block by block."""
    for batch in batches:
        for w in blocks(batch.column(0)):
            v, c = np.unique(w.hashes(LOWER) & MASK, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(c.astype(np.int64))], names=["v", "c"])


def _tops(order: int, codes: Codes):
    """The most frequent contexts of each order of a partition, with their shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, {n: {} for n in range(2, order + 1)}
        for batch in batches:
            for w in blocks(batch.column(0)):
                words, _ = grams(w, order, codes)
                total += len(words[0])
                for n, found in sums.items():
                    v, c = np.unique(context(words[-n:-1]), return_counts=True)
                    for k in np.argsort(-c)[:256].tolist():
                        found[int(v[k])] = found.get(int(v[k]), 0) + int(c[k])
        for n, found in sums.items():
            top = sorted(found.items(), key=lambda x: -x[1])[:1024]
            v, c = np.array([k for k, _ in top], np.uint64).view(np.int64), np.array([c for _, c in top], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(top), pa.int32()), pa.array(v), pa.array(c), pa.array([total if not i else 0 for i in range(len(top))], pa.int64())], names=["n", "v", "c", "total"])

    return run


def train(docs: DataFrame, count: int, order: int = 2) -> dict:
    """Counts the ``text`` of all rows and writes the arrays; what it returns is small."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = f"{local_path(shared_dir(spark))}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    texts = docs.select("text")
    # which words and contexts are frequent matters for sizes only, so a share of the rows tells it
    few = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("text")
    seen = few.mapInArrow(_sampled, "v long, c long").groupBy("v").agg(F.sum("c").alias("c"))
    kinds = sorted(((r.c, r["count"]) for r in seen.groupBy("c").count().collect()), reverse=True)
    least = min((c for (c, _), n in zip(kinds, np.cumsum([n for _, n in kinds])) if n <= FREQUENT), default=1 << 62)
    frequent = np.array(sorted(r.v for r in seen.where(F.col("c") >= least).select("v").collect()), np.int64).view(np.uint64)
    codes = Codes(frequent)
    tops = few.mapInArrow(_tops(order, codes), "n int, v long, c long, total long").groupBy("n", "v").agg(F.sum("c").alias("c"), F.sum("total").alias("t"))
    top = tops.withColumn("t", F.sum("t").over(Window.partitionBy("n"))).where(F.col("c") * HOT * count > F.col("t")).collect()
    hot = {}
    for n in range(2, order + 1):
        most = sorted((r for r in top if r.n == n), key=lambda r: -r.c)[: HOT * count]
        v = np.array([r.v for r in most], np.int64).view(np.uint64)
        spread = np.minimum(np.array([-(-r.c * HOT * count // r.t) for r in most], np.uint64), U(count))
        at = np.argsort(v)
        hot[n] = (v[at], spread[at])
    to = {n: Buckets(count, *x) for n, x in hot.items()}
    counted = texts.mapInArrow(_count(to[order], order, codes), MESSAGE)
    for n in range(order, 1, -1):
        counted = counted.repartitionById(count, "bucket").sortWithinPartitions("bucket")
        counted = counted.mapInArrow(_write_grams(to[n], to.get(n - 1), folder, n, 1 if n == order else 2), MESSAGE)
    words = counted.repartitionById(count, "bucket").sortWithinPartitions("bucket")
    word_sums = {r.bucket: r.sums for r in words.mapInArrow(_write_words(folder), "bucket int, sums array<long>").collect()}
    total = np.array([*word_sums.values()], np.int64).reshape(-1, 7).sum(axis=0)
    d, hot_stats, buckets = {1: discounts(*total[3:])}, {}, {"words": set(word_sums)}
    for n in range(2, order + 1):
        sums = np.zeros(6, np.int64)
        hot_stats[n] = np.zeros((len(hot[n][0]), 4), np.int64)
        own = buckets[f"grams{n}"] = buckets[f"before{n}"] = {b for b in range(count) if os.path.exists(f"{folder}/sums{n}-{b}.npy")}
        for b in own:
            sums += np.load(f"{folder}/sums{n}-{b}.npy")
            part = np.load(f"{folder}/hot{n}-{b}.npy")
            np.add.at(hot_stats[n], np.searchsorted(hot[n][0], part[:, 0].view(np.uint64)), part[:, 1:])
        if sums[0] != total[2]:
            raise RuntimeError(f"{folder} holds {sums[0]} of {total[2]} tokens at order {n}; do all executors write to it?")
        d[n] = discounts(*sums[2:])
    counts = [int(total[3]), int(total[4]), int(total[0] - total[3] - total[4])]
    rest = sum(a * b for a, b in zip(d[1], counts)) / max(1, int(total[1])) if total[1] else 1.0
    return {
        "folder": folder, "count": count, "order": order, "hot": hot, "hot_stats": hot_stats, "frequent": frequent, "buckets": buckets,
        "words": int(total[0]), "pairs": int(total[1]), "tokens": int(total[2]), "d": d, "rest": rest,
    }


def score(docs: DataFrame, spec: dict) -> DataFrame:
    """``OUT`` columns of each row of ``docs(id, text)``."""
    return docs.select("id", "text").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(spec), spec["folder"]), OUT)


def held_out_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Scores of all rows by a model, of an order, of those whose remainder by 7 is not 2."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    held = F.coalesce(remainder("id", 7) == 2, F.lit(False))
    spec = train(docs.where(~held), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), order)
    return score(docs, spec).withColumn("held_out", held)
