"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash of the last ``ROLL`` bytes cuts each text, at white space only, into chunks that don't depend
on what stands before. Equal chunks of all documents meet in their hash's bucket and are encoded once; ids
travel back to the documents' buckets, once for each bucket however many documents share the chunk. A cut
stands only if encoding across it agrees: the words around it are encoded together and apart, and
where that differs with ever more words, the chunks are joined and encoded as one.

Where the tokenizer drops white space, no token spans it, and a chunk's words come from a bounded cache
of word encodings; else the library encodes the chunk.

Defined results: null text is empty and has no tokens; repeated rows and null ids are kept, a row each.
Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .messages import MESSAGE, bucket_of, pack_table, rows, split, trim, unpack_table
from .shared import small_batches

ROLL, CUT = 16, 256
CACHE = 300_000
ROWS, BYTES = 10_000, 48 << 20
WIDEST = 64
_BASE = 0x2545F4914F6CDD1D
#: A tokenizer's normalizer, cuts, and beginnings of added tokens. Plain words have printable ASCII and letters of
#: Latin-1, which NFC keeps and which are one letter in lower case too, and can't hold an added token.
CLIP = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
    ["<|", "<|"],
]
_PLAIN = re.compile("[\\n!-~À-ÖØ-öø-ÿ]+")
#: Two bytes that stand for a line's end between ids of two bytes; ids are below 0xFF00, so it is found nowhere else.
_MARK = b"\xff\xff"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|\\n|[^a-zß-öø-ÿ0-9\\n]+")
OUT = "id long, ids array<int>, decoded string"
DIGEST = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _byte_names() -> dict[int, str]:
    """For the letters of plain words, those of their UTF-8 bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in shown)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(128, 256)}


_BYTES = _byte_names()


class Encoder:
    """One tokenizer of the ``tokenizers`` library, with a cache of at most ``most`` words and as many pieces; when it is full, those of the texts at hand stay."""

    def __init__(self, path: str, most: int = CACHE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.most, self.lib = most, Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        spec = json.loads(self.lib.to_str())
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        #: No token spans white space: it is removed before BPE.
        self.by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        self.plain = spec["decoder"] is None
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.names = [self.lib.id_to_token(i) for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.cache: dict[str, bytes] = {"": b""}
        #: Cuts plain words in lower case, a line each, as the tokenizer does, where it is one of those known here; ends of lines are pieces.
        same = [spec["normalizer"], (spec["pre_tokenizer"] or {}).get("pretokenizers"), [t["content"][:2] for t in spec["added_tokens"]]] == CLIP
        same &= size < 0xFF00 and not spec["model"].get("dropout")
        self.pieces, self.known = _PIECES.findall if same else None, {}

    def many(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, word by word."""
        cut = [t.replace("\n", " ").replace("\t", " ").split(" ") for t in texts]
        cache = self.cache
        every = set().union(*cut)
        new = every.difference(cache)
        if len(cache) + len(new) > self.most and len(cache) > 1:
            self.cache = cache = {"": b""} | {w: cache[w] for w in every.difference(new)}
        if new:
            self._learn(new)
        of = cache.__getitem__
        return [b"".join(map(of, ws)) for ws in cut]

    def _learn(self, new: set[str]) -> None:
        """New words into the cache: plain ones from their pieces, of which there are fewer, by the library's model alone, the others by all of it."""
        new, other = list(new), []
        if not self.pieces:
            new, other = [], new
        elif not _plain("\n".join(new)):
            other = [w for w in new if not _plain(w)]
            new = [w for w in new if _plain(w)]
        known, parts = self.known, self.pieces("\n".join(new).lower()) if new else []
        rare = set(parts).difference(known)
        if len(known) + len(rare) > self.most:
            self.known = known = {p: known[p] for p in set(parts).difference(rare)}
        known["\n"] = _MARK
        rare.discard("\n")
        cut, letter, name = self.lib.model.tokenize, self.kind.char, str.translate
        known.update((p, array(letter, [t.id for t in cut(p if p.isascii() else name(p, _BYTES))]).tobytes()) for p in rare)
        if new:
            self.cache.update(zip(new, b"".join(map(known.__getitem__, parts)).split(_MARK)))
        if other:
            self.cache.update(zip(other, self.many(other)))

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.words(texts) if self.by_word else self.many(texts)

    def agrees(self, left: str, right: str) -> bool:
        """Whether encoding across a cut gives what its sides give, with few words around it or at least with more."""
        words = 1
        while words <= WIDEST:
            a, b = _last(left, words), _first(right, words)
            both = self.many([a + b])[0]
            if both == b"".join(self.encode([a, b])):
                return True
            words *= 4
        return False

    def decode(self, ids: list[int]) -> str:
        """As the library: without a decoder, tokens joined by a space."""
        if self.plain:
            return " ".join([self.names[i] for i in ids])
        return self.lib.decode(ids, skip_special_tokens=False)


def _last(text: str, words: int) -> str:
    at = len(text)
    for _ in range(words):
        at = text.rfind(" ", 0, at)
        if at <= 0:
            return text
    return text[at:]


def _first(text: str, words: int) -> str:
    at = 0
    for _ in range(words):
        at = text.find(" ", at + 1)
        if at < 0:
            return text
    return text[:at]


def _plain(text: str) -> bool:
    return "<|" not in text and _PLAIN.fullmatch(text) is not None


@lru_cache(maxsize=2)
def encoder(path: str, most: int = CACHE) -> Encoder:
    return Encoder(path, most)


def _cuts(data: np.ndarray) -> np.ndarray:
    """Positions of white space before which a chunk begins."""
    n = len(data)
    if n <= ROLL:
        return np.empty(0, np.int64)
    space = np.flatnonzero((data == 32) | (data == 10))
    space = space[space >= ROLL]
    # the hash of the ROLL bytes before each white space, by Horner's rule over all of them at once
    h = np.zeros(len(space), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ROLL, 0, -1):
            h = h * np.uint64(_BASE) + data[space - i]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return space[(h >> np.uint64(40)) % np.uint64(CUT) == 0]


def chunks(text: str, enc: Encoder) -> list[str]:
    """A text's chunks, an empty one for an empty text; joins where encoding disagrees are undone."""
    raw = text.encode()
    cuts = _cuts(np.frombuffer(raw, np.uint8)).tolist()
    out: list[str] = []
    for a, b in zip([0, *cuts], [*cuts, len(raw)]):
        piece = raw[a:b].decode()
        if out and not enc.agrees(out[-1], piece):
            out[-1] += piece
        else:
            out.append(piece)
    return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of some ``ROWS`` rows or ``BYTES``, so that more chunks meet within a task."""
    held, n, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        size += batch.nbytes
        if n >= ROWS or size >= BYTES:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


_SIGNED = lambda x: x - (1 << 64) if x >> 63 else x


def _cut_texts(path: str, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in _together(batches):
            number: dict[str, int] = {}
            ref, ids, keys, null, pos, total = [], [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = t or ""
                parts = chunks(t, enc)
                key = _SIGNED(xxhash.xxh3_64_intdigest(t.encode()))
                for p, c in enumerate(parts):
                    ref.append(number.setdefault(c, len(number)))
                    pos.append(p)
                n = len(parts)
                ids += [i or 0] * n
                keys += [key] * n
                null += [i is None] * n
                total += [n] * n
            if not ref:
                continue
            texts = pa.array(list(number), pa.large_string())
            home = np.array([xxhash.xxh3_64_intdigest(c.encode()) % count for c in number])
            ref = np.array(ref)
            refs = pa.table({"chunk": ref, "id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.int64()), "null": null, "pos": pa.array(pos, pa.int32()), "total": pa.array(total, pa.int32())})
            texts_of, refs_of = dict(split(home, count)), dict(split(home[ref], count))
            out = []
            for b, own in texts_of.items():
                r = refs.take(pa.array(refs_of[b]))
                local = np.searchsorted(own, r.column("chunk").to_numpy())
                r = r.set_column(0, "chunk", pa.array(local))
                out.append((b, _pack(texts.take(pa.array(own)), r)))
            yield rows(out)

    return run


_REF = pa.schema([("chunk", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("null", pa.bool_()), ("pos", pa.int32()), ("total", pa.int32())])


def _encode_chunks(path: str, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        done: dict[str, int] = {}
        ids: list[bytes] = []
        held, n = [], 0

        def flush():
            refs = pa.concat_tables(held)
            chunk = refs.column("chunk").to_numpy()
            doc = bucket_of(refs.column("id").to_numpy() ^ refs.column("key").to_numpy(), count)
            out = []
            for b, i in split(doc, count):
                own, local = np.unique(chunk[i], return_inverse=True)
                r = refs.take(pa.array(i)).set_column(0, "chunk", pa.array(local))
                out.append((b, _pack(pa.array([ids[k] for k in own.tolist()], pa.large_binary()), r)))
            return rows(out)

        for batch in batches:
            for body in batch.column(1):
                texts, refs = _unpack(body.as_py())
                texts = texts.to_pylist()
                new = [t for t in texts if t not in done]
                for t, x in zip(new, enc.encode(new)):
                    done[t] = len(ids)
                    ids.append(x)
                known = np.array([done[t] for t in texts])
                held.append(refs.set_column(0, "chunk", pa.array(known[refs.column("chunk").to_numpy()])))
                n += refs.num_rows
                if n > 2_000_000:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()
        trim()

    return run


def _pack(values: pa.Array, refs: pa.Table) -> bytes:
    """Chunks and references to them as one table: values first, then references with no value."""
    v = pa.table({"value": values})
    return pack_table(pa.concat_tables([v, refs], promote_options="default"))


def _unpack(body: bytes) -> tuple[pa.Array, pa.Table]:
    t = unpack_table(body)
    values = t.column("value")
    n = len(values) - values.null_count
    return values.slice(0, n), t.slice(n).drop_columns(["value"])


def _assemble(path: str, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        docs: dict[tuple, list] = {}
        for batch in batches:
            for body in batch.column(1):
                values, refs = _unpack(body.as_py())
                values = values.to_pylist()
                for c, i, k, null, p, total in zip(*(refs.column(x).to_pylist() for x in _REF.names)):
                    d = docs.get((i, k, null))
                    if d is None:
                        d = docs[(i, k, null)] = [0, [None] * total]
                    d[0] += p == 0
                    d[1][p] = values[c]
        out = []
        for (i, _, null), (times, parts) in docs.items():
            x = finish(enc, np.frombuffer(b"".join(parts), enc.kind))
            out += [(None if null else i, *x)] * times
            if len(out) >= 200:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)
        docs.clear()
        trim()

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), finish.types)], names=[f"c{i}" for i in range(len(finish.types))])

    return run


def whole(enc: Encoder, ids: np.ndarray) -> tuple:
    return ids.astype(np.int32), enc.decode(ids.tolist())


whole.types = [pa.int64(), pa.list_(pa.int32()), pa.string()]


def digest(enc: Encoder, ids: np.ndarray) -> tuple:
    numbers, ids = enc.numbers, ids.tolist()
    sha = hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest()
    return len(ids), sha, hashlib.sha256(enc.decode(ids).encode()).hexdigest()


digest.types = [pa.int64(), pa.int64(), pa.string(), pa.string()]


def digest_and_ids(enc: Encoder, ids: np.ndarray) -> tuple:
    return *digest(enc, ids), ids.astype(np.int32)


digest_and_ids.types = [*digest.types, pa.list_(pa.int32())]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", finish=whole, out: str = OUT) -> DataFrame:
    """``id, ids, decoded`` for each row; ``finish`` may derive other columns ``out`` from the ids within the task."""
    small_batches(docs.sparkSession)
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sent = docs.mapInArrow(_cut_texts(path, count), MESSAGE).repartition(count, "bucket")
    back = sent.mapInArrow(_encode_chunks(path, count), MESSAGE).repartition(count, "bucket")
    names = [x.split()[0] for x in out.split(", ")]
    kinds = [x.split()[1] for x in out.split(", ")]
    raw = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    return back.mapInArrow(_assemble(path, finish), raw).toDF(*names)
