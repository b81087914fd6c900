"""The ten operators against brute force, on texts with nulls, repeats, ties and extremes."""

import collections
import hashlib
import math
import os
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.llm import bpe, cotrain, decontam, dom_model, entry, itq, kneser_ney, langid, rangecoder, shared, simhash_nsw, substring, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket string"


def corpus(n=60, seed=5):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    text = lambda k: r.choice(" \n").join(r.choice(vocabulary) for _ in range(k))
    passage = text(70)
    rows = []
    for i in range(n):
        t = text(r.choice((3, 30, 120, 400)))
        if i % 7 == 1:
            t = f"{text(20)} {passage} {text(20)}"
        if i % 9 == 2:
            t = rows[-1][1]
        if i % 9 == 3 and rows[-1][1].count(" ") > 60:
            w = rows[-1][1].split(" ")
            w[5] = "changed"
            t = " ".join(w)
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n\x0b "), (n + 3, "x"), (n + 4, "é" * 30000 + " Σ ʼn ﬁ"), (n + 5, "12 !! 3"), (n + 6, " ".join(["Ünï", "code"] * 4000)), rows[4], rows[4]]
    rows.append((None, passage))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Also with columns of names that the operators use themselves."""
    full = [(i, t, None if i == 3 else "en", None if i == 4 else "s", None if t is None else len(t), 7, "b") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def split(t):
    return (t or "").encode().split()


def test_words_of_a_column():
    texts = ["a bb  ccc", None, "", "é\x0bx", " ", "end"]
    found = []
    for w in words.blocks(pa.array(texts), limit=4):
        d = w.data.tobytes()
        for a, b in zip(w.docs[:-1], w.docs[1:]):
            found.append([d[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])])
    assert found == [split(t) for t in texts]


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[a] == root[a] for e in edges for a in e if e[0] != e[1])
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(t):
    w = split(t)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def test_op10_classes(docs, rows, empty):
    texts = dict((i, t) for i, t in rows if i is not None)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for _ in range(4):
        for a in texts:
            for b in texts:
                if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.class_id for r in simhash_nsw.near_duplicates(docs).collect()}
    assert got == root | {None: None}
    kept = simhash_nsw.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i in texts if root[i] == i)
    assert simhash_nsw.near_duplicates(empty).count() == 0


def test_op10_pairs_that_graphs_miss(spark, monkeypatch):
    """Texts of 8 and 9 words at similarity 4/5, of which all min-hashes differ or the codes are far apart."""
    monkeypatch.setattr(simhash_nsw, "PER_SHARD", 1)
    r = random.Random(8)
    rows = []
    for i in range(6000):
        t = [f"w{r.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * i, " ".join(t[:8])), (2 * i + 1, " ".join(t))]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["id", "text"])
    fp = pa.Table.from_batches(list(simhash_nsw._fingerprints([batch]))).to_pylist()
    code = np.array([[x["c1"], x["c2"]] for x in fp]).view(np.uint64)
    far = simhash_nsw.hamming(code[::2], code[1::2]) > simhash_nsw.RADIUS
    apart = [not set(a["mins"]) & set(b["mins"]) for a, b in zip(fp[::2], fp[1::2])]
    picked = [i for i in range(6000) if far[i] or apart[i]]
    assert far.sum() > 3 and sum(apart) > 3
    d = spark.createDataFrame([x for i in picked for x in rows[2 * i : 2 * i + 2]], "doc_id long, text string")
    got = {x.id: x.class_id for x in simhash_nsw.near_duplicates(d).collect()}
    assert got == {j: 2 * i for i in picked for j in (2 * i, 2 * i + 1)}


def test_op10_counters_know_all_texts(spark):
    """Of more than 100,000 texts too, every shingle counts."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=r.choice((1, 2, 5, 6)))) for _ in range(300)]
    every = [*texts, *["seldom seen"] * 110_000, None, ""]
    d = spark.createDataFrame(list(enumerate(every)), "id long, text string").repartition(5)
    seen = simhash_nsw.unpack(simhash_nsw.counters(simhash_nsw.fingerprints(d)), "u1")[0]
    want = np.zeros(simhash_nsw.COUNTERS, np.int64)
    for w in words.blocks(pa.array(every)):
        np.add.at(want, (simhash_nsw.shingles(w)[1] % np.uint64(simhash_nsw.COUNTERS)).astype(np.int64), 1)
    assert want.max() >= 110_000 and (seen == np.rint(8 * np.log2(1 + want))).all()


def test_op10_prefixes_lose_no_pair():
    r = np.random.default_rng(4)
    sets = []
    for _ in range(150):
        base = r.choice(500, r.integers(1, 60), replace=False)
        sets += [base, base[: max(1, int(len(base) * r.uniform(0.75, 1)))], np.union1d(base[1:], r.choice(500, 2))]
    sets = [np.unique(x).astype(np.uint64) for x in sets]
    seen = r.integers(0, 9, simhash_nsw.COUNTERS).astype(np.uint8)
    doc, h, n, place = simhash_nsw.prefixes(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), seen)
    got = {p for a, b in simhash_nsw.meetings(h, doc, n, place) for p in zip(a.tolist(), b.tolist())}
    as_sets = [set(x.tolist()) for x in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(as_sets[i] & as_sets[j]) * 5 >= len(as_sets[i] | as_sets[j]) * 4}
    assert len(want) > 50 and want <= got


def test_op10_sketches_lose_no_pair():
    """Sets of all sizes, also with bins that hold several; sketches of other lengths are folded."""
    r = np.random.default_rng(9)
    sets = []
    for n in [1, 2, 5, 63, 64, 65, 130, 500, 1025, 9000] * 8:
        base = np.unique(words.mix(r.integers(0, 1 << 62, n, dtype=np.uint64)))
        cut = base[: max(1, int(n * r.uniform(0.6, 1)))]
        sets += [base, cut, np.union1d(base[n // 9 :], words.mix(r.integers(0, 1 << 62, 1 + n // 12, dtype=np.uint64))), base & ~np.uint64(63)]
    sets = [np.unique(x) for x in sets]
    n = np.array([len(x) for x in sets])
    odd = simhash_nsw.odd_sketches(np.concatenate(sets), n)
    # a slice, since batches have offsets
    assert simhash_nsw.apart(odd.slice(3, 2), odd.slice(3, 2)).tolist() == [0, 0]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    near = np.minimum(n[a], n[b]) * 5 >= np.maximum(n[a], n[b]) * 4
    a, b = a[near], b[near]
    batch = pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int32)), pa.array(n[a]), pa.array(n[b]), odd.take(pa.array(a)), odd.take(pa.array(b))], names=["a", "b", "d", "na", "nb", "oa", "ob"])
    got = {(x["a"], x["b"]) for x in pa.Table.from_batches(list(simhash_nsw._may_be_similar([batch]))).to_pylist()}
    common = {(x, y): len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())}
    want = {p for p, c in common.items() if c * 5 >= (n[p[0]] + n[p[1]] - c) * 4}
    assert len(want) > len(sets) + 100 and want <= got and len(got) < len(a) / 2
    least = simhash_nsw.apart(odd.take(pa.array(a)), odd.take(pa.array(b)))
    assert all(d <= n[x] + n[y] - 2 * common[x, y] for x, y, d in zip(a.tolist(), b.tolist(), least.tolist()))


def test_op10_sets_travel_for_similar_pairs_only(spark):
    """A crowd of texts whose fingerprints are near and whose sets are not similar: no set is sent for them."""
    r = random.Random(12)
    base, rows = [f"w{r.randrange(10**6)}" for _ in range(400)], []
    for i in range(120):
        t = list(base)
        for k in range(13):
            t[k * 30 + r.randrange(5)] = f"x{i}-{k}"
        rows.append((i, " ".join(t)))
    rows += [(120, rows[7][1] + " and more")]
    docs = spark.createDataFrame(rows, "id long, text string")
    counted = simhash_nsw.materialize(simhash_nsw.fingerprints(docs), "simhash")
    found = simhash_nsw.candidates(docs, counted.where("slice is null"), simhash_nsw.counters(counted)).select("a", "b").collect()
    sets = [shingle_set(t) for _, t in rows]
    alike = lambda x, y: len(sets[x] & sets[y]) / len(sets[x] | sets[y])
    assert (7, 120) in [tuple(x) for x in found] and alike(0, 1) > 0.5
    assert len(found) < 10 and all(alike(*x) > 0.7 for x in found)


def test_op10_crowds():
    """Links in a crowd grow with its number."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, (1, 2), dtype=np.uint64).repeat(3000, 0)
    base[np.arange(3000), 0] ^= np.uint64(1) << r.integers(0, 64, 3000).astype(np.uint64)
    part = simhash_nsw.Part(np.arange(3000), base)
    links = part.links(np.arange(3000), base)
    assert links.num_rows <= 3000 * (simhash_nsw.LINKS + 1)
    forest = pa.Table.from_batches(list(simhash_nsw._forest(iter([links]))))
    assert forest.num_rows > 2950  # the rest meets by prefixes


def test_op10_crowd_end_to_end(spark):
    """A third of all texts alike, far ends of the chain not, and some that only prefixes join; against all pairs."""
    r = random.Random(3)
    rows, base = [], [f"w{r.randrange(10**6)}" for _ in range(60)]
    for i in range(300):
        t = list(base) if i % 3 == 0 else [f"v{r.randrange(10**6)}" for _ in range(r.choice((6, 9, 60)))]
        if i % 3 == 0:
            t[(i // 3) % 60] = f"x{i}"
        if i % 3 == 1 and i > 30:
            t = rows[-3][1].split(" ")[:-1] or t
        rows.append((i, " ".join(t)))
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(300))
    for _ in range(5):
        for a in range(300):
            for b in range(a + 1, 300):
                if len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = {x.id: x.class_id for x in simhash_nsw.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < 200


def test_small_world_recall():
    r = np.random.default_rng(0)
    base = r.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    near = base[:600].copy()
    for row in near:
        for b in r.choice(128, 14, replace=False):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    codes = np.concatenate([base, near, np.repeat(base[:1], 40, axis=0)])
    part = simhash_nsw.Part(np.arange(len(codes)), codes)
    got = part.links(np.arange(len(codes)), codes)
    found = set(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))
    q, c, _ = simhash_nsw.exact(codes, codes)
    want = {(int(a), int(b)) for a, b in zip(q, c) if a < b}
    assert len(found & want) / len(want) >= 0.9 and found <= want


def repeats(rows):
    low = {}
    for i, t in rows:
        w = split(t)
        for k in range(len(w) - 49):
            if i is not None:
                key = tuple(w[k : k + 50])
                low[key] = min(low.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = split(t), set()
        for k in range(len(w) - 49):
            if i is not None and low[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return collections.Counter(out)


def test_op4_repeats(docs, rows, empty):
    got = substring.remove_repeats(docs, map_out=substring.digest, out=substring.DIGEST).collect()
    assert collections.Counter(tuple(r) for r in got) == repeats(rows)
    assert sum(r.n_removed for r in got) > 100
    carried = substring.remove_repeats(docs, carry=("lang", "source"), layout=True)
    assert carried.columns[-2:] == ["lang", "source"] and carried.count() == len(rows)
    assert substring.remove_repeats(empty).count() == 0


def test_op4_one_id_with_two_texts(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, "other words"), (2, text), (2, text)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.n_words, r.n_removed) for r in got) == [(1, 60, 0), (2, 2, 0), (2, 60, 60), (2, 60, 60)]


def test_op9_overlaps(spark, docs, empty):
    r = random.Random(2)
    item = [f"tok{r.randrange(500)}" for _ in range(40)]
    swapped = list(item)
    for k in range(3, 40, 9):
        swapped[k] = "different"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "short item of six whole words"), (3, None), (4, "")], "item_id long, text string")
    texts = [(1, "before " + " ".join(item).upper() + " after"), (2, "x " + ", ".join(swapped)), (3, "a short item of six whole words."), (4, " ".join(item[:8])), (5, "short item of five whole words"), (6, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x.id: x["items"] for x in decontam.overlaps(d, bench).collect()}
    assert got == {1: [1], 2: [1], 3: [2], 4: [], 5: [], 6: []}
    assert sorted(x.doc_id for x in decontam.clean(d, bench).collect()) == [4, 5, 6]
    assert decontam.overlaps(docs, bench.where("false")).where("size(items) > 0").count() == 0
    assert decontam.overlaps(empty, bench).count() == 0


def test_op9_parts_agree(spark, monkeypatch):
    """With null ids, repeated ids and rows, and clashing columns."""
    bench = spark.createDataFrame([(i, f"alpha{i} beta{i} gamma{i} delta{i}") for i in range(6)] + [(None, "some item without id"), (9, None)], "item_id long, text string").coalesce(1)
    rows = [(1, "x alpha2 beta2 gamma2 delta2 y alpha5 beta5 gamma5 delta5"), (2, "none"), (None, "alpha5 beta5 gamma5 delta5"), (7, "alpha5 beta5 gamma5 delta5"), (7, "clean"), (7, "clean"), (None, None)]
    d = spark.createDataFrame([(i, t, 3, [4]) for i, t in rows], "doc_id long, text string, id int, items array<int>")
    find = lambda: collections.Counter((r.id, r.n_tokens, tuple(r["items"]), tuple(r.overlaps)) for r in decontam.overlaps(d, bench).collect())
    whole, left = find(), collections.Counter(map(str, decontam.clean(d, bench).collect()))
    assert collections.Counter((i, x) for i, _, x, _ in whole.elements()) == collections.Counter({(1, (2, 5)): 1, (2, ()): 1, (None, (5,)): 1, (None, ()): 1, (7, (5,)): 1, (7, ()): 2})
    assert sum(left.values()) == 4
    monkeypatch.setattr(decontam, "PART", 60)
    assert find() == whole and collections.Counter(map(str, decontam.clean(d, bench).collect())) == left


def test_op9_against_brute_force():
    """Every diagonal of every text and item, without seeds; items of all lengths, substitutions anywhere."""
    r = random.Random(12)
    items = [[f"w{r.randrange(3000)}" for _ in range(n)] for n in [*range(1, 30), *range(5, 21), 59]]
    texts = []
    for k in range(400):
        item = r.choice(items)
        own = list(item)
        for j in r.sample(range(len(own)), min(len(own), r.choice((0, 1, 2, 3, 4)))):
            own[j] = f"x{r.randrange(50)}"
        a, b = (0, len(own)) if k % 3 else sorted(r.sample(range(len(own) + 1), 2))
        texts.append([f"w{r.randrange(3000)}" for _ in range(r.choice((0, 3, 30)))] + own[a:b] + [f"w{r.randrange(3000)}" for _ in range(r.choice((0, 5)))])
    texts += [[], ["w1"], r.choice(items) * 3, ["w7"] * 30000]
    index = decontam.Index(list(range(len(items))), [" ".join(x) for x in items])
    _, got = decontam._spans(index, pa.array([" ".join(t) for t in texts]))
    sure, missed = 0, 0
    for t, spans in zip(texts, got):
        for i, item in enumerate(items):
            n, want = len(item), False
            for d in range(1 - n, len(t)) if len(t) < 1000 else ():
                same = [0 <= d + k < len(t) and t[d + k] == item[k] for k in range(n)]
                if n < decontam.LONG:
                    want |= sum(same) >= (n if n < decontam.WHOLE else math.ceil(0.8 * n))
                elif sum(same) >= 13:
                    best, at = 0, (0, 0)
                    for b in range(1, n + 1):
                        for a in range(b - 1, -1, -1):
                            if (x := sum(1 if y else -2 for y in same[a:b])) > best:
                                best, at = x, (a, b)
                    a, b = at
                    want |= sum(same[a:b]) >= 13 and b - a - sum(same[a:b]) <= 3
            found = any(x[0] == i for x in spans)
            sure += want
            missed += want and not found
            if n < decontam.LONG and len(t) < 1000:
                assert want == found
    assert sure > 150 and missed == 0


def test_op2_languages(spark, empty):
    r = random.Random(4)
    kinds = {"aa": "abcdef", "bb": "uvwxyzé", "ru": "абвгд"}
    text = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(2, 6))) for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(list(kinds) * 30)] + [(200, None, "aa"), (201, "12 34 !", "bb"), (202, text("aa", 20), None), (203, text("ru", 40) + " " + text("aa", 20), None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.id: x for x in langid.predict(d).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:90])
    assert (got[200].lang_pred, got[201].lang_pred, got[202].lang_pred, got[203].lang_pred) == ("und", "und", "aa", "ru")
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1 for i in got)
    spans = langid.label(d.where("doc_id = 203"), langid.train(d), spans=True).first().spans
    assert [(s.lang, s.words) for s in spans] == [("ru", 40), ("aa", 20)]
    assert langid.predict(empty).count() == 0
    assert langid.label(d, langid.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_op2_letters(spark):
    """Every character's script, and texts of signs that share blocks with letters."""
    import unicodedata

    chars = [chr(c) for c in range(33, 1 << 18) if not 0xD800 <= c < 0xE000 and not chr(c).isspace()]
    for lo in range(0, len(chars), 50000):
        own = chars[lo : lo + 50000]
        w = next(words.blocks(pa.array([" ".join(own)]), 1 << 30))
        _, _, letters, script = langid.features(w)
        assert len(letters) == len(own)
        assert all((n > 0) == (k > 0) == (unicodedata.category(c)[0] == "L") for n, k, c in zip(letters.tolist(), script.tolist(), own))
    signs = ["。", "！！", "１２３", "™", "№", "℃ 5", "²³", "（）", "\U0001f600 \U0001f4a9", "12 34", ""]
    letters = ["々", "ー", "ㄱ", "ａ", "ª", "𝐀", "x", "ʼ", "𠀀"]
    rows = [(i, t, None, 5) for i, t in enumerate(signs + letters)] + [(100 + i, "abc def", "aa", 5) for i in range(9)] + [(200, "def " * 100_000 + "。", None, 5)] * 2 + [(None, "abc", "aa", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = collections.defaultdict(list)
    for r in langid.predict(d).collect():
        got[r.id].append(r.lang_pred)
    assert [got[i] for i in range(len(signs))] == [["und"]] * len(signs)
    assert [got[i + len(signs)] for i in range(len(letters))] == [["aa"]] * len(letters)
    assert got[200] == ["aa", "aa"] and got[None] == ["aa"]
    kept = langid.known(d, langid.train(d))
    assert kept.columns == d.columns and kept.count() == len(letters) + 9 + 3


def test_viterbi_is_best_path():
    r = np.random.default_rng(1)
    docs = np.array([0, 4, 4, 9, 10])
    s = r.normal(size=(10, 3)).astype(np.float32) * 4
    path = langid.viterbi(s, docs, 2.0)
    for a, b in zip(docs[:-1], docs[1:]):
        value = lambda p, a=a: sum(s[a + i, k] for i, k in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        best = max((value(p) for p in __import__("itertools").product(range(3), repeat=b - a)), default=0)
        assert abs(value(path[a:b].tolist()) - best) < 1e-4


def test_op6_and_op8_tokens(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(entry.tokenizer_path())
    want, ordered = collections.Counter(), []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
        ordered.append((i is not None, i or 0, t or "", ids))
    got = bpe.encode(docs, entry.tokenizer_path(), finish=bpe.digest, out=bpe.DIGEST).collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert bpe.encode(empty, entry.tokenizer_path()).count() == 0
    at, places = 0, collections.Counter()
    for known, i, _, ids in sorted(ordered):
        ids = np.array([*ids, 2], "<u4")
        places[(i if known else None, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    files = rangecoder.write(docs, entry.tokenizer_path())
    assert collections.Counter(tuple(r) for r in rangecoder.read(spark, files).collect()) == places
    assert rangecoder.read(spark, rangecoder.write(empty, entry.tokenizer_path())).count() == 0


def test_op6_other_tokenizer(docs, rows):
    """One whose tokens hold white space: chunks are joined where encoding across a cut differs."""
    from tokenizers import Tokenizer

    path = entry.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = {r.id: r for r in bpe.encode(docs, path).collect() if r.id is not None}
    assert all(got[i].ids == lib.encode(t or "", add_special_tokens=False).ids and got[i].decoded == lib.decode(got[i].ids, skip_special_tokens=False) for i, t in rows if i is not None)


@pytest.mark.parametrize("ids", [[], [5], list(range(5000)), [7] * 9000, [1 << 20, 3, 1 << 31]])
def test_op8_round_trip(tmp_path, ids):
    path = str(tmp_path / "x.ids")
    ids = np.array(ids, np.uint32)
    rangecoder.write_file(path, [None, 3], np.array([0, len(ids)]), ids)
    names, counts, back = rangecoder.read_file(path)
    assert names == [None, 3] and counts.tolist() == [0, len(ids)] and (back == ids).all()
    if len(ids) > 100:
        raw = bytearray(open(path, "rb").read())
        raw[-5] ^= 255
        open(path, "wb").write(raw)
        with pytest.raises(rangecoder.Corrupt):
            rangecoder.read_file(path)


def test_op8_many_ids_take_little_time_and_room(tmp_path):
    """A million ids, some frequent and some not: written and read in a few operations each, near their entropy."""
    r = np.random.default_rng(2)
    ids = np.minimum(r.zipf(1.3, 1_000_000), 49_000).astype(np.uint32)
    path = str(tmp_path / "x.ids")
    began = time.process_time()
    rangecoder.write_file(path, [1], np.array([len(ids)]), ids)
    back = rangecoder.read_file(path)[2]
    assert (back == ids).all() and time.process_time() - began < 2
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert os.path.getsize(path) < 8 * len(share) + 1.1 * len(ids) * -(share * np.log2(share)).sum() / 8


def test_op8_carries_and_extremes(tmp_path):
    """Shares near 1 and ids seen once, over blocks that begin and end with either."""
    r = np.random.default_rng(3)
    for n, rare in ((1, 0), (1023, 0), (1024, 1), (1025, 1025), (70_000, 9), (70_000, 69_000)):
        ids = np.full(n, 7, np.uint32)
        ids[r.permutation(n)[:rare]] = r.integers(0, 1 << 32, rare)
        path = str(tmp_path / "x.ids")
        rangecoder.write_file(path, [1], np.array([n]), ids)
        assert (rangecoder.read_file(path)[2] == ids).all()


def test_op8_plain_words_come_from_their_pieces():
    enc = bpe.Encoder(entry.tokenizer_path())
    r = random.Random(3)
    letters = [*map(chr, range(33, 127)), *map(chr, range(0xA1, 0x100)), "'s", "'LL", "'", "<|", "|>", "st", "RE", "\u0149", "e\u0301", "\u0130", "\u2126", "\x0b", "\x00"]
    made = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(5000)] + ["<|endoftext|>", "a<|startoftext|>b", "<<|endoftext|>|", "x'S'll"]
    want = enc.many(made)
    assert enc.encode(made) == want
    plain = ["Wörter,", "naïve-12", "it's", "(\"ÉTÉ\")"]
    want, enc.many = enc.many(plain), None
    assert enc.encode(plain) == want


def test_op8_full_cache_keeps_the_words_at_hand():
    """Words of every text are learned once, however often seldom ones fill the cache."""
    enc = bpe.Encoder(entry.tokenizer_path(), 3000)
    r = random.Random(4)
    often = ["".join(r.choices("abcdeé", k=6)) + "," for _ in range(200)]
    learned, learn = collections.Counter(), enc._learn
    enc._learn = lambda new: learned.update(new) or learn(new)
    for _ in range(30):
        texts = [" ".join([*r.sample(often, 200), *("".join(r.choices("stuvwÜ", k=8)) for _ in range(100))]) for _ in range(5)]
        assert enc.encode(texts) == enc.many(texts)
        assert len(enc.cache) <= 3000 and len(enc.known) <= 3001
    assert len(learned) > 9000 and all(learned[w] == 1 for w in often)


def test_op1_scores(docs, rows, empty):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    cut = lambda t: [*(t or "").encode().translate(lower).split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [cut(t) for i, t in rows if not held(i)]
    c = collections.Counter(w for x in train for w in x)
    n, v = sum(c.values()), len(c)
    b = collections.Counter(p for x in train for p in zip(["<s>", *x[:-1]], x))
    kinds = collections.Counter(w for _, w in b)
    of = lambda counts: kneser_ney.discounts(*(sum(x == k for x in counts) for k in (1, 2, 3, 4)))
    d1, d2 = [0.0, *of(kinds.values())], [0.0, *of(b.values())]
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, _), k in b.items():
        context[a][0] += k
        context[a][min(k, 3)] += 1
    rest = sum(d1[min(k, 3)] for k in kinds.values()) / len(b)
    low = lambda w: (kinds[w] - d1[min(kinds[w], 3)]) / len(b) + rest / (v + 1)

    def high(a, w):
        if a not in context:
            return low(w)
        x, k = context[a], b[(a, w)]
        return (k - d2[min(k, 3)]) / x[0] + sum(d2[j] * x[j] for j in (1, 2, 3)) / x[0] * low(w)

    assert abs(sum(high("<s>", w) for w in c) + high("<s>", "unseen") - 1) < 1e-9
    got = collections.defaultdict(list)
    for r in kneser_ney.held_out_scores(docs).collect():
        got[r.id].append(r)
    for i, t in rows:
        x = cut(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)
        score = sum(math.log10(high(a, w)) for a, w in zip(["<s>", *x[:-1]], x))
        for r in got[i]:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(x), sum(c[w] > 0 for w in x), n, held(i))
            assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    assert sum(map(len, got.values())) == len(rows)
    assert kneser_ney.held_out_scores(empty).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_op1_higher_orders(docs, rows, order):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    cut = lambda t: ["<s>", *(t or "").encode().translate(lower).split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = [cut(t) for i, t in rows if not held(i)]
    plain = [collections.Counter(tuple(x[j - n + 1 : j + 1]) for x in train for j in range(max(1, n - 1), len(x))) for n in range(1, order + 1)]
    counts = {order: plain[-1]}
    for n in range(order - 1, 0, -1):
        kinds = collections.Counter(g[1:] for g in plain[n])
        counts[n] = {g: k if g[0] == "<s>" else kinds[g] for g, k in plain[n - 1].items()}
    d = {n: [0.0, *kneser_ney.discounts(*(sum(x == k for x in c.values()) for k in (1, 2, 3, 4)))] for n, c in counts.items()}
    stats = collections.defaultdict(lambda: [0, 0.0])
    for n, c in counts.items():
        for g, k in c.items():
            stats[g[:-1]][0] += k
            stats[g[:-1]][1] += d[n][min(k, 3)]
    v = len(counts[1])

    def p(g):
        lower = p(g[1:]) if len(g) > 1 else 1 / (v + 1)
        total, freed = stats.get(g[:-1], (0, 0.0))
        k = counts[len(g)].get(g, 0)
        return (k - d[len(g)][min(k, 3)] + freed * lower) / total if total else lower

    words_ = [g[0] for g in counts[1]]
    for c in [g[:-1] for g in list(counts[order])[:3]] + [("<s>",)]:
        assert abs(sum(p((*c, w)) for w in words_) + p((*c, "unseen")) - 1) < 1e-9
    got = collections.defaultdict(list)
    for r in kneser_ney.held_out_scores(docs, order=order).collect():
        got[r.id].append(r.score)
    for i, t in rows:
        x = cut(t)
        score = sum(math.log10(p(tuple(x[max(0, j - order + 1) : j + 1]))) for j in range(1, len(x)))
        assert all(abs(y - score) < 1e-6 for y in got[i])


def test_op1_scoring_uses_one_thread(docs):
    """Tasks share their cores: no library may wait busily in other threads while a block is scored."""
    spec = kneser_ney.train(docs.select("text", F.col("doc_id").alias("id")), 4, 3)
    w = next(words.blocks(pa.array([r.text for r in docs.select("text").collect()])))
    grams, _ = kneser_ney.grams(w, 3, kneser_ney.Codes(spec["frequent"]))
    grams = [np.tile(x, 1 + 1_000_000 // len(x)) for x in grams]
    model = kneser_ney.Model(spec)
    every, own = time.process_time(), time.thread_time()
    model.score(grams)
    every, own = time.process_time() - every, time.thread_time() - own
    assert every < 1.2 * own + 0.1


def test_op1_looks_up_once(docs, monkeypatch):
    """Words, contexts and n-grams of lower orders that come again are looked up once, and score the same."""
    spec = kneser_ney.train(docs.select("text", F.col("doc_id").alias("id")), 4, 4)
    w = next(words.blocks(pa.array([r.text for r in docs.select("text").collect()])))
    grams, _ = kneser_ney.grams(w, 4, kneser_ney.Codes(spec["frequent"]))
    model, looked, real = kneser_ney.Model(spec), {}, kneser_ney.Model._look
    want = model.score(grams)
    monkeypatch.setattr(kneser_ney.Model, "_look", lambda self, kind, bucket, k, width: (looked.update({kind: len(k)}), real(self, kind, bucket, k, width))[1])
    got = model.score([np.tile(x, 5) for x in grams])
    assert all((np.tile(a, 5) == b).all() for a, b in zip(want, got))
    kinds = {n: len({g for g in zip(*(x.tolist() for x in grams[-n:])) if g[0]}) for n in (1, 2, 3)}
    assert (looked["words"], looked["grams2"], looked["grams3"]) == (kinds[1], kinds[2], kinds[3])
    assert looked["before2"] <= kinds[1] + 1 and looked["before3"] <= kinds[2] and looked["before4"] <= kinds[3]


@pytest.mark.parametrize("order", [1, 2, 3, 4, 6])
def test_op1_sums(order):
    """N-grams of numbers and hashes, whether or not they fit one number."""
    r = np.random.default_rng(order)
    kinds = np.concatenate([np.arange(20), r.integers(0, 1 << 56, 20) | 1 << 60]).astype(np.uint64)
    keys, values = [r.choice(kinds, 5000) for _ in range(order)], [r.integers(1, 9, 5000) for _ in range(2)]
    want = collections.defaultdict(lambda: [0, 0])
    for *g, a, b in zip(*(x.tolist() for x in keys + values)):
        want[tuple(g)][0] += a
        want[tuple(g)][1] += b
    found, sums = kneser_ney._sum(keys, values)
    got = [*zip(zip(*(x.tolist() for x in found)), map(list, zip(*(x.tolist() for x in sums))))]
    assert got == sorted(want.items())


def test_op1_tables_of_large_values(tmp_path):
    for values in ([[1 << 40]], [[70_000, 1, 2, 70_000]], [[3, 1 << 33], [1 << 33, 3], [3, 3]], [[1, 1, 0, 0]] * 3 + [[1 << 15, 1, 0, 1]]):
        keys, values = np.arange(1, len(values) + 1, dtype=np.uint64) << np.uint64(60), np.array(values)
        kneser_ney.Table.write(str(tmp_path / "t"), keys, values)
        assert (kneser_ney.Table(str(tmp_path / "t")).find(keys) == values).all()


def test_op1_tables(tmp_path):
    """Keys with few and many values, frequent and rare ones, and keys that aren't there."""
    r = np.random.default_rng(6)
    for n in (0, 1, 17, 50_000):
        keys = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        values = np.stack([r.zipf(1.6, len(keys)).clip(1, 1 << 40), r.integers(0, 3, len(keys))], axis=1)
        kneser_ney.Table.write(str(tmp_path / "t"), keys, values)
        t = kneser_ney.Table(str(tmp_path / "t"))
        assert (t.find(keys) == values).all()
        assert (t.find(np.sort(r.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))) == 0).all()


def test_op1_missing_files(spark, docs, monkeypatch):
    import os
    import shutil

    plain = docs.select(F.col("doc_id").alias("id"), "text")
    spec = kneser_ney.train(plain, 4, 3)
    found = kneser_ney.score(plain, spec)
    shutil.rmtree(spec["folder"])
    with pytest.raises(Exception, match="No such file"):
        found.collect()
    real = os.path.exists
    monkeypatch.setattr(kneser_ney.os.path, "exists", lambda p: "sums3-1" not in p and real(p))
    with pytest.raises(RuntimeError, match="do all executors write"):
        kneser_ney.train(plain, 4, 3)
    with pytest.raises(ValueError, match="mounted"):
        shared.local_path("hdfs://host/folder")


def test_op7_links(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(120, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:60] + r.normal(size=(60, 32)) * 0.02
    x = np.concatenate([base, near, base[:5], base[:3] * 4]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [1.0, None]), (905, [1.0, 0.0]), (0, x[0].tolist())]
    got = {q.id: q for q in itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    root = np.arange(len(y))
    for _ in range(9):
        root = np.array([min([root[i], *root[link[i]]]) for i in range(len(y))])
    right = sum(int(got[i].n_links == link[i].sum() and got[i].component_id == root[i]) for i in range(len(y)))
    assert right >= 0.9 * len(y) and sum(got[i].n_links for i in range(len(y))) <= link.sum()
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in range(900, 906))
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_op7_recall_at_large_tables(spark, monkeypatch):
    """Substrings as long as many rows ask for, and links of a cosine just above the limit."""
    monkeypatch.setattr(itq, "PER_BUCKET", 1e-6)
    r = np.random.default_rng(5)
    base = r.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    u = r.normal(size=base.shape)
    u -= (u * base).sum(axis=1, keepdims=True) * base
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    x = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * u])
    got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    link = x @ x.T >= 0.95
    assert link.sum() - len(x) >= 1200
    assert sum(q.n_links for q in got) >= 0.9 * (link.sum() - len(x))


def test_op7_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    r = np.random.default_rng(3)
    x = np.ones((100, 8)) + r.normal(size=(100, 8)) * 0.01
    got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {(q.n_links, q.component_id) for q in got} == {(99, 0)}


def test_op3_scores(spark, empty):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows, labels = [], []
    for i in range(600):
        good, rude = r.random() < 0.7, r.random() < 0.3
        w = [word() for _ in range(40)]
        if not good:
            w = [x + "%%%" for x in w]
        if rude:
            w[r.randrange(40)] = "nasty"
        rows.append((i, " ".join(w), "en", "s1" if good else "s2", 200))
        if i % 2:
            labels.append((i, int(good), int(rude)))
    rows += [(700, None, None, None, None), (701, "", "en", "s1", 0), (None, "fine words", "en", "s1", 10)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.id: x for x in cotrain.score(d, lab).collect()}
    assert len(got) == len(rows)
    hidden = [i for i in range(600) if not i % 2]
    assert np.mean([(got[i].quality_score >= 0.5) == ("%%%" not in rows[i][1]) for i in hidden]) > 0.95
    assert np.mean([(got[i].toxic_score >= 0.5) == ("nasty" in rows[i][1]) for i in hidden]) > 0.95
    assert {x.quality_score for x in cotrain.score(d, lab.where("false")).collect()} == {0.5}
    assert cotrain.score(empty, lab).count() == 0


def test_op5_layouts(spark):
    pages = [
        "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now and save.</div><article><h1>Title &amp; more</h1><p>One\n two&nbsp;<b>three</b>.<p>Second paragraph here, with words.</article><footer>&copy; me</footer>",
        None, "", "<p", "<script>x</script><style>y</style>",
        "<body><header><a href=/>Site</a></header><main><p>A long enough paragraph of text, with several words in it.</p><form><input><button>Send</button></form></main><section id=comments><h3>Comments</h3><div class=comment><p>I agree with this, thank you.</p></div></section></body>",
    ]
    d = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in dom_model.extract(d).collect()}
    first = "Title & more\nOne two three.\nSecond paragraph here, with words."
    assert got[0] == (first, len(first))
    assert all(got[i] == ("", 0) for i in (1, 2, 4))
    assert got[5][0] == "A long enough paragraph of text, with several words in it."
    assert dom_model.extract(d.where("false")).count() == 0


_LINE = "A long enough paragraph of text, with several words in it."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>One</p><div class='comment'><p>Nice read, thanks.</p></div><p>Two words more here.</p></article>", ["One", "Two words more here."]),
        (f"<article><p>{_LINE}</p><form><label>Your name here</label><button>Send</button></form><ol class=comment-list><li class=comment>First! Great.</li></ol></article>", [_LINE]),
        (f"<main><h1>T</h1><form><label>Name</label><input><p>Fill this form in please.</p></form><p>{_LINE}</p></main>", ["T", _LINE]),
        ("<body><p>Just a short page of text.</p></body>", ["Just a short page of text."]),
        ("Only text here, no markup at all.", ["Only text here, no markup at all."]),
        ("<body>Plain text in the body. It goes on.<p>And a paragraph.</p><footer>foot note</footer></body>", ["Plain text in the body. It goes on.", "And a paragraph."]),
        ("<body><nav><a href=/>Home</a></nav><article><p>Short.</p></article><footer>c</footer></body>", ["Short."]),
        ("<article><p>Energy <math><mi>E</mi></math> equals mass.</p></article>", ["Energy E equals mass."]),
        ("<body><article><svg><path d=1><p>The story goes on here, for long.</p></article>", ["The story goes on here, for long."]),
        ("<body><noscript>Please enable scripts.<article><p>The story goes on here, for long.</p></article>", ["The story goes on here, for long."]),
        (f"<body><div class=nav><a href=/>Home</a></div><div><h1>Title of it</h1><p>{_LINE}</p></div><div class=sidebar><p>{_LINE}</p></div></body>", ["Title of it", _LINE]),
        (f"<body><section class=post><h2>Head</h2><p>{_LINE}</p><aside><p>Read also this story</p></aside></section><div class='cookie-consent'>We use cookies <button>OK</button></div></body>", ["Head", _LINE]),
        ("<article data-y=abc><p>One two three four five.</p></article>", ["One two three four five."]),
        ("<main><ul><li>One thing<li>Another thing</ul><ol><li>Third</ol></main>", ["One thing", "Another thing", "Third"]),
        ("<div>" * 5000 + "<article><p>Deep text stands here, quite long." + "</b>" * 5000, ["Deep text stands here, quite long."]),
        ("<article>" + f"<p>{_LINE}</p>" * 5000 + "</article>", [_LINE] * 5000),
    ],
)
def test_op5_layouts_that_are_not_generated(page, text):
    assert dom_model.texts([page], dom_model._fitted()) == ["\n".join(text)]


def test_op5_kept_columns_and_repeats(spark):
    d = spark.createDataFrame([(1, "t", 5, f"<p>{_LINE}")] * 2 + [(None, None, None, None)], "page_id long, text string, n_chars int, html string")
    got = dom_model.extract(d, keep=("page_id", "text", "n_chars"))
    assert got.columns == ["page_id", "_text", "_n_chars", "text", "n_chars"]
    assert collections.Counter(map(tuple, got.collect())) == {(1, "t", 5, _LINE, len(_LINE)): 2, (None, None, None, "", 0): 1}


def test_op5_messages_are_exact():
    """Marginals of a small tree against all its labellings."""
    import itertools

    f = dom_model.Forest()
    for parent, leaf in ((-1, False), (0, False), (1, True), (0, True), (1, True)):
        f.node(0, parent, leaf, [dom_model._LEAF + len(f.parent)], 0)
    r = np.random.default_rng(0)
    w, pair = np.zeros(dom_model.WIDTH), r.normal(size=(dom_model.KINDS, 2, 2))
    w[dom_model._LEAF : dom_model._LEAF + 5] = own = r.normal(size=5)
    p, _ = dom_model.Messages(f).run(w, pair)
    total = np.zeros((5, 2))
    for y in itertools.product((0, 1), repeat=5):
        e = math.exp(sum(own[i] * y[i] for i in range(5)) + sum(pair[int(f.leaf[i]), y[f.parent[i]], y[i]] for i in range(1, 5)))
        for i in range(5):
            total[i, y[i]] += e
    assert np.allclose(p, total / total.sum(axis=1, keepdims=True))


def test_op5_held_out_layouts():
    f = dom_model.Forest()
    for i, p in enumerate(dom_model.labelled_pages(80, 77)):
        f.add(i, p, True)
    belief, _ = dom_model.Messages(f).run(*dom_model._fitted())
    leaf = np.array(f.leaf)
    assert ((belief[:, 1] >= 0.5) == np.array(f.label))[leaf].mean() > 0.98


def test_op3_repeats_long_texts_and_clashing_names(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(("ab", "cd", "ef")) for _ in range(30))
    rows = [(i, good() if i % 3 else good().replace(" ", " %% "), "en", "s", 90, 7, 0.25) for i in range(240)]
    rows += [(500, "ab cd " * 100_000, "en", "s", 600_000, 7, 0.25), (501, "%% ab " * 100_000, None, None, None, None, None)] + [rows[3]] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, quality_score double")
    lab = spark.createDataFrame([(i, int(i % 3 > 0), 0, "x") for i in range(0, 200)] * 2, "doc_id long, quality int, toxic int, text string")
    got = cotrain.score(d, lab).collect()
    assert len(got) == len(rows) and len({x.quality_score for x in got if x.id == 3}) == 1
    score = {x.id: x.quality_score for x in got}
    assert all((score[i] >= 0.5) == (i % 3 > 0) for i in range(200, 240)) and 0 <= score[500] <= 1 and score[501] < 0.5
    assert {x.toxic_score for x in got} == {1 / 202}


def test_op7_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 5, "a", 3), (2, [1.0, 0.01], 5, "b", 3), (3, [0.0, 1.0], 5, None, None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, bucket string, copies int")
    assert {(x.id, x.n_links, x.component_id) for x in itq.near_duplicates(d).collect()} == {(1, 1, 1), (2, 1, 1), (3, 0, 3)}


def test_pipeline_null_ids_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as c

    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, "en", "s", 9), (2, text, "en", None, None), (3, None, None, "s", 0), (None, text, "en", "s", 9), (None, "some words alone", None, None, None), (4, "12 34", "en", "s", 5), (5, "a b c d e f g item here", "en", "s", 9), (5, "a b c d e f g item here", "en", "s", 9)]
    for name, own in (("some", rows), ("none", [])):
        spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(0, "f g item here")] if own else [], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = collections.Counter(r.doc_id for r in c.run(spark, str(tmp_path / "some")).collect())
    assert got == {1: 1, None: 2}
    assert c.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_language_model_is_of_all_rows(spark):
    """Languages that only rows of remainder 1 by 3, or without an id, tell; such rows and others stay."""
    import corpus_pipeline as c

    told = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "the cat sat on the mat", "en" if i in told else None) for i in range(40)] + [(None, "der hund und die katze", "de"), (50, "12 34", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in c.language(spark, d, "").collect()} == {*range(40), None}


def test_pipeline(spark, docs, rows, tmp_path):
    """Each stage on its predecessor's rows, against the operators' brute force where that is short."""
    import corpus_pipeline as c

    plain = [(i, t) for i, t in rows if i is not None and i < 64]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in plain], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    item = [t for i, t in plain if i == 5][0]
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = dict(c.STAGES)
    one = stage["language_id"](spark, d, str(tmp_path))
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, t in plain if any(x.isalpha() for x in t or ""))
    two = shared.materialize(stage["simhash_near_dedup"](spark, one, str(tmp_path)), "two")
    three = shared.materialize(stage["substring_dedup"](spark, two, str(tmp_path)), "three")
    assert three.columns == d.columns and three.count() == two.count()
    want = repeats([(r.doc_id, r.text) for r in two.collect()])
    assert sum(r.n_chars for r in three.collect()) < sum(r.n_chars for r in two.collect()) and sum(k[2] * n for k, n in want.items()) > 0
    four = stage["decontamination"](spark, three, str(tmp_path))
    left = {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()}
    assert 5 in left
    out = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in four.collect()}
    assert all(len(r.ids) == r.n_tokens for r in out)
