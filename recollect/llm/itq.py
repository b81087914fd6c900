"""Embedding near-dedup by iterative quantisation.

A rotation of the principal axes is learned on ``SAMPLE`` vectors so that their signs lose least (Gong and
Lazebnik, 2011); the signs are the code. Multi-index tables over overlapping substrings of the code,
``TABLES`` of them, bring together vectors that agree in one substring at least; the original vectors then
decide by their cosine in double precision. Substrings grow with the number of vectors only as long as
``MEET`` of the partners planted at cosine ``COSINE`` beside sampled vectors meet theirs; from there on the
buckets grow.

Equal vectors are one class at once and count as many. A bucket is compared within itself by matrix
products; one of more than ``BLOCK`` vectors is cut into blocks that meet pair by pair in tasks of their
own. A pair that meets in several tables counts in the first. No pairs leave a task: only each vector's
number of links and a spanning forest do.

Defined results: a vector that is null, zero, or has null or non-finite components links with nothing, nor do
vectors of different lengths; rows repeated as a whole are taken once; a row without id isn't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, materialize

COSINE, BITS, TABLES, BLOCK, SAMPLE, ITERATIONS = 0.95, 64, 16, 2048, 20_000, 40
PER_BUCKET = 8
MEET, PLANTED = 0.95, 4000


def learn(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection [dimensions, bits] of a sample of unit vectors."""
    mean = x.mean(axis=0)
    z = x - mean
    values, axes = np.linalg.eigh(z.T @ z)
    axes = axes[:, np.argsort(-values, kind="stable")][:, :BITS]
    v = z @ axes
    rotation = np.linalg.qr(np.random.default_rng(7).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(ITERATIONS):
        signs = np.where(v @ rotation >= 0, 1.0, -1.0)
        a, _, b = np.linalg.svd(signs.T @ v)
        rotation = b.T @ a.T
    return mean, axes @ rotation


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, projection = model
    ones = (x - mean) @ projection >= 0
    full = np.zeros((len(x), 64), bool)
    full[:, : ones.shape[1]] = ones
    return np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)


def substring(code: np.ndarray, table: int, width: int) -> np.ndarray:
    """``width`` bits from bit 4 ``table`` on, around the end."""
    s = np.uint64(4 * table % 64)
    turned = (code << s) | (code >> (np.uint64(64) - s)) if s else code
    return turned >> np.uint64(64 - width)


def meeting(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], width: int) -> float:
    """Share of unit vectors that meet a random partner at cosine ``COSINE`` in one table at least."""
    u = np.random.default_rng(9).normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.maximum(np.sqrt((u * u).sum(axis=1, keepdims=True)), 1e-300)
    apart = codes(x, model) ^ codes(COSINE * x + np.sqrt(1 - COSINE**2) * u, model)
    return float(np.any([substring(apart, t, width) == 0 for t in range(TABLES)], axis=0).mean())


def fitting_width(rows: int, models: dict, by_size: dict[int, list[np.ndarray]]) -> int:
    """Length of the substrings: for ``PER_BUCKET`` vectors a bucket, or the longest at which ``MEET`` of planted partners meet."""
    width = int(np.clip(np.log2(max(1, rows) / PER_BUCKET), 8, 24))
    for size, model in models.items():
        r = np.random.default_rng(8)
        x = np.stack(by_size[size][:PLANTED]) if size in by_size else r.normal(size=(PLANTED, size))
        x = np.tile(x, (-(-PLANTED // len(x)), 1))
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        while width > 1 and meeting(x, model, width) < MEET:
            width -= 1
    return width


def vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that hold a usable vector, and those as unit vectors in double precision."""
    at, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            a = np.array(v, np.float64)
            n = np.sqrt(a @ a)
            if np.isfinite(n) and n > 0:
                at.append(i)
                out.append(a / n)
    return np.array(at, np.int64), out


def _place(models, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = vectors(batch.column(2))
            for size in sorted({len(v) for v in found} & set(models.value)):
                pick = [k for k, v in enumerate(found) if len(v) == size]
                x = np.stack([found[k] for k in pick])
                code = codes(x, models.value[size])
                rows = batch.take(pa.array(at[pick]))
                for t in range(TABLES):
                    bucket = (np.uint64(size) << np.uint64(36)) | (np.uint64(t) << np.uint64(30)) | substring(code, t, width)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), rows.column(0), rows.column(1), pa.array(code.view(np.int64)), rows.column(2)], names=["bucket", "id", "copies", "code", "embedding"])

    return run


def _compare(width: int):
    def group(t: pa.Table) -> pa.RecordBatch | None:
        n = t.num_rows
        if n < 2:
            return None
        at, found = vectors(t.column("embedding"))
        x = np.stack(found)
        ids, copies, code = (t.column(c).to_numpy() for c in ("id", "copies", "code"))
        block, low, high = t.column("block").to_numpy(), t.column("low")[0].as_py(), t.column("high")[0].as_py()
        a, b = np.flatnonzero(block == low), np.flatnonzero(block == high)
        r, c = np.nonzero(x[a] @ x[b].T >= COSINE)
        r, c = a[r], b[c]
        keep = r < c if low == high else np.ones(len(r), bool)
        r, c = r[keep], c[keep]
        table = (t.column("bucket")[0].as_py() >> 30) & 63
        apart = code[r].view(np.uint64) ^ code[c].view(np.uint64)
        first = np.ones(len(r), bool)
        for earlier in range(table):
            first &= substring(apart, earlier, width) != 0
        r, c = r[first], c[first]
        if not len(r):
            return None
        links = np.bincount(r, weights=copies[c], minlength=n) + np.bincount(c, weights=copies[r], minlength=n)
        root = np.arange(n)
        while True:
            new = root.copy()
            np.minimum.at(new, r, root[c])
            np.minimum.at(new, c, root[r])
            new = new[new]
            if (new == root).all():
                break
            root = new
        has = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(ids[root[has]]), pa.array(links[has].astype(np.int64))], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            k = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
                if lo == hi:
                    continue
                if key is not None and tuple(k[lo]) != key:
                    if (out := group(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                key = tuple(k[lo])
                held.append(batch.slice(lo, hi - lo))
        if held and (out := group(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.take(pa.array(vectors(batch.column(1))[0]))


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, n_links, component_id`` for each id."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding")).where("id is not null")
    usable = rows.mapInArrow(_usable, rows.schema)
    same = materialize(usable.groupBy("embedding").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "vectors")
    sample = same.select("rep", "embedding").orderBy(F.xxhash64("rep", F.lit(3)), "rep").limit(SAMPLE).toArrow()
    _, found = vectors(sample.column("embedding"))
    by_size: dict[int, list[np.ndarray]] = {}
    for v in found:
        by_size.setdefault(len(v), []).append(v)
    # vectors of a length that the sample lacks are compared too: any rotation gives right links
    sizes = [r[0] for r in same.select(F.size("embedding")).distinct().collect()]
    models = {s: learn(np.stack(by_size[s])) if s in by_size else (np.zeros(s), np.eye(s)[:, :BITS]) for s in sizes}
    width = fitting_width(same.count(), models, by_size)
    kind = "bucket long, id long, copies long, code long, embedding array<double>"
    placed = same.select("rep", "copies", "embedding").mapInArrow(_place(spark.sparkContext.broadcast(models), width), kind)
    hot = placed.groupBy("bucket").count().where(F.col("count") > BLOCK).withColumn("k", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    cut = placed.join(hot, "bucket", "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("id"), "k").cast("int"))
    tasks = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "code", "embedding"
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = tasks.repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
    links = materialize(tasks.mapInArrow(_compare(width), "a long, b long, n long"), "links")
    roots = components(links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("n"))
    reps = same.join(counts, F.col("rep") == F.col("a"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    reps = reps.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    member = usable.join(reps, "embedding").groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("id").distinct().join(member, "id", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
