"""Tables in the shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import U, mix

#: Bits of a filter of ids, whatever their number: eight MB. Beyond some ten million ids it lets more pass than is wanted, never less.
FILTER_BITS, FILTER_HASHES = 1 << 26, 4
BATCH = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (``spark.checkpoint.dir``); only where it is unset, one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="recollect-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def small_batches(spark: SparkSession) -> None:
    """Rows reach Python, and come back, in batches of ``BATCH`` at most: documents are long, and every stage between holds some batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH:
        spark.conf.set(key, str(BATCH))


def local_path(url: str) -> str:
    """The folder as workers open it: it must be mounted, since arrays are mapped from it and files written to it."""
    if "://" in url and not url.startswith("file://"):
        raise ValueError(f"{url} isn't a mounted file system; set spark.checkpoint.dir to one (file://...)")
    return url[7:] if url.startswith("file://") else url[5:] if url.startswith("file:") else url


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for each end of ``edges(a, b)``; root is the smallest node that links reach.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which end after few rounds.
    Each is two aggregations and joins on a minimum, so a hub's links are never gathered in one task.
    Null ends and loops are left out; no edges give no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = materialize(e, "links")
    seen = None
    for _ in range(rounds):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialize(small.where("a <> b").distinct(), "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _places(ids: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(FILTER_HASHES):
        yield (mix(ids.view(np.uint64), 40 + i) % U(FILTER_BITS)).astype(np.int64)


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in batches:
        if batch.schema.field(0).type == pa.int64():
            for at in _places(batch.column(0).to_numpy()):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        else:
            for body in batch.column(0):
                bits |= np.frombuffer(zstandard.decompress(body.as_py()), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(bits.tobytes(), 1)], pa.binary())], names=["bits"])


def id_filter(ids: DataFrame):
    """A broadcast Bloom filter of a column of non-null ids."""
    few = ids.mapInArrow(_fill, "bits binary")
    body = few.repartition(1).mapInArrow(_fill, "bits binary").first().bits
    return ids.sparkSession.sparkContext.broadcast(bytes(body))


def passes(filter_, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter."""
    bits = np.frombuffer(zstandard.decompress(filter_.value), np.uint8)
    keep = np.ones(len(ids), bool)
    for at in _places(ids):
        keep &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return keep
