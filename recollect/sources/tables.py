"""The tables of a memory's folder: ``table/bucket=NN/uid=U``, so that one user's rows are read, ended or set aside by themselves."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager
from zlib import crc32

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPS, TURNS, USAGE, VECTORS

BUCKETS = 256
TABLES = {
    "turns": TURNS, "ops": OPS, "usage": USAGE, "vectors": VECTORS, "topic_usage": "uid string, id string, seq long", "cursor": "uid string, rounds long",
    "model_usage": "uid string, ts string, calls long, failed long, tin long, tout long",
}


class Busy(RuntimeError):
    """Another writer holds the user's lock."""


def bucket_of(uid: str) -> int:
    return crc32(uid.encode()) % BUCKETS


class Folder:
    """Tables under a root of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, table: str, uid: str) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return f"{self.root}/{table}/bucket={bucket_of(uid)}/uid={escape(uid)}"

    def read(self, table: str, uid: str | None = None) -> DataFrame:
        """A user's rows, or all; none where nothing was written."""
        schema = TABLES[table]
        try:
            rows = self.spark.read.schema(schema + ", bucket int").option("basePath", f"{self.root}/{table}").parquet(self.path(table, uid) if uid else f"{self.root}/{table}")
        except AnalysisException:
            rows = self.spark.createDataFrame([], schema)
        return rows.select(*(x.split(" ", 1)[0] for x in schema.split(", ")))

    def append(self, table: str, rows: DataFrame) -> None:
        names = [x.split(" ", 1)[0] for x in TABLES[table].split(", ")]
        rows = rows.where(F.coalesce("uid", F.lit("")) != "").select(*names, F.pmod(F.crc32(F.col("uid").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))
        rows.write.mode("append").partitionBy("bucket", "uid").parquet(f"{self.root}/{table}")

    def append_rows(self, table: str, rows: list[dict]) -> None:
        names = [x.split(" ", 1)[0] for x in TABLES[table].split(", ")]
        if rows:
            self.append(table, self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], TABLES[table]).coalesce(1))

    def replace(self, table: str, rows: DataFrame) -> None:
        """Sets the rows of the users in ``rows`` in place of what they had."""
        stage = f"{self.root}/_stage/{uuid.uuid4().hex}"
        rows.write.parquet(stage)
        kept = self.spark.read.schema(rows.schema).parquet(stage)
        names = [x.split(" ", 1)[0] for x in TABLES[table].split(", ")]
        kept = kept.select(*names, F.pmod(F.crc32(F.col("uid").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "uid").parquet(f"{self.root}/{table}")
        fs, p = self._fs(stage)
        fs.delete(p, True)

    def end(self, uid: str, mode: str = "purge") -> list[str]:
        """Deletes a user's rows of every table, or with ``archive`` sets them aside; the tables where that failed."""
        left, stamp = [], f"{time.strftime('%Y%m%d%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
        for table in TABLES:
            fs, p = self._fs(self.path(table, uid))
            if not fs.exists(p):
                continue
            if mode == "archive":
                _, to = self._fs(f"{self.root}/archived/{stamp}/{table}/{p.getName()}")
                fs.mkdirs(to.getParent())
                done = fs.rename(p, to)
            else:
                done = fs.delete(p, True)
            if not done:
                left.append(table)
        return left

    def write_text(self, name: str, text: str) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    @contextmanager
    def lock(self, uid: str, wait: float = 30, stale: float = 300):
        """One writer a user: a file that only one can create. One older than ``stale`` seconds was left by a dead writer."""
        fs, p = self._fs(f"{self.root}/_locks/{self.path('x', uid).rsplit('/', 1)[1]}")
        end = time.time() + wait
        while True:
            try:
                fs.create(p, False).close()
                break
            except Exception as e:  # py4j hides which exception of the file system it is
                if not fs.exists(p):
                    raise
                if time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > stale:
                    fs.delete(p, False)
                elif time.time() > end:
                    raise Busy(uid) from e
                else:
                    time.sleep(0.05)
        try:
            yield
        finally:
            fs.delete(p, False)
