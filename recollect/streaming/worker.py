"""Structured Streaming: current facts from a stream of operations, and when to read a user's new turns."""

from __future__ import annotations

import datetime as dt
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Config, Persona
from ..operators import extract as X
from ..operators import facts as FA
from ..operators import replay
from ..operators import turns as TU
from ..schemas import FACTS, OPS
from ..sources.tables import Folder


def ops_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", files).parquet(path)


def _versions(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """Of each bucket the epochs that wrote it, ascending."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs, out = p.getFileSystem(spark._jsc.hadoopConfiguration()), {}
    for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/epoch=*/bucket=*")) or []:
        path = s.getPath()
        out.setdefault(int(path.getName().split("=")[1]), []).append(int(path.getParent().getName().split("=")[1]))
    return {b: sorted(e) for b, e in out.items()}


def facts_at(spark: SparkSession, root: str, epoch: int, buckets: set[int] | None = None) -> DataFrame | None:
    """The facts after a micro-batch, or those before it: of each bucket the latest version so far. None if there are none yet."""
    paths = []
    for b, epochs in _versions(spark, root).items():
        known = [e for e in epochs if e <= epoch]
        if known and (buckets is None or b in buckets):
            paths.append(f"{root}/epoch={known[-1]}/bucket={b}")
    return spark.read.schema(FACTS).parquet(*paths) if paths else None


def maintain_facts(ops: DataFrame, root: str, today: str, keep: int = 3, count: int = 64):
    """A writer that folds each micro-batch into the facts before it.

    Facts lie in ``count`` buckets of users. A batch reads and writes anew only the buckets whose users it has operations of, as
    a version of its own, so a batch that runs again gives the same result. Of each bucket the last ``keep`` versions stay.
    Start it with ``.start()`` or ``.trigger(...)``.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.crc32(F.col("uid").cast("binary")), F.lit(count)).cast("int")
        batch = batch.persist()
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}
        if touched:
            base = facts_at(spark, root, epoch - 1, touched) if epoch else None
            rows = replay.facts(batch, today, base).withColumn("bucket", bucket)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/epoch={epoch}")
            _mark_emptied(spark, f"{root}/epoch={epoch}", touched)
            p = spark._jvm.org.apache.hadoop.fs.Path(root)
            fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
            for b, epochs in _versions(spark, root).items():
                for old in epochs[:-keep] if b in touched else ():
                    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/epoch={old}/bucket={b}"), True)
        batch.unpersist()

    return ops.writeStream.foreachBatch(fold).option("checkpointLocation", os.path.join(root, "_checkpoint"))


def _mark_emptied(spark: SparkSession, folder: str, buckets: set[int]) -> None:
    """A bucket whose last fact was purged gets an empty version, so that the one before doesn't count."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for b in buckets:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket={b}")
        if not fs.exists(at):
            spark.createDataFrame([], FACTS).write.mode("overwrite").parquet(at.toString())


_STATE, _OUT = "rounds long, done long, last_ts double", "uid string, reason string, rounds long"


def triggers(turns: DataFrame, idle_min: int = 30, max_turns: int = 200, ttl_min: int = 24 * 60) -> DataFrame:
    """``uid, reason, rounds`` whenever a user's turns (stream of ``uid, role, ts`` seconds) are due: ``turns`` by their number, ``idle`` by silence.

    A user with nothing due who is silent for ``ttl_min`` more is forgotten; ``rounds`` then count from the return.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rounds, done, last = state.get if state.exists else (0, 0, 0.0)
        reason = ""
        if state.hasTimedOut:
            if rounds <= done:
                state.remove()
                return
            reason = "idle"
        for p in parts:
            rounds += int((p.role == "user").sum())
            last = max(last, float(p.ts.max()))
        if not reason and rounds - done >= max_turns:
            reason = "turns"
        if reason:
            yield pd.DataFrame({"uid": [key[0]], "reason": [reason], "rounds": [rounds]})
            done = rounds
        state.update((rounds, done, last))
        state.setTimeoutDuration((idle_min if rounds > done else ttl_min) * 60_000)

    return turns.groupBy("uid").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def extract_users(folder: Folder, users: DataFrame, model, now: str, cfg: Config = Config(), persona: Persona = Persona()) -> dict:
    """Reads the new turns of all ``users(uid)`` with the model, in one plan, and logs what they hold.

    The model's answers are written first, so they are asked for once. A user's cursor moves past the chunks before the first
    that failed, and is written last: a run that breaks off is repeated, and what it logged already resolves to nothing new.
    """
    spark = folder.spark
    users = users.select("uid").where(F.coalesce("uid", F.lit("")) != "").distinct()
    own = lambda table: folder.read(table).join(users, "uid", "left_semi")
    turns, ops = own("turns"), own("ops")
    state = TU.state(turns, own("cursor")).withColumn("done", F.col("extracted_rounds"))
    done = TU.clamp_cursor(state.withColumn("claimed", F.col("done"))).select("uid", F.col("cursor").cast("long").alias("rounds"))
    chunks = TU.chunks(turns, done, cfg.extract_max_calls)
    answers = X.call_model(X.prompt_lines(TU.lines(turns, chunks)), model, cfg.extract_max_tokens, cfg.extract_tokens_per_turn)
    path = f"{folder.root}/answers/{uuid.uuid4().hex}"
    answers.write.parquet(path)
    answers = spark.read.schema(answers.schema).parquet(path)
    bad = answers.where("status = 'failed'").groupBy("uid").agg(F.min("chunk").alias("bad"))
    good = answers.join(bad, "uid", "left").where(F.col("bad").isNull() | (F.col("chunk") < F.col("bad"))).drop("bad")
    rows = X.clean(X.verify(X.candidates(good), turns, cfg.pending_tolerance), persona.name)
    last = ops.groupBy("uid").agg(F.max("seq").alias("seq"))
    found = X.ops_of(X.resolve(rows, replay.facts(ops, now[:10]), replay.last_fact_ids(ops)))
    ok = good.where("status = 'ok'")
    summaries = FA.summary_ops(ok.select("uid", "day", X.parse_summary(F.col("raw")).alias("text"))).withColumns({"op": F.lit("SUMMARY"), "turn_ref": F.lit("")})
    listed = ok.select("uid", "day", F.explode(X.parse_topics(F.col("raw"), F.col("day"))).alias("t")).select("uid", "day", "t.*")
    topics = FA.topic_ops(listed).withColumn("op", F.lit("TOPIC"))
    names = [x.split(" ", 1) for x in OPS.split(", ")]
    wide = lambda df, part: df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names), F.lit(part).alias("_part"))
    both = wide(found, 0).unionByName(wide(summaries.withColumn("created_at", F.lit(now)), 1)).unionByName(wide(topics.withColumn("created_at", F.lit(now)), 2))
    n = F.row_number().over(Window.partitionBy("uid").orderBy("_part", "seq", "id"))
    both = both.withColumn("_n", n).join(last.withColumnRenamed("seq", "_last"), "uid", "left")
    both = both.withColumns({"seq": (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long"), "ts": F.lit(now)}).select(*(x for x, _ in names))
    staged = f"{path}-ops"
    both.write.parquet(staged)
    both = spark.read.schema(both.schema).parquet(staged)
    read = good.groupBy("uid").agg(F.sum("n_user").alias("read")).join(done, "uid", "left")
    cursor = read.select("uid", (F.coalesce("rounds", F.lit(0)) + F.col("read")).cast("long").alias("rounds"))
    folder.append("ops", both)
    folder.append("model_usage", X.model_usage(answers).withColumn("ts", F.lit(now)))
    folder.append("cursor", cursor)
    return {"users": read.count(), "ops": both.count()}


def extract_due(due: DataFrame, folder: Folder, model, checkpoint: str, now=None, cfg: Config = Config(), persona: Persona = Persona()):
    """A writer that reads the turns of users as they come due (stream of ``triggers``),."""

    def batch(users: DataFrame, epoch: int) -> None:
        if not users.isEmpty():
            stamp = now() if now else dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S")
            extract_users(folder, users, model, stamp, cfg, persona)

    return due.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)


def session_counts(turns: DataFrame, gap: int = 600, late: str = "1 hour") -> DataFrame:
    """Messages of each session of a stream of ``uid, ts``; later rows than ``late`` don't reopen one."""
    return turns.withWatermark("ts", late).groupBy("uid", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n")).select("uid", "w.start", "w.end", "n")
