"""Merging duplicates and letting unused facts fade, as operations for the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..schemas import OPS
from . import facts as FA


def similarity(a: Column, b: Column, ta: Column, tb: Column, floor: float) -> Column:
    """How far the shorter value is held in the longer, if that and the overlap reach the floor; else 0."""
    common = F.size(F.array_intersect(ta, tb))
    held, overlap = common / F.least(F.size(ta), F.size(tb)), common / F.size(F.array_union(ta, tb))
    empty = (F.size(ta) == 0) | (F.size(tb) == 0)
    same = F.when(F.trim(a) == F.trim(b), 1.0).otherwise(0.0)
    return F.when(empty, same).otherwise(F.when((held >= floor) & (overlap >= floor * 0.6), held).otherwise(0.0))


def duplicates(facts: DataFrame, floor: float = 0.8) -> DataFrame:
    """``uid, leader, id`` of each fact in a group of two or more: it joins the first leader of its slot that is like it."""
    rows = FA.list_facts(facts).withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy(*FA.list_order())))
    item = F.struct("n", "id", F.coalesce("object", F.lit("")).alias("object"), F.array_distinct(T.tokenize(F.col("object"))).alias("tokens"))
    slots = rows.groupBy("uid", "subject", "predicate").agg(F.sort_array(F.collect_list(item)).alias("items")).where(F.size("items") > 1)
    kind = "array<struct<id:string,leader:string,object:string,tokens:array<string>>>"

    def step(acc: Column, x: Column) -> Column:
        like = F.filter(acc, lambda y: (y["id"] == y["leader"]) & (similarity(y["object"], x["object"], y["tokens"], x["tokens"], floor) >= floor))
        leader = F.when(F.size(like) > 0, F.get(like, F.lit(0))["id"]).otherwise(x["id"])
        return F.concat(acc, F.array(F.struct(x["id"].alias("id"), leader.alias("leader"), x["object"].alias("object"), x["tokens"].alias("tokens"))))

    folded = slots.select("uid", F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("m"))
    out = folded.select("uid", F.col("m.leader").alias("leader"), F.col("m.id").alias("id"))
    return out.withColumn("size", F.count("*").over(Window.partitionBy("uid", "leader"))).where("size > 1").drop("size")


def merge_ops(facts: DataFrame, floor: float = 0.8) -> DataFrame:
    """``uid, id, merged_into``: of each group the fact with most content stays."""
    rows = duplicates(facts, floor).join(facts.select("uid", "id", "object", "confidence"), ["uid", "id"])
    obj = F.coalesce("object", F.lit(""))
    order = [T.core_len(obj).desc(), F.length(obj).asc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.asc("id")]
    w = Window.partitionBy("uid", "leader").orderBy(*order)
    rows = rows.withColumn("merged_into", F.first("id").over(w))
    return rows.where("id <> merged_into").select("uid", "id", "merged_into")


def decayed(importance: Column, floor: float = 0.05) -> Column:
    return F.greatest(F.lit(floor), F.round(importance * 0.7, 3))


def decay_ops(facts: DataFrame, now: str, cfg: Config = Config()) -> DataFrame:
    """``uid, id, importance`` of live facts (with ``last_used_at``) not used for ``consolidate_days``, neither pinned nor promised, that get less."""
    day = F.substring(F.coalesce(F.nullif("last_used_at", F.lit("")), "valid_from", F.lit("")), 1, 10)
    old = F.coalesce(F.unix_timestamp(F.try_to_date(day, "yyyy-MM-dd").cast("timestamp")), F.lit(0)) < F.unix_timestamp(F.lit(now).cast("timestamp")) - cfg.consolidate_days * 86400
    new = decayed(F.coalesce("importance", F.lit(0.0)), cfg.decay_floor)
    rows = FA.list_facts(facts).where(~F.col("pinned") & ~F.col("kind").isin("commitment", "promise") & old)
    return rows.where(new < F.coalesce("importance", F.lit(0.0))).select("uid", "id", new.alias("importance"))


def consolidate(facts: DataFrame, now: str, last_seq: DataFrame, cfg: Config = Config()) -> DataFrame:
    """MERGE and DEROGATE rows for the log, after ``last_seq(uid, seq)``; both are of the facts as they are now."""
    merge = merge_ops(facts, cfg.merge_similarity).select("uid", F.lit("MERGE").alias("op"), "id", "merged_into", F.lit(None).cast("double").alias("importance"))
    fade = decay_ops(facts, now, cfg).select("uid", F.lit("DEROGATE").alias("op"), "id", F.lit(None).cast("string").alias("merged_into"), "importance")
    rows = merge.unionByName(fade).join(last_seq.select("uid", F.col("seq").alias("before")), "uid", "left")
    n = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("op"), "id"))
    rows = rows.withColumns({"seq": (F.coalesce("before", F.lit(0)) + n).cast("long"), "ts": F.lit(now)})
    names = [x.split()[0] for x in OPS.split(", ")]
    kinds = dict(x.split() for x in OPS.split(", "))
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names))


def searchable(facts: DataFrame) -> DataFrame:
    """What the index holds: facts that are neither merged nor ended keep their text; the others count as empty."""
    text = F.when(F.col("status").isin("active", "pending"), F.concat_ws(" ", "subject", "predicate", "object")).otherwise("")
    return facts.where("status <> 'merged'").select("uid", "id", text.alias("text"))
