"""Replay of the operation log into current facts, summaries and topics.

Each fact is a fold over its operations in log order, as a Catalyst expression: a null accumulator is a
fact that isn't there. A SUPERSEDE is two steps, the end of what it replaces and then the fact itself.
Operations of one fact are few by nature; those that can't change it, before its last full write or purge, are dropped
before they are gathered, so a rewritten fact's history isn't held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FACT_FIELDS

KNOWN = ("ADD", "SUPERSEDE", "EDIT", "INVALIDATE", "PIN", "CONFIRM", "FORGET", "MERGE", "DEROGATE", "SUMMARY", "TOPIC")
DEFAULTS = {"kind": "fact", "confidence": 0.7, "importance": 0.5, "persona_attention": 0.5, "pinned": False, "status": "active", "source": "extract", "subject": "", "predicate": "", "object": "", "quote": "", "turn_ref": ""}
_FACT = ", ".join(f"{n}: {t}" for n, t in FACT_FIELDS)
STATE = f"struct<{_FACT}, first_seq: bigint>"


def steps(ops: DataFrame, today: str) -> DataFrame:
    """Log operations on facts to steps ``uid, id, seq, sub, step, ...``."""
    day = F.coalesce(F.nullif(F.substring("ts", 1, 10), F.lit("")), F.lit(today))
    rows = ops.where(F.col("op").isin(*KNOWN[:9]) & (F.coalesce("id", F.lit("")) != "")).withColumn("op_day", day)
    both = F.when(
        (F.col("op") == "SUPERSEDE") & (F.coalesce("replaces", F.lit("")) != ""),
        F.array(F.struct(F.lit(0).alias("sub"), F.lit("END").alias("step"), F.col("replaces").alias("target")), F.struct(F.lit(1).alias("sub"), F.lit("ADD").alias("step"), F.col("id").alias("target"))),
    ).otherwise(F.array(F.struct(F.lit(1).alias("sub"), F.when(F.col("op") == "SUPERSEDE", "ADD").otherwise(F.col("op")).alias("step"), F.col("id").alias("target"))))
    rows = rows.withColumn("s", F.explode(both))
    return rows.withColumns({"sub": F.col("s.sub"), "step": F.col("s.step"), "id": F.col("s.target")}).drop("s")


def _apply(acc: Column, o: Column) -> Column:
    """The state after one step."""

    def written() -> Column:
        out = []
        for n, t in FACT_FIELDS:
            v = F.coalesce(o[n], F.nullif(o["op_day"], F.lit(""))) if n == "valid_from" else F.coalesce(o[n], F.lit(DEFAULTS[n])) if n in DEFAULTS else o[n]
            out.append(v.cast(t).alias(n))
        return F.struct(*out, F.coalesce(acc["first_seq"], o["seq"]).alias("first_seq")).cast(STATE)

    def edited(n: str, t: str) -> Column:
        return F.when(F.map_contains_key(o["edits"], F.lit(n)), F.element_at(o["edits"], F.lit(n)).try_cast(t)).otherwise(acc[n])

    def changed(**new: Column) -> Column:
        return F.struct(*(F.coalesce(new[n], F.lit(None).cast(t)).cast(t).alias(n) if n in new else acc[n].alias(n) for n, t in FACT_FIELDS), acc["first_seq"].alias("first_seq")).cast(STATE)

    none, step = F.lit(None).cast(STATE), o["step"]
    has_edits = o["edits"].isNotNull()
    return (
        F.when(step == "ADD", written())
        .when(acc.isNull(), none)
        .when(step == "END", changed(status=F.lit("superseded"), valid_to=o["op_day"]))
        .when((step == "EDIT") & has_edits, F.struct(*(edited(n, t).cast(t).alias(n) for n, t in FACT_FIELDS), acc["first_seq"].alias("first_seq")).cast(STATE))
        .when(step == "INVALIDATE", changed(status=F.lit("superseded"), valid_to=F.coalesce(F.nullif(o["valid_to"], F.lit("")), o["op_day"])))
        .when(step == "PIN", changed(pinned=F.coalesce(o["pinned"], F.lit(False))))
        .when((step == "CONFIRM") & (F.coalesce(o["status"], F.lit("active")) == "active"), changed(status=F.lit("active"), valid_to=F.lit(None)))
        .when(step == "CONFIRM", changed(status=o["status"]))
        .when((step == "FORGET") & (F.coalesce(o["mode"], F.lit("archive")) == "purge"), none)
        .when(step == "FORGET", changed(status=F.lit("forgotten"), valid_to=o["op_day"]))
        .when((step == "MERGE") & (acc["status"] == "active"), changed(status=F.lit("merged"), valid_to=o["op_day"]))
        .when((step == "DEROGATE") & o["importance"].isNotNull(), changed(importance=o["importance"]))
        .otherwise(acc)
    )


def facts(ops: DataFrame, today: str, base: DataFrame | None = None) -> DataFrame:
    """Current facts from the log; with ``base`` (facts so far) ``ops`` are only the new ones."""
    s = steps(ops, today)
    w = Window.partitionBy("uid", "id").orderBy("seq", "sub").rowsBetween(0, Window.unboundedFollowing)
    # a full write makes what came before it void, but for the place of the first one
    first = F.min(F.when(F.col("step") == "ADD", F.col("seq"))).over(Window.partitionBy("uid", "id"))
    purge = (F.col("step") == "FORGET") & (F.coalesce("mode", F.lit("archive")) == "purge")
    s = s.withColumns({"later": F.max(F.when(F.col("step") == "ADD", 1)).over(w.rowsBetween(1, Window.unboundedFollowing)), "opened": first, "purges": F.max(purge.cast("int")).over(Window.partitionBy("uid", "id"))})
    s = s.where(F.col("later").isNull() | (F.col("purges") == 1))
    fields = ["seq", "sub", "step", "op_day", "mode", "edits", *(n for n, _ in FACT_FIELDS)]
    order = F.sort_array(F.collect_list(F.struct("seq", "sub", F.struct(*fields).alias("o"))))
    # a map can't be ordered: edits travel as entries
    s = s.withColumn("edits", F.map_entries("edits"))
    grouped = s.groupBy("uid", "id").agg(order.alias("steps"), F.min("opened").alias("opened"), F.max("purges").alias("purges"))
    start = F.lit(None).cast(STATE)
    if base is not None:
        old = base.select("uid", "id", F.struct(*(n for n, _ in FACT_FIELDS), "first_seq").cast(STATE).alias("old"))
        grouped = grouped.join(old, ["uid", "id"], "left")
        start = F.col("old")
    ops_of = F.transform("steps", lambda x: x["o"].withField("edits", F.map_from_entries(x["o"]["edits"])))
    done = grouped.select("uid", "id", F.aggregate(ops_of, start, _apply).alias("f"), "opened", "purges").where("f is not null")
    keep = F.when((F.col("purges") == 0) & (F.col("opened") < F.col("f.first_seq")), F.col("opened")).otherwise(F.col("f.first_seq"))
    out = done.select("uid", "id", *(F.col(f"f.{n}").alias(n) for n, _ in FACT_FIELDS), keep.alias("first_seq"))
    if base is None:
        return out
    return base.join(s.select("uid", "id").distinct(), ["uid", "id"], "left_anti").select(*out.columns).unionByName(out)


def fact(ops: DataFrame, uid: str, fact_id: str, today: str) -> DataFrame:
    """One fact, folded from its own operations only: the filter reaches the scan of the log."""
    own = ops.where((F.col("uid") == uid) & ((F.col("id") == fact_id) | (F.col("replaces") == fact_id)))
    return facts(own, today).where(F.col("id") == fact_id)


def last_fact_ids(ops: DataFrame) -> DataFrame:
    """``uid, seq``: the greatest number that the log ever gave to a fact, whether or not it is still there; new ids go on from it."""
    number = F.regexp_extract("id", r"^F-(\d+)$", 1).try_cast("long")
    return ops.groupBy("uid").agg(F.coalesce(F.max(number), F.lit(0)).cast("long").alias("seq"))


def _latest(ops: DataFrame, kind: str) -> DataFrame:
    w = Window.partitionBy("uid", "id").orderBy(F.desc("seq"))
    return ops.where((F.col("op") == kind) & (F.coalesce("id", F.lit("")) != "")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def summaries(ops: DataFrame) -> DataFrame:
    """The last SUMMARY of each id."""
    return _latest(ops, "SUMMARY").select("uid", "id", "day", "created_at", "text", "turn_ref")


def topics(ops: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """The last TOPIC of each id; ``used(uid, id, seq)`` marks it if it came after that."""
    rows = _latest(ops, "TOPIC")
    if used is None:
        rows = rows.withColumn("used", F.lit(False))
    else:
        last = used.groupBy("uid", "id").agg(F.max("seq").alias("used_seq"))
        rows = rows.join(last, ["uid", "id"], "left").withColumn("used", F.coalesce(F.col("used_seq") >= F.col("seq"), F.lit(False)))
    return rows.select("uid", "id", "day", "created_at", "kind", "text", "due_day", "ref", "used")


def bad_ops(ops: DataFrame) -> DataFrame:
    """Operations of no known kind or without an id: they have no effect."""
    return ops.where(~F.coalesce(F.col("op").isin(*KNOWN), F.lit(False)) | (F.coalesce("id", F.lit("")) == ""))
