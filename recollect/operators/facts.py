"""Reading facts, summaries and topics, and what is kept beside the log."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import KINDS, TOPIC_KINDS

#: Sections of a session's own notes, which stand in where nothing was retrieved.
NOTES = ("user_profile", "shared_moments", "promises", "commitments", "her_self")
EDITABLE = ("subject", "predicate", "object", "importance", "persona_attention", "due", "kind")
TEXT_MAX = 200


class EditError(ValueError):
    """A field's value isn't allowed."""


def list_order() -> list[Column]:
    return [F.desc("pinned"), F.desc("importance"), F.desc("persona_attention"), F.asc("id")]


def is_open() -> Column:
    """Still valid."""
    return F.coalesce("valid_to", F.lit("")) == ""


def is_live() -> Column:
    return (F.col("status") == "active") & is_open()


def list_facts(facts: DataFrame, status: str | None = None, include_dead: bool = False) -> DataFrame:
    """Live facts; all with ``include_dead``; with ``status`` those, whether or not still valid."""
    if status:
        return facts.where(F.col("status") == status)
    return facts if include_dead else facts.where(is_live())


def pending(facts: DataFrame) -> DataFrame:
    return list_facts(facts, "pending")


def fetch(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts of the ``uid, id`` rows."""
    return facts.join(ids.select("uid", "id").distinct(), ["uid", "id"], "left_semi")


def history(ops: DataFrame, fact_id: str = "") -> DataFrame:
    return (ops.where(F.col("id") == fact_id) if fact_id else ops).orderBy("uid", "seq")


def stats(facts: DataFrame) -> DataFrame:
    live = (F.col("status") == "active") & is_open()
    return facts.groupBy("uid").agg(F.count("*").alias("total"), F.count_if(live).alias("live"), F.count_if(F.col("status") == "pending").alias("pending"))


def live(exclude: Column, min_confidence: float) -> Column:
    """May be shown: active and valid, and pinned or neither just said nor doubtful."""
    sure = ~F.coalesce(exclude, F.lit(False)) & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    return (F.col("status") == "active") & is_open() & (F.coalesce("pinned", F.lit(False)) | sure)


def card() -> Column:
    return T.card_text(F.col("subject"), F.col("predicate"), F.col("object"), F.col("kind"), F.col("due"))


def with_usage(facts: DataFrame, usage: DataFrame) -> DataFrame:
    """Adds ``use_count, last_used_at`` from usage events; they are never in the log."""
    sums = usage.groupBy("uid", "id").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used_at"))
    return facts.join(sums, ["uid", "id"], "left").withColumn("use_count", F.coalesce("use_count", F.lit(0)))


def material(users: DataFrame, facts: DataFrame, summaries: DataFrame, topics: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """For each ``uid`` whether there is a live fact, a summary, a topic, an unused topic, a vector; ``any_material``: one of the first three."""
    of = {"has_fact": list_facts(facts), "has_summary": summaries, "has_topic": topics, "has_open_topic": topics.where(~F.col("used"))}
    of["has_vector"] = vectors if vectors is not None else facts.where("false")
    out = users.select("uid").distinct()
    for name, rows in of.items():
        out = out.join(rows.select("uid").distinct().withColumn(name, F.lit(True)), "uid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.withColumn("any_material", F.col("has_fact") | F.col("has_summary") | F.col("has_topic"))


def recall_material(session: dict) -> bool:
    """Whether a turn has something to say: what ``_mem`` was given, or else the session's own notes."""
    found = session.get("_mem") if isinstance(session.get("_mem"), dict) else {}
    notes = session.get("memory") if isinstance(session.get("memory"), dict) else {}
    return any(isinstance(found.get(k), list) and found[k] for k in ("facts", "summaries", "topics")) or any(bool(notes.get(k)) for k in NOTES)


def context_rows(session: dict, kind: str) -> list:
    """The turn's ``facts``, ``summaries`` or ``topics``; nothing where the session holds something else."""
    found = session.get("_mem")
    rows = found.get(kind) if isinstance(found, dict) else None
    return rows if isinstance(rows, list) else []


def export(facts: DataFrame, summaries: DataFrame, topics: DataFrame, ops: DataFrame) -> DataFrame:
    """``uid, section, id, row``: all that is known of each user, a JSON text a row."""
    parts = {"facts": facts, "pending": pending(facts), "summaries": list_summaries(summaries, 100), "topics": list_topics(topics, 100, True), "ops": ops}
    out = None
    for name, rows in parts.items():
        one = rows.select("uid", F.lit(name).alias("section"), "id", F.to_json(F.struct(*(c for c in rows.columns if c != "uid"))).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def without(rows: DataFrame, users: DataFrame) -> DataFrame:
    """The rows of all but some users: a reset for good."""
    return rows.join(users.select("uid").distinct(), "uid", "left_anti")


def use_topics(topics: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Topics with those of ``chosen(uid, id)`` used; without it every one, so that none is open."""
    if chosen is None:
        return topics.withColumn("used", F.lit(True))
    mark = chosen.select("uid", "id").distinct().withColumn("_now", F.lit(True))
    return topics.join(mark, ["uid", "id"], "left").withColumn("used", F.col("used") | F.coalesce("_now", F.lit(False))).drop("_now")


def list_summaries(summaries: DataFrame, limit: int = 20) -> DataFrame:
    """The newest of each ``uid``, with their ``rank``."""
    w = Window.partitionBy("uid").orderBy(F.desc("day"), F.desc("created_at"), F.desc("id"))
    return summaries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def list_topics(topics: DataFrame, limit: int = 8, include_used: bool = False) -> DataFrame:
    """Open topics of each ``uid``, those with a date first, with their ``rank``."""
    due = F.coalesce("due_day", F.lit(""))
    w = Window.partitionBy("uid").orderBy((due == "").asc(), due.asc(), F.desc("day"), F.desc("created_at"), F.asc("id"))
    rows = topics if include_used else topics.where(~F.col("used"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def topic_stats(topics: DataFrame) -> DataFrame:
    return topics.groupBy("uid").agg(F.count("*").alias("total"), F.count_if(~F.col("used")).alias("open"))


def summary_ops(rows: DataFrame) -> DataFrame:
    """``uid, day, text`` to SUMMARY rows with content ids; blank texts are left out, equal ones are one."""
    text = F.trim("text")
    return rows.where(text != "").select("uid", T.content_id("S", F.col("day"), text, 12).alias("id"), "day", text.alias("text")).dropDuplicates(["uid", "id"])


def topic_ops(rows: DataFrame) -> DataFrame:
    """``uid, day, text, kind, due_day`` to TOPIC rows with content ids; an unknown kind is ``share``."""
    text = F.trim("text")
    kind = F.when(F.col("kind").isin(*TOPIC_KINDS), F.col("kind")).otherwise("share")
    ref = F.coalesce("ref", F.lit("")) if "ref" in rows.columns else F.lit("")
    named = rows.where(text != "").select("uid", T.content_id("TP", F.col("day"), text, 10).alias("id"), "day", text.alias("text"), kind.alias("kind"), F.substring(F.coalesce("due_day", F.lit("")), 1, 10).alias("due_day"), ref.alias("ref"))
    return named.groupBy("uid", "id", "day", "text").agg(*(F.min(c).alias(c) for c in ("kind", "due_day", "ref")))


def validate(fields: dict) -> dict:
    """The editable fields of an edit, checked; other keys are passed over."""
    out = {}
    for k, v in (fields or {}).items():
        if k not in EDITABLE:
            continue
        if k in ("importance", "persona_attention"):
            if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
                raise EditError(f"{k}: a number from 0 to 1 is wanted, not {v!r}")
            out[k] = float(v)
            continue
        s = "" if v is None else str(v).strip() if k == "due" or isinstance(v, str) else ""
        if k == "due":
            if s and not re.fullmatch(T.DATE, s):
                raise EditError("due: YYYY-MM-DD or nothing is wanted")
        elif k == "kind":
            if s not in KINDS:
                raise EditError(f"kind: one of {KINDS} is wanted")
        elif not s or len(s) > TEXT_MAX:
            raise EditError(f"{k}: 1 to {TEXT_MAX} characters are wanted, not {len(s)}")
        out[k] = s
    return out


def _lines(rows: DataFrame, order: str, line: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), line.alias("line"))))
    return rows.groupBy("uid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("view"))


def render_summaries(summaries: DataFrame, limit: int = 500) -> DataFrame:
    """``uid, view``: the newest summaries, oldest first."""
    since = F.when(F.coalesce("turn_ref", F.lit("")) != "", F.concat(F.lit("\n- since "), "turn_ref")).otherwise("") if "turn_ref" in summaries.columns else F.lit("")
    rows = list_summaries(summaries, limit).withColumn("place", -F.col("rank"))
    return _lines(rows, "place", F.concat(F.lit("## "), "day", F.lit(" "), "id", F.lit("\n"), "text", since))


def render_topics(topics: DataFrame, limit: int = 200) -> DataFrame:
    """``uid, view``: topics, used ones too, with their kind and date."""
    marks = F.concat_ws(", ", "id", "kind", F.when(F.col("used"), "used"), F.when(F.coalesce("due_day", F.lit("")) != "", F.concat(F.lit("by "), "due_day")))
    return _lines(list_topics(topics, limit, True), "rank", F.concat(F.lit("- "), F.substring("day", 1, 10), F.lit(" "), "text", F.lit(" ("), marks, F.lit(")")))


def render(facts: DataFrame) -> DataFrame:
    """``uid, view``: a readable list of live facts, and of those that ended."""
    one = F.format_string("## %s (#%s, %s, %.1f, %.1f%s)\n- %s %s (%s)", F.concat("subject", "predicate", "object"), F.col("id"), F.col("status"), F.col("importance"), F.col("persona_attention"), F.when(F.col("pinned"), ", pinned").otherwise(""), F.substring(F.coalesce("valid_from", F.lit("")), 1, 10), F.coalesce("quote", F.lit("")), F.coalesce("turn_ref", F.lit("")))
    ended = F.format_string("- %s %s: until %s", F.col("id"), F.concat("subject", "predicate", "object"), F.coalesce(F.nullif("valid_to", F.lit("")), F.lit("?")))
    shown = facts.where(((F.col("status") == "active") & is_open()) | (F.col("status") == "superseded"))
    part = F.when(F.col("status") == "active", 0).otherwise(1)
    order = F.row_number().over(Window.partitionBy("uid").orderBy(part, *list_order()))
    rows = shown.select("uid", order.alias("n"), F.when(part == 0, one).otherwise(ended).alias("line"))
    return rows.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("view"))
