"""Conversation turns: from messages to numbered rows, and what is read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HER_LINES, HER_CHARS, CHUNK = 16, 160, 40


def normalise(messages: DataFrame) -> DataFrame:
    """``uid, pos, role, text`` messages to turns ``uid, turn_no, user, assistant``.

    A turn ends where an assistant message is followed by a user's. Any role but ``user`` counts as the
    assistant; blank messages are left out; a turn's user messages are joined by a line break.
    """
    text, user = F.trim(F.coalesce("text", F.lit(""))), F.lower(F.trim(F.coalesce("role", F.lit("")))) == "user"
    rows = messages.select("uid", "pos", text.alias("text"), user.alias("is_user")).where("text <> ''")
    w = Window.partitionBy("uid").orderBy("pos")
    starts = F.when(F.lag("is_user").over(w).isNull() | (F.col("is_user") & ~F.lag("is_user").over(w)), 1).otherwise(0)
    rows = rows.withColumn("starts", starts).withColumn("turn_no", F.sum("starts").over(w))

    def texts(mine: Column) -> Column:
        part = F.filter(F.array_sort(F.collect_list(F.struct("pos", "text", "is_user"))), lambda x: x["is_user"] == mine)
        return F.transform(part, lambda x: x["text"])

    out = rows.groupBy("uid", "turn_no").agg(texts(F.lit(True)).alias("u"), texts(F.lit(False)).alias("assistant"))
    return out.select("uid", "turn_no", F.when(F.size("u") > 0, F.array_join("u", "\n")).alias("user"), "assistant")


def number(turns: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Turns (``uid, turn_no, day, user, assistant``) to one row a message with ids ``T-000001`` on, after ``last(uid, seq)``."""
    said = F.concat(F.array(F.struct(F.lit("user").alias("role"), F.col("user").alias("text"))), F.transform(F.coalesce("assistant", F.array().cast("array<string>")), lambda x: F.struct(F.lit("assistant").alias("role"), x.alias("text"))))
    rows = turns.select("uid", "turn_no", "day", F.posexplode(said).alias("part", "m")).select("uid", "turn_no", "day", "part", "m.role", "m.text")
    rows = rows.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    seq = F.row_number().over(Window.partitionBy("uid").orderBy("turn_no", "part")).cast("long")
    rows = rows.withColumn("seq", seq)
    if last is not None:
        rows = rows.join(last.select("uid", F.col("seq").alias("before")), "uid", "left").withColumn("seq", F.col("seq") + F.coalesce("before", F.lit(0))).drop("before")
    return rows.withColumn("id", F.format_string("T-%06d", "seq"))


def counters(rows: DataFrame) -> DataFrame:
    """Rounds, rounds in which the user spoke, and the last id, of each ``uid``."""
    spoke = F.count_distinct(F.when(F.col("role") == "user", F.col("turn_no")))
    return rows.groupBy("uid").agg(F.count_distinct("turn_no").alias("rounds"), spoke.alias("user_rounds"), F.count("*").alias("messages"), F.max_by("id", "seq").alias("last_turn_id"))


def user_turns(rows: DataFrame) -> DataFrame:
    return rows.where("role = 'user'")


def tenants(rows: DataFrame) -> DataFrame:
    """Every ``uid`` that ever spoke."""
    return rows.select("uid").where(F.coalesce("uid", F.lit("")) != "").distinct()


def state(rows: DataFrame, cursor: DataFrame | None = None) -> DataFrame:
    """What is known of each ``uid``: its counters and the rounds read so far (``cursor(uid, rounds)``, 0 if it has none)."""
    spoke = F.count_if(F.col("role") == "user").alias("user_rounds")
    out = rows.groupBy("uid").agg(F.count("*").alias("messages"), spoke, F.max_by("id", "seq").alias("last_turn_id"), F.max("day").alias("last_day"))
    if cursor is None:
        return out.withColumn("extracted_rounds", F.lit(0).cast("long"))
    done = cursor.groupBy("uid").agg(F.max("rounds").cast("long").alias("extracted_rounds"))
    return out.join(done, "uid", "left").withColumn("extracted_rounds", F.coalesce("extracted_rounds", F.lit(0).cast("long")))


def recent_refs(rows: DataFrame, window: int) -> DataFrame:
    """``uid, turn_ref`` of the last ``window`` messages of each ``uid``: what was just said."""
    newest = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("seq")))
    return rows.withColumn("_n", newest).where(F.col("_n") <= max(0, window)).select("uid", F.col("id").alias("turn_ref"))


def log_stats(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Of each ``uid`` the days and bytes that are live and archived, and the messages of both (a live day hides its archived copy)."""
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).cast("long")
    one = lambda rows, prefix: rows.groupBy("uid").agg(F.count_distinct("day").alias(f"{prefix}days"), size.alias(f"{prefix}bytes"))
    turns = union_days(live.select("uid", "day"), archived.select("uid", "day")).groupBy("uid").agg(F.count("*").alias("turns"))
    out = turns.join(one(live, ""), "uid", "left").join(one(archived, "archived_"), "uid", "left")
    names = ("days", "bytes", "archived_days", "archived_bytes")
    return out.select("uid", "turns", *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names))


def stats(rows: DataFrame) -> DataFrame:
    """Days, messages and characters of each ``uid``."""
    return rows.groupBy("uid").agg(F.count_distinct("day").alias("days"), F.count("*").alias("turns"), F.sum(F.length("text")).cast("long").alias("chars"))


def chunks(rows: DataFrame, done: DataFrame | None = None, calls: int = 8, size: int = CHUNK) -> DataFrame:
    """User turns not read yet, ``size`` to a chunk, the first ``calls`` chunks of each ``uid``; ``done(uid, rounds)`` were read."""
    users = user_turns(rows).withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy("seq")))
    if done is not None:
        users = users.join(done.select("uid", "rounds"), "uid", "left").withColumn("n", F.col("n") - F.coalesce("rounds", F.lit(0))).drop("rounds")
    return users.where("n > 0").withColumn("chunk", F.floor((F.col("n") - 1) / size).cast("int")).where(F.col("chunk") < calls).drop("n")


def lines(rows: DataFrame, chunked: DataFrame) -> DataFrame:
    """Rows for the model: chunks' user turns, and the assistant rows after each, of a chunk the newest ``HER_LINES``, cut to ``HER_CHARS``."""
    w = Window.partitionBy("uid").orderBy("seq")
    tied = rows.withColumn("owner", F.last(F.when(F.col("role") == "user", F.col("seq")), ignorenulls=True).over(w))
    tied = tied.join(chunked.select("uid", F.col("seq").alias("owner"), "chunk"), ["uid", "owner"])
    newest = F.row_number().over(Window.partitionBy("uid", "chunk", "role").orderBy(F.desc("seq")))
    kept = tied.withColumn("newest", newest).where((F.col("role") == "user") | (F.col("newest") <= HER_LINES)).drop("newest")
    return kept.withColumn("text", F.when(F.col("role") == "user", F.col("text")).otherwise(F.substring("text", 1, HER_CHARS)))


def should_run(state: DataFrame, now: float | Column, idle_min: int = 30, max_turns: int = 200, force: bool = False) -> DataFrame:
    """``reason`` of each ``uid, user_rounds, done, last_ts`` (seconds): '' with nothing new, else idle, turns, forced or ''."""
    new = F.col("user_rounds") - F.col("done")
    now = now if isinstance(now, Column) else F.lit(now)
    reason = F.when(new <= 0, "").when(now - F.col("last_ts") >= idle_min * 60, "idle").when(new >= max_turns, "turns").otherwise("forced" if force else "")
    return state.withColumn("reason", reason)


def clamp_cursor(state: DataFrame) -> DataFrame:
    """``done`` never beyond the rounds there are, keeping the backlog that the state claims (``claimed - done``)."""
    backlog = F.greatest(F.lit(0), F.col("claimed") - F.col("done"))
    return state.withColumn("cursor", F.when(F.col("user_rounds") < F.col("claimed"), F.greatest(F.lit(0), F.col("user_rounds") - backlog)).otherwise(F.col("done")))


def sessions(events: DataFrame, gap: int = 600) -> DataFrame:
    """Sessions of each ``uid`` by silences over ``gap`` seconds of ``ts``: start, end and rows."""
    out = events.groupBy("uid", F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return out.select("uid", F.col("w.start").alias("first"), "last", "n")


def archive_plan(rows: DataFrame, now: str, months: int) -> DataFrame:
    """Months before the cutoff, the current one counting as the first kept; 0 months keep all."""
    by_month = rows.groupBy("uid", F.substring("day", 1, 7).alias("month")).agg(F.count_distinct("day").alias("days"), F.count("*").alias("turns"))
    if months <= 0:
        return by_month.where("false")
    cutoff = F.date_format(F.add_months(F.trunc(F.lit(now).cast("date"), "MM"), 1 - months), "yyyy-MM")
    return by_month.where(F.col("month") < cutoff)


def archive_due(state: DataFrame, today: str) -> DataFrame:
    """``uid``s whose turns weren't archived today yet, by ``last_archive`` (a day, or null)."""
    return state.where(F.coalesce("last_archive", F.lit("")) < today).select("uid")


def union_days(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Rows of both; of a day that both hold the live ones."""
    held = live.select("uid", "day").distinct()
    return live.unionByName(archived.join(held, ["uid", "day"], "left_anti"))
