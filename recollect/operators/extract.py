"""From a model's answer to log operations: parsing, evidence, cleaning, conflicts within a slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Persona
from ..functions import text as T
from ..schemas import KINDS, TOPIC_KINDS

FACT = "struct<turn_ref:string,quote:string,subject:string,predicate:string,object:string,kind:string,due:string,confidence:string,importance:string,persona_attention:string>"
TOPIC = "struct<text:string,kind:string,due_day:string,ref:string>"
HER = "她"
HIM = "他"
TOPICS_MAX, TOPIC_CHARS, REF_CHARS, SUMMARY_CHARS = 3, 60, 12, 500


def _first(columns: list[Column]) -> Column:
    return F.coalesce(*columns)


def parse_facts(raw: Column) -> Column:
    """The array of facts of an answer: an object's ``facts``, or a bare array; empty for what can't be read."""
    inside = [F.from_json(F.get_json_object(c, "$.facts"), f"array<{FACT}>") for c in T.json_candidates(raw)]
    bare = F.nullif(F.regexp_extract(raw, r"\[[\s\S]*\]", 0), F.lit(""))
    arrays = [F.from_json(x, f"array<{FACT}>") for x in (bare, F.regexp_replace(bare, r",\s*([}\]])", "$1"))]
    return F.filter(_first([*inside, *arrays, F.array().cast(f"array<{FACT}>")]), lambda x: x.isNotNull())


def parse_summary(raw: Column) -> Column:
    found = _first([*(F.get_json_object(c, "$.summary") for c in T.json_candidates(raw)), F.lit("")])
    return F.substring(F.trim(found), 1, SUMMARY_CHARS)


def parse_topics(raw: Column, day: Column) -> Column:
    """The first valid topics: cut to size, of known kind, with a date or none."""
    rows = _first([*(F.from_json(F.get_json_object(c, "$.topics"), f"array<{TOPIC}>") for c in T.json_candidates(raw)), F.array().cast(f"array<{TOPIC}>")])
    named = F.slice(F.filter(rows, lambda x: F.trim(F.coalesce(x["text"], F.lit(""))) != ""), 1, TOPICS_MAX)
    dated = F.transform(named, lambda x: F.struct(x.alias("t"), T.absolutize(F.trim(F.coalesce(x["due_day"], F.lit(""))), day).alias("due"), F.lower(F.trim(F.coalesce(x["kind"], F.lit("share")))).alias("kind")))
    return F.transform(
        dated,
        lambda x: F.struct(
            F.substring(F.trim(x["t"]["text"]), 1, TOPIC_CHARS).alias("text"),
            F.when(x["kind"].isin(*TOPIC_KINDS), x["kind"]).otherwise("share").alias("kind"),
            F.when(x["due"].rlike(f"^{T.DATE}$"), x["due"]).otherwise("").alias("due_day"),
            F.substring(F.trim(F.coalesce(x["t"]["ref"], F.lit(""))), 1, REF_CHARS).alias("ref"),
        ),
    )


def coverage(quote: Column, body: Column) -> Column:
    """The share of the quote's tokens that a normalised text holds."""
    tokens = F.filter(T.tokenize(quote), lambda t: T.norm(t) != "")
    held = F.filter(tokens, lambda t: F.contains(body, T.norm(t)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(held) / F.size(tokens))


def verify(candidates: DataFrame, turns: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Adds ``verdict`` (active, pending, drop) and ``score`` by the one turn a candidate refers to.

    Candidates: ``uid, seq`` and a fact's fields. No such turn, no quote, or the assistant's words for what isn't its own: drop.
    """
    said = turns.select("uid", F.col("id").alias("turn_ref"), F.col("role").alias("turn_role"), F.col("text").alias("turn_text"), F.col("day").alias("turn_day"))
    rows = candidates.withColumn("turn_ref", F.trim(F.coalesce("turn_ref", F.lit("")))).join(said, ["uid", "turn_ref"], "left")
    quote = F.trim(F.coalesce("quote", F.lit("")))
    own = (F.lower(F.trim(F.coalesce("kind", F.lit("")))) == "promise") | (F.trim(F.coalesce("subject", F.lit(""))) == HER)
    heard = (F.col("turn_role") == "user") | ((F.col("turn_role") == "assistant") & own)
    usable = (F.col("turn_ref") != "") & F.col("turn_role").isNotNull() & F.coalesce(heard, F.lit(False)) & (quote != "")
    rows = rows.withColumn("_body", T.norm(F.col("turn_text")))
    rows = rows.withColumn("_whole", F.contains("_body", T.norm(quote)))
    whole = F.col("_whole")
    rows = rows.withColumn("share", F.when(usable & ~whole, coverage(quote, F.col("_body"))).otherwise(0.0))
    verdict = F.when(~usable, "drop").when(whole, "active").when(F.col("share") >= tolerance, "pending").otherwise("drop")
    score = F.when(usable & whole, 1.0).otherwise(F.round("share", 3))
    return rows.withColumns({"verdict": verdict, "score": score}).drop("share", "_body", "_whole")


def clean(rows: DataFrame, persona_name: str = HER) -> DataFrame:
    """Verified candidates to storable facts; those with hardly any content go."""
    kind = F.lower(F.trim(F.coalesce("kind", F.lit("fact"))))
    kind = F.when(kind.isin(*KINDS), kind).otherwise("fact")
    subject = F.when((kind == "promise") | (F.trim(F.coalesce("subject", F.lit(""))) == HER), persona_name).otherwise(HIM)
    predicate = F.substring(F.trim(F.coalesce("predicate", F.lit(""))), 1, 80)
    obj = F.substring(F.trim(F.coalesce("object", F.lit(""))), 1, 200)
    day = F.substring("turn_day", 1, 10)
    kept = rows.where((F.col("verdict") != "drop") & (F.length(predicate) + F.length(obj) >= 2))
    return kept.select(
        "uid", "seq", subject.alias("subject"), predicate.alias("predicate"), T.absolutize(obj, day).alias("object"), kind.alias("kind"),
        T.norm_due(F.col("due"), day).alias("due"), "turn_ref", F.substring(F.coalesce("quote", F.lit("")), 1, 300).alias("quote"),
        T.clamp(F.col("confidence"), 0, 1, 0.7).alias("confidence"), T.clamp(F.col("importance"), 0, 1, 0.5).alias("importance"),
        T.clamp(F.col("persona_attention"), 0, 1, 0.5).alias("persona_attention"), day.alias("valid_from"), F.lit("extract").alias("source"),
        F.col("verdict").alias("status"),
    )


def resolve(candidates: DataFrame, facts: DataFrame, last: DataFrame | None = None, pending_supersedes: bool = True) -> DataFrame:
    """What each candidate (``uid, seq, subject, predicate, object``) does: ``action`` ADD, SUPERSEDE or NOOP, its ``id``, and ``replaces``.

    Ids go on after ``last(uid, seq)``. A slot's first new value supersedes the first active fact, a later one that
    before it; a value that is there already does nothing. Without ``pending_supersedes`` a pending
    candidate is only added.
    """
    slot = ["uid", "subject", "predicate"]
    active = facts.where("status = 'active'")
    best = F.max_by("id", F.struct(F.col("pinned").cast("int"), "importance", "persona_attention", F.transform(F.split("id", ""), lambda c: -F.ascii(c))))
    known = active.groupBy(*slot).agg(F.collect_set("object").alias("held"), best.alias("head"))
    rows = candidates.join(known, slot, "left")
    new = ~F.coalesce(F.array_contains("held", F.col("object")), F.lit(False))
    if not pending_supersedes:
        doubtful = F.coalesce(F.col("status") == "pending", F.lit(False))
        rows = rows.withColumn("doubtful", doubtful)
    else:
        rows = rows.withColumn("doubtful", F.lit(False))
    rows = rows.withColumn("is_new", new & ~F.col("doubtful"))
    by_slot = Window.partitionBy(*slot, "doubtful")
    rows = rows.withColumn("first_new", F.min(F.when(F.col("is_new"), F.col("seq"))).over(by_slot))
    w = by_slot.orderBy("seq")
    repeated = F.coalesce(F.lag("object").over(w) == F.col("object"), F.lit(False))
    acts = F.when(F.col("doubtful"), True).otherwise((F.col("seq") == F.col("first_new")) | ((F.col("seq") > F.col("first_new")) & ~repeated))
    rows = rows.withColumn("acts", F.coalesce(acts, F.lit(False)))
    number = F.sum(F.col("acts").cast("int")).over(Window.partitionBy("uid").orderBy("seq"))
    rows = rows.withColumn("n", number)
    if last is not None:
        rows = rows.join(last.select("uid", F.col("seq").alias("before")), "uid", "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).drop("before")
    rows = rows.withColumn("id", F.when(F.col("acts"), F.format_string("F-%04d", F.col("n").cast("long"))))
    earlier = F.last("id", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    replaces = F.when(F.col("acts") & ~F.col("doubtful"), F.coalesce(earlier, F.col("head")))
    rows = rows.withColumn("replaces", replaces)
    action = F.when(~F.col("acts"), "NOOP").when(F.col("replaces").isNotNull(), "SUPERSEDE").otherwise("ADD")
    return rows.withColumn("action", action).drop("held", "head", "doubtful", "is_new", "first_new", "acts", "n")


SYSTEM = """You keep the long-term notes of a conversation between a user (lines marked 他说) and {name} (lines marked 她说).{about}
From the numbered lines take down what is worth knowing weeks from now. Answer with one JSON object and nothing else:
{{"facts": [...], "summary": "...", "topics": [...]}}.
A fact has: turn_ref, the number in brackets of the line it comes from; quote, words copied from that line; subject, 他 for the user or 她 for {name};
predicate, a short verb phrase; object, what exactly; kind, one of fact, commitment, promise; due, a date as YYYY-MM-DD or null;
confidence, 0 to 1, near 1 only for what is said outright; importance, 0 to 1; persona_attention, 0 to 1: {attention}
The user's facts come from the user's lines only. From {name}'s lines take only what {name} promises or says of herself.
Leave out jokes, guesses, questions and small talk. The summary has one or two sentences, or is empty.
At most three topics to come back to: text, kind (followup, share or ask), due_day or null, ref (a line's number)."""
ASK = "Today is {today}.\n\n{lines}"


def messages(prompt: str, today: str, persona: Persona = Persona()) -> list[dict]:
    """What a chat model is sent for one chunk's lines."""
    about = f" {persona.description}" if persona.description else ""
    attention = persona.attention_hint or f"how much {persona.name} would care"
    system = SYSTEM.format(name=persona.name, about=about, attention=attention)
    return [{"role": "system", "content": system}, {"role": "user", "content": ASK.format(today=today, lines=prompt)}]


def prompt_lines(lines: DataFrame) -> DataFrame:
    """Rows for the model (from ``turns.lines``) to one numbered text for each chunk."""
    who = F.when(F.col("role") == "assistant", "她说").otherwise("他说")
    line = F.format_string("[%s] %s %s %s：%s", F.col("id"), F.coalesce("day", F.lit("")), F.coalesce("time", F.lit("")) if "time" in lines.columns else F.lit(""), who, F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return lines.groupBy("uid", "chunk").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("prompt"), F.count("*").alias("n_lines"), F.max("day").alias("day"), F.count_if(F.col("role") == "user").alias("n_user"))


def call_model(prompts: DataFrame, model, max_tokens: int = 8000, per_line: int = 200) -> DataFrame:
    """Runs ``model(prompt, max_tokens) -> (text, finish_reason)`` on each chunk: adds ``raw, status`` and estimates of the tokens in and out, ``tin, tout``.

    ``failed`` (raised, empty, or cut off by the limit) leaves the cursor where it is; ``skipped`` (no model) doesn't.
    """

    def run(batches):
        for pdf in batches:
            raw, status, tin, tout = [], [], [], []
            for prompt, n in zip(pdf.prompt, pdf.n_lines):
                try:
                    out, why = ("", "none") if model is None else model(prompt, min(max_tokens, per_line * max(1, n)))
                except Exception:  # a model's error is a failed call, whatever it is
                    out, why = "", "error"
                good = bool((out or "").strip()) and why != "length"
                raw.append(out if good else "")
                status.append("skipped" if model is None else "ok" if good else "failed")
                tin.append(0 if model is None else int(len(prompt) / 1.5) + 1)
                tout.append(int(len(out) / 1.5) + 1 if out else 0)
            yield pdf.assign(raw=raw, status=status, tin=tin, tout=tout)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", raw string, status string, tin long, tout long"
    return prompts.mapInPandas(run, schema)


def candidates(answers: DataFrame) -> DataFrame:
    """Model answers to one row a fact, numbered by chunk and place."""
    rows = answers.where("status = 'ok'").select("uid", "chunk", F.posexplode(parse_facts(F.col("raw"))).alias("pos", "f"))
    return rows.select("uid", (F.col("chunk").cast("long") * 100000 + F.col("pos")).alias("seq"), "f.*")


def model_usage(answers: DataFrame) -> DataFrame:
    """Calls, failed ones, and tokens of each ``uid``."""
    return answers.groupBy("uid").agg(F.count_if(F.col("status") != "skipped").alias("calls"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("tin").alias("tin"), F.sum("tout").alias("tout"))


def run_stats(verified: DataFrame, resolved: DataFrame) -> DataFrame:
    """Of each ``uid`` how many candidates were active, pending and dropped, and what the others did."""
    seen = verified.groupBy("uid").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("active", "pending", "drop")))
    done = resolved.groupBy("uid").agg(*(F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ADD", "SUPERSEDE", "NOOP")))
    out = seen.join(done, "uid", "left")
    return out.select("uid", "active", "pending", "drop", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("add", "supersede", "noop")))


def ops_of(resolved: DataFrame, first_seq: DataFrame | None = None) -> DataFrame:
    """Resolved candidates that do something, as log rows."""
    rows = resolved.where("action <> 'NOOP'").withColumnRenamed("action", "op")
    seq = F.row_number().over(Window.partitionBy("uid").orderBy("seq")).cast("long")
    rows = rows.withColumn("seq", seq)
    if first_seq is not None:
        rows = rows.join(first_seq.select("uid", F.col("seq").alias("before")), "uid", "left").withColumn("seq", F.col("seq") + F.coalesce("before", F.lit(0))).drop("before")
    return rows
