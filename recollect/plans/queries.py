"""A query for each operator over the driver's tables, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as T
from ..operators import consolidate as C
from ..operators import extract as X
from ..operators import facts as FA
from ..operators import replay as R
from ..operators import retrieve as RE
from ..operators import turns as TU
from ..operators import vectors as V
from ..sources import logs
from . import tables as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S, P = SparkSession, str
_FACT_TEXT = "subject || ' ' || predicate || ' ' || object"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ISLANDS = f"""WITH {D.MESSAGES}, m AS (SELECT uid, pos, trim(text, ' ') AS text, lower(trim(role)) = 'user' AS is_user FROM messages WHERE trim(coalesce(text, ''), ' ') <> ''),
s AS (SELECT *, CASE WHEN lag(is_user) OVER w IS NULL OR (is_user AND NOT lag(is_user) OVER w) THEN 1 ELSE 0 END AS starts FROM m WINDOW w AS (PARTITION BY uid ORDER BY pos)),
t AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY uid ORDER BY pos) AS BIGINT) AS turn_no FROM s),
turn AS (SELECT uid, turn_no, string_agg(text, chr(10) ORDER BY pos) FILTER (is_user) AS "user", coalesce(list(text ORDER BY pos) FILTER (NOT is_user), []) AS assistant FROM t GROUP BY uid, turn_no),
said AS (SELECT uid, turn_no, 0 AS part, 'user' AS role, "user" AS text FROM turn WHERE "user" IS NOT NULL UNION ALL SELECT uid, turn_no, min(pos) AS part, 'assistant', text FROM t WHERE NOT is_user GROUP BY uid, turn_no, pos, text),
rows_ AS (SELECT uid, turn_no, role, text, row_number() OVER (PARTITION BY uid ORDER BY turn_no, role DESC, part) AS seq FROM said)"""


@query(_ISLANDS + """ SELECT uid, turn_no, "user" AS user_text, array_to_string(assistant, '|') AS assistant_text FROM turn""")
def w4_turn_normalise(spark: S, sf: P) -> DataFrame:
    return TU.normalise(D.messages(spark, sf)).select("uid", "turn_no", F.col("user").alias("user_text"), F.array_join("assistant", "|").alias("assistant_text"))


def _numbered(spark: S, sf: P) -> DataFrame:
    return TU.number(TU.normalise(D.messages(spark, sf)).withColumn("day", F.lit("2024-01-01")))


@query(_ISLANDS + " SELECT uid, seq, 'T-' || lpad(CAST(seq AS VARCHAR), 6, '0') AS id, role, text FROM rows_")
def w2_append_turns(spark: S, sf: P) -> DataFrame:
    return _numbered(spark, sf).select("uid", "seq", "id", "role", "text")


@query(_ISLANDS + " SELECT uid, count(DISTINCT turn_no) AS rounds, count(DISTINCT CASE WHEN role = 'user' THEN turn_no END) AS user_rounds, count(*) AS messages, 'T-' || lpad(CAST(max(seq) AS VARCHAR), 6, '0') AS last_turn_id FROM rows_ GROUP BY uid")
def n6_counters(spark: S, sf: P) -> DataFrame:
    return TU.counters(_numbered(spark, sf))


@query(f"WITH {D.TURNS} SELECT uid, id, text FROM turns WHERE role = 'user'")
def p8_user_turns(spark: S, sf: P) -> DataFrame:
    return TU.user_turns(D.turns(spark, sf)).select("uid", "id", "text")


@query(f"WITH {D.TURNS} SELECT uid, count(DISTINCT day) AS days, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM turns GROUP BY uid")
def s14_l0_stats(spark: S, sf: P) -> DataFrame:
    return TU.stats(D.turns(spark, sf))


_CHUNKS = f"WITH {D.TURNS}, u AS (SELECT uid, seq, id, CAST(floor((row_number() OVER (PARTITION BY uid ORDER BY seq) - 1) / 2) AS INTEGER) AS chunk FROM turns WHERE role = 'user'), c AS (SELECT * FROM u WHERE chunk < 8)"


@query(_CHUNKS + " SELECT uid, id, chunk FROM c")
def n3_chunks(spark: S, sf: P) -> DataFrame:
    return TU.chunks(D.turns(spark, sf), size=2).select("uid", "id", "chunk")


@query(
    _CHUNKS
    + """, o AS (SELECT *, last_value(CASE WHEN role = 'user' THEN seq END IGNORE NULLS) OVER (PARTITION BY uid ORDER BY seq) AS owner FROM turns),
t AS (SELECT o.uid, o.id, o.role, o.seq, o.text, c.chunk, row_number() OVER (PARTITION BY o.uid, c.chunk, o.role ORDER BY o.seq DESC) AS newest FROM o JOIN c ON o.uid = c.uid AND o.owner = c.seq)
SELECT uid, id, chunk, CASE WHEN role = 'user' THEN text ELSE substr(text, 1, 160) END AS text FROM t WHERE role = 'user' OR newest <= 16"""
)
def n4_her_lines(spark: S, sf: P) -> DataFrame:
    rows = D.turns(spark, sf)
    return TU.lines(rows, TU.chunks(rows, size=2)).select("uid", "id", "chunk", "text")


@query(f"WITH {D.TURNS} SELECT DISTINCT uid FROM turns")
def s11_tenants(spark: S, sf: P) -> DataFrame:
    return TU.tenants(D.turns(spark, sf))


@query(f"WITH {D.TURNS} SELECT uid, count(*) AS messages, count(*) FILTER (role = 'user') AS user_rounds, arg_max(id, seq) AS last_turn_id, max(day) AS last_day, CAST(CAST(uid AS BIGINT) % 4 AS BIGINT) AS extracted_rounds FROM turns GROUP BY uid")
def s10_state(spark: S, sf: P) -> DataFrame:
    rows = D.turns(spark, sf)
    done = F.col("uid").cast("long") % 4
    return TU.state(rows, rows.select("uid", done.alias("rounds")).where("rounds > 0"))


@query(f"WITH {D.TURNS} SELECT uid, id AS turn_ref FROM turns QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seq DESC) <= 3")
def n7_recent_refs(spark: S, sf: P) -> DataFrame:
    return TU.recent_refs(D.turns(spark, sf), 3)


@query(f"WITH {D.TURNS}, l AS (SELECT uid, substr(day, 1, 8) || lpad(CAST(seq % 3 + 1 AS VARCHAR), 2, '0') AS day, text, seq FROM turns), live AS (SELECT * FROM l WHERE seq % 2 = 0), old AS (SELECT * FROM l WHERE seq % 2 = 1), b AS (SELECT uid FROM live UNION ALL SELECT uid FROM old WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.uid = old.uid AND live.day = old.day)) SELECT uid, count(*) AS turns, (SELECT count(DISTINCT day) FROM live WHERE live.uid = b.uid) AS days, (SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM live WHERE live.uid = b.uid) AS bytes, (SELECT count(DISTINCT day) FROM old WHERE old.uid = b.uid) AS archived_days, (SELECT CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) FROM old WHERE old.uid = b.uid) AS archived_bytes FROM b GROUP BY uid")
def s14_archive_stats(spark: S, sf: P) -> DataFrame:
    rows = D.turns(spark, sf).withColumn("day", F.concat(F.substring("day", 1, 8), F.lpad((F.col("seq") % 3 + 1).cast("string"), 2, "0")))
    return TU.log_stats(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


@query("SELECT CAST(user_id AS VARCHAR) AS uid FROM events GROUP BY user_id HAVING strftime(max(ts), '%Y-%m-%d') < '2024-01-30' OR user_id % 5 = 0")
def x7_archive_due(spark: S, sf: P) -> DataFrame:
    last = F.when(F.col("user_id") % 5 > 0, F.date_format(F.max("ts"), "yyyy-MM-dd"))
    return TU.archive_due(D.read(spark, sf, "events").groupBy("user_id").agg(last.alias("last_archive")).withColumn("uid", F.col("user_id").cast("string")), "2024-01-30")


@query(f"WITH {D.TURNS} SELECT uid, seq, id, day, role, regexp_replace(text, CASE WHEN role = 'assistant' THEN '^(\\[[^\\]]*\\]\\s*)*' ELSE '^$' END, '') AS text FROM turns")
def s2_parse_turns(spark: S, sf: P) -> DataFrame:
    """Turns written as day files and read back."""
    return logs.parse_days(logs.day_text(D.turns(spark, sf).withColumn("time", F.lit("10:00:00")))).select("uid", "seq", "id", "day", "role", "text")


@query(f"WITH {D.OPS} SELECT uid, n AS seq, op, event_type || '-' || CAST(k % 5 AS VARCHAR) AS id, 'o' || CAST(n % 100 AS VARCHAR) AS object, 'e' || CAST(n % 100 AS VARCHAR) AS edit FROM e")
def s3_parse_ops(spark: S, sf: P) -> DataFrame:
    """The log written as JSON lines and read back, with torn lines between."""
    log = D.ops(spark, sf)
    line = F.to_json(F.struct(*(F.col(c) for c in log.columns if c not in ("uid", "seq", "edits")), F.col("edits").alias("set")))
    lines = log.select("uid", "seq", line.alias("line")).unionByName(log.select("uid", "seq", F.lit('{"op":').alias("line")))
    return logs.parse_ops(lines).select("uid", "seq", "op", "id", "object", F.element_at("edits", F.lit("object")).alias("edit"))


_PROMPTS = f"""pl AS (SELECT uid, 0 AS chunk, string_agg('[' || id || '] ' || day || ' 00:00:00 ' || CASE WHEN role = 'user' THEN '他说' ELSE '她说' END || '：' || said, chr(10) ORDER BY seq) AS prompt, count(*) AS n_lines, count(*) FILTER (role = 'user') AS n_user
 FROM (SELECT *, CASE WHEN role = 'user' THEN text ELSE substr(text, 1, 160) END AS said, row_number() OVER (PARTITION BY uid, role ORDER BY seq DESC) AS newest, min(CASE WHEN role = 'user' THEN seq END) OVER (PARTITION BY uid) AS opened FROM turns) WHERE seq >= opened AND (role = 'user' OR newest <= 16) GROUP BY uid)"""


def _prompts(spark: S, sf: P) -> DataFrame:
    rows = D.turns(spark, sf).withColumn("time", F.lit("00:00:00"))
    return X.prompt_lines(TU.lines(rows, TU.chunks(rows)))


@query(f"WITH {D.TURNS}, {_PROMPTS} SELECT uid, chunk, prompt, n_lines, n_user FROM pl")
def v5_prompts(spark: S, sf: P) -> DataFrame:
    """No conversation here fills a second chunk."""
    return _prompts(spark, sf).select("uid", "chunk", "prompt", "n_lines", "n_user")


@query(f"WITH {D.TURNS}, {_PROMPTS} SELECT uid, 1::BIGINT AS calls, CASE WHEN n_lines % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS failed, CAST(floor(length(prompt) / 1.5::DOUBLE) + 1 AS BIGINT) AS tin, CASE WHEN n_lines % 3 = 0 THEN 0 ELSE 3 END::BIGINT AS tout FROM pl")
def m3_model_usage(spark: S, sf: P) -> DataFrame:
    def model(prompt: str, max_tokens: int) -> tuple[str, str]:
        return ("", "error") if (prompt.count("\n[T-") + 1) % 3 == 0 else ("{} ", "stop")

    return X.model_usage(X.call_model(_prompts(spark, sf), model))


@query()
def m2_extract(spark: S, sf: P) -> DataFrame:
    """Chunks through a rule-based stand-in for the model, to verified facts."""
    rows = D.turns(spark, sf).withColumn("time", F.lit("00:00:00"))

    def model(prompt: str, max_tokens: int) -> tuple[str, str]:
        import json

        found = []
        for line in prompt.split("\n"):
            if line.startswith("[T-") and "他说：" in line:
                quote = line.split("他说：", 1)[1].strip()
                found.append({"turn_ref": line[1 : line.index("]")], "quote": quote, "subject": "他", "predicate": "说", "object": quote[:40], "confidence": 0.9})
        return json.dumps({"facts": found}), "stop"

    answers = X.call_model(X.prompt_lines(TU.lines(rows, TU.chunks(rows))), model)
    checked = X.verify(X.candidates(answers), rows)
    return X.clean(checked).select("uid", "seq", "predicate", "object", "status", "confidence", "valid_from")


_STATE = "SELECT CAST(user_id AS VARCHAR) AS uid, count(*) AS user_rounds, CAST(floor(count(*) / 2) AS BIGINT) + CASE WHEN user_id % 3 = 0 THEN count(*) ELSE 0 END AS done, CAST(epoch(max(ts)) AS DOUBLE) AS last_ts FROM events GROUP BY user_id"
_AT = 1706572800.0


def _state(spark: S, sf: P) -> DataFrame:
    e = D.read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("user_rounds"), F.unix_micros(F.max("ts").cast("timestamp")).alias("us"))
    done = F.floor(F.col("user_rounds") / 2).cast("long") + F.when(F.col("user_id") % 3 == 0, F.col("user_rounds")).otherwise(0)
    return e.select(F.col("user_id").cast("string").alias("uid"), "user_rounds", done.alias("done"), (F.col("us") / 1e6).alias("last_ts"))


@query(f"WITH s AS ({_STATE}) SELECT uid, CASE WHEN user_rounds - done <= 0 THEN '' WHEN {_AT} - last_ts >= 1800 THEN 'idle' WHEN user_rounds - done >= 200 THEN 'turns' ELSE 'forced' END AS reason FROM s")
def x2_should_run(spark: S, sf: P) -> DataFrame:
    return TU.should_run(_state(spark, sf), _AT, force=True).select("uid", "reason")


@query(f"WITH s AS (SELECT uid, user_rounds, done, user_rounds + CAST(uid AS BIGINT) % 5 AS claimed FROM ({_STATE})) SELECT uid, CASE WHEN user_rounds < claimed THEN greatest(0, user_rounds - greatest(0, claimed - done)) ELSE done END AS cursor FROM s")
def x3_cursor_clamp(spark: S, sf: P) -> DataFrame:
    state = _state(spark, sf).withColumn("claimed", F.col("user_rounds") + F.col("uid").cast("long") % 5)
    return TU.clamp_cursor(state).select("uid", F.col("cursor").cast("long").alias("cursor"))


@query(
    """WITH e AS (SELECT user_id AS uid, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 600 SECOND THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY uid ORDER BY ts) AS no FROM e) SELECT CAST(uid AS VARCHAR) AS uid, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY uid, no"""
)
def x10_sessions(spark: S, sf: P) -> DataFrame:
    e = D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("ts").cast("timestamp").alias("ts"))
    return TU.sessions(e).select("uid", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


_EV_TURNS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS uid, strftime(ts, '%Y-%m-%d') AS day FROM events)"


def _event_turns(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id")


@query(f"WITH {_EV_TURNS} SELECT uid, substr(day, 1, 7) AS month, count(DISTINCT day) AS days, count(*) AS turns FROM ev WHERE substr(day, 1, 7) < '2024-02' GROUP BY 1, 2")
def w9_archive_plan(spark: S, sf: P) -> DataFrame:
    return TU.archive_plan(_event_turns(spark, sf), "2024-03-20", 2)


@query("WITH a AS (SELECT CAST(user_id AS VARCHAR) AS uid, strftime(ts, '%Y-%m-%d') AS day, event_id FROM events), live AS (SELECT * FROM a WHERE event_id % 3 = 0) SELECT uid, day, event_id FROM live UNION ALL SELECT uid, day, event_id FROM a WHERE event_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM live WHERE live.uid = a.uid AND live.day = a.day)")
def s1_union_scan(spark: S, sf: P) -> DataFrame:
    rows = _event_turns(spark, sf)
    return TU.union_days(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 > 0")).select("uid", "day", "event_id")


@query(
    f"""WITH {D.CANDIDATES}, r AS (SELECT *, lag(object) OVER w AS before, row_number() OVER w AS i FROM cand WINDOW w AS (PARTITION BY uid, subject, predicate ORDER BY seq)),
a AS (SELECT *, i = 1 OR before <> object AS acts FROM r), n AS (SELECT *, CASE WHEN acts THEN 'F-' || lpad(CAST(sum(CAST(acts AS INTEGER)) OVER (PARTITION BY uid ORDER BY seq) AS VARCHAR), 4, '0') END AS id FROM a),
z AS (SELECT *, last_value(id IGNORE NULLS) OVER (PARTITION BY uid, subject, predicate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM n)
SELECT uid, seq, CASE WHEN NOT acts THEN 'NOOP' WHEN earlier IS NOT NULL THEN 'SUPERSEDE' ELSE 'ADD' END AS action, id, CASE WHEN acts THEN earlier END AS replaces FROM z"""
)
def a6_resolve_ops(spark: S, sf: P) -> DataFrame:
    none = D.facts(spark, sf).where("false")
    return X.resolve(D.candidates(spark, sf), none).select("uid", "seq", "action", "id", "replaces")


_OLD_NEW = f"""{D.FACTS}, cand AS (SELECT uid, first_seq AS seq, subject, predicate, CASE WHEN first_seq % 2 = 0 THEN object ELSE 'v' || CAST(first_seq % 3 AS VARCHAR) END AS object FROM facts WHERE first_seq % 3 = 0),
held AS (SELECT uid, subject, predicate, list(DISTINCT object) AS held, arg_max(id, {{'a': pinned, 'b': importance, 'c': persona_attention, 'd': -first_seq}}) AS head FROM facts WHERE status = 'active' AND first_seq % 3 > 0 GROUP BY ALL),
r AS (SELECT c.*, head, lag(object) OVER w AS before, coalesce(NOT list_contains(held, object), true) AS fresh FROM cand c LEFT JOIN held USING (uid, subject, predicate) WINDOW w AS (PARTITION BY uid, subject, predicate ORDER BY seq)),
b AS (SELECT *, min(CASE WHEN fresh THEN seq END) OVER (PARTITION BY uid, subject, predicate) AS first_new FROM r), a AS (SELECT *, coalesce(seq = first_new OR (seq > first_new AND before IS DISTINCT FROM object), false) AS acts FROM b),
n AS (SELECT *, CASE WHEN acts THEN 'F-' || lpad(CAST(1000 + sum(CAST(acts AS INTEGER)) OVER (PARTITION BY uid ORDER BY seq) AS VARCHAR), 4, '0') END AS id FROM a),
z AS (SELECT *, coalesce(last_value(id IGNORE NULLS) OVER (PARTITION BY uid, subject, predicate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), head) AS earlier FROM n),
done AS (SELECT uid, seq, CASE WHEN NOT acts THEN 'NOOP' WHEN earlier IS NOT NULL THEN 'SUPERSEDE' ELSE 'ADD' END AS action, id, CASE WHEN acts THEN earlier END AS replaces FROM z)"""


def _resolved(spark: S, sf: P) -> DataFrame:
    """Candidates of every third event against the facts of the others."""
    f = D.facts(spark, sf)
    value = F.when(F.col("first_seq") % 2 == 0, F.col("object")).otherwise(F.concat(F.lit("v"), F.col("first_seq") % 3))
    cand = f.where("first_seq % 3 = 0").select("uid", F.col("first_seq").alias("seq"), "subject", "predicate", value.alias("object"), F.lit("active").alias("status"))
    return X.resolve(cand, f.where("first_seq % 3 > 0"), f.select("uid", F.lit(1000).cast("long").alias("seq")).distinct())


@query(f"WITH {_OLD_NEW} SELECT uid, seq, action, id, replaces FROM done")
def j5_resolve_against_facts(spark: S, sf: P) -> DataFrame:
    return _resolved(spark, sf).select("uid", "seq", "action", "id", "replaces")


@query(f"WITH {_OLD_NEW} SELECT uid, count(*) FILTER (seq % 5 > 1) AS active, count(*) FILTER (seq % 5 = 1) AS pending, count(*) FILTER (seq % 5 = 0) AS drop, count(*) FILTER (action = 'ADD') AS add, count(*) FILTER (action = 'SUPERSEDE') AS supersede, count(*) FILTER (action = 'NOOP') AS noop FROM done GROUP BY uid")
def a9_run_stats(spark: S, sf: P) -> DataFrame:
    done = _resolved(spark, sf)
    verdict = F.when(F.col("seq") % 5 == 0, "drop").when(F.col("seq") % 5 == 1, "pending").otherwise("active")
    return X.run_stats(done.withColumn("verdict", verdict), done)


_REPLAY = f"""WITH {D.OPS}, o AS (SELECT s.uid, s.id, list({{'n': s.n, 'sub': s.sub, 'step': s.step, 'day': s.day, 'here': false, 'object': '', 'importance': 0.0::DOUBLE, 'pinned': false, 'status': '', 'valid_to': NULL::VARCHAR}} ORDER BY s.n, s.sub) AS l FROM steps s GROUP BY s.uid, s.id),
f AS (SELECT uid, id, list_reduce(list_prepend({{'n': 0::BIGINT, 'sub': 0, 'step': '', 'day': '', 'here': false, 'object': '', 'importance': 0.0::DOUBLE, 'pinned': false, 'status': '', 'valid_to': NULL::VARCHAR}}, l), lambda a, x: {{'n': x.n, 'sub': x.sub, 'step': x.step, 'day': x.day,
 'here': CASE WHEN x.step = 'ADD' THEN true WHEN x.step = 'FORGET' AND x.n % 4 = 0 THEN false ELSE a.here END,
 'object': CASE WHEN x.step = 'ADD' THEN 'o' || CAST(x.n % 100 AS VARCHAR) WHEN x.step = 'EDIT' THEN 'e' || CAST(x.n % 100 AS VARCHAR) ELSE a.object END,
 'importance': CASE WHEN x.step IN ('ADD', 'DEROGATE') THEN (CAST(x.n % 16 AS DOUBLE) / 16)::DOUBLE ELSE a.importance END,
 'pinned': CASE WHEN x.step IN ('ADD', 'PIN') THEN x.n % 2 = 0 ELSE a.pinned END,
 'status': CASE WHEN x.step IN ('ADD', 'CONFIRM') THEN CASE WHEN x.n % 3 = 0 THEN 'pending' ELSE 'active' END WHEN x.step IN ('END', 'INVALIDATE') THEN 'superseded' WHEN x.step = 'FORGET' THEN 'forgotten' WHEN x.step = 'MERGE' AND a.status = 'active' THEN 'merged' ELSE a.status END,
 'valid_to': CASE WHEN x.step = 'ADD' THEN NULL WHEN x.step = 'CONFIRM' AND x.n % 3 > 0 THEN NULL WHEN x.step IN ('END', 'INVALIDATE', 'FORGET') OR (x.step = 'MERGE' AND a.status = 'active') THEN x.day ELSE a.valid_to END}}) AS s FROM o)
SELECT uid, id, s.object AS object, s.importance AS importance, s.pinned AS pinned, s.status AS status, s.valid_to AS valid_to FROM f WHERE s.here"""


@query(_REPLAY)
def r_replay_full(spark: S, sf: P) -> DataFrame:
    return R.facts(D.ops(spark, sf), D.NOW).select("uid", "id", "object", "importance", "pinned", "status", "valid_to")


@query(_REPLAY)
def r_replay_incremental(spark: S, sf: P) -> DataFrame:
    """The log in two parts: the second one is folded into what the first gave."""
    log = D.ops(spark, sf)
    half = log.groupBy("uid").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seq)").alias("middle"))
    cut = log.join(half, "uid")
    first = R.facts(cut.where("seq <= middle").drop("middle"), D.NOW)
    return R.facts(cut.where("seq > middle").drop("middle"), D.NOW, first).select("uid", "id", "object", "importance", "pinned", "status", "valid_to")


_NOTE_OPS = "nt AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS seq, list_extract(['SUMMARY', 'TOPIC', 'WHAT', NULL], CAST(event_id % 4 AS INTEGER) + 1) AS op, CASE WHEN event_id % 40 > 1 THEN 'N-' || CAST(event_id % 3 AS VARCHAR) ELSE '' END AS id, 't' || CAST(event_id AS VARCHAR) AS text FROM events)"


def _note_ops(spark: S, sf: P) -> DataFrame:
    op = F.element_at(F.array(F.lit("SUMMARY"), F.lit("TOPIC"), F.lit("WHAT"), F.lit(None)), (F.col("event_id") % 4 + 1).cast("int"))
    ident = F.when(F.col("event_id") % 40 > 1, F.concat(F.lit("N-"), F.col("event_id") % 3)).otherwise("")
    e = D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.col("event_id").alias("seq"), op.alias("op"), ident.alias("id"), F.concat(F.lit("t"), F.col("event_id")).alias("text"))
    return e.select("*", *(F.lit(None).cast("string").alias(c) for c in ("day", "created_at", "turn_ref", "kind", "due_day", "ref")))


@query(f"WITH {_NOTE_OPS} SELECT uid, id, arg_max(text, seq) AS text FROM nt WHERE op = 'SUMMARY' AND id <> '' GROUP BY uid, id")
def r10_replay_summaries(spark: S, sf: P) -> DataFrame:
    return R.summaries(_note_ops(spark, sf)).select("uid", "id", "text")


@query(f"WITH {_NOTE_OPS} SELECT uid, id, arg_max(text, seq) AS text, max(seq) % 8 = 1 AS used FROM nt WHERE op = 'TOPIC' AND id <> '' GROUP BY uid, id")
def r11_replay_topics(spark: S, sf: P) -> DataFrame:
    """A topic written again after its use is open again."""
    ops = _note_ops(spark, sf)
    return R.topics(ops, ops.where("seq % 8 = 1").select("uid", "id", "seq")).select("uid", "id", "text", "used")


@query(f"WITH {_NOTE_OPS} SELECT uid, seq FROM nt WHERE coalesce(op NOT IN ('SUMMARY', 'TOPIC'), true) OR id = ''")
def r12_unknown_kinds(spark: S, sf: P) -> DataFrame:
    return R.bad_ops(_note_ops(spark, sf)).select("uid", "seq")


@query(f"SELECT * FROM ({_REPLAY}) WHERE uid = '7' AND id = 'click-1'")
def s6_get_fact(spark: S, sf: P) -> DataFrame:
    return R.fact(D.ops(spark, sf), "7", "click-1", D.NOW).select("uid", "id", "object", "importance", "pinned", "status", "valid_to")


@query(f"WITH {D.FACTS} SELECT uid, max(first_seq) AS seq FROM facts GROUP BY uid")
def w6_last_fact_ids(spark: S, sf: P) -> DataFrame:
    """A purged fact's number isn't given again."""
    return R.last_fact_ids(D.facts(spark, sf))


@query(f"WITH {D.FACTS}, parts AS (SELECT uid, 'facts' AS section, id FROM facts UNION ALL SELECT uid, 'pending', id FROM facts WHERE status = 'pending' UNION ALL SELECT uid, 'ops', 'op-' || CAST(first_seq AS VARCHAR) FROM facts) SELECT uid, section, id FROM parts")
def s13_export(spark: S, sf: P) -> DataFrame:
    f = D.facts(spark, sf)
    none = spark.createDataFrame([], "uid string, id string, day string, created_at string, text string, due_day string, used boolean")
    return FA.export(f, none, none, f.select("uid", F.concat(F.lit("op-"), "first_seq").alias("id"))).select("uid", "section", "id")


@query(f"WITH {D.FACTS}, {D.PROSE}, {D.TOPICS_USED}, us AS (SELECT uid FROM facts UNION SELECT uid FROM prose) SELECT uid, uid IN (SELECT uid FROM facts WHERE status = 'active' AND valid_to IS NULL) AS has_fact, uid IN (SELECT uid FROM open_topics) AS has_topic, uid IN (SELECT uid FROM open_topics WHERE NOT used) AS has_open_topic, uid IN (SELECT CAST(label AS VARCHAR) FROM embeddings) AS has_vector, uid IN (SELECT uid FROM facts WHERE status = 'active' AND valid_to IS NULL UNION SELECT uid FROM open_topics) AS any_material FROM us")
def p5_material(spark: S, sf: P) -> DataFrame:
    f, t = D.facts(spark, sf), D.topics(spark, sf)
    found = FA.material(f.select("uid").union(D.prose(spark, sf).select("uid")), f, D.summaries(spark, sf), t, D.vectors(spark, sf))
    return found.select("uid", "has_fact", "has_topic", "has_open_topic", "has_vector", "any_material")


@query(f"WITH {D.FACTS} SELECT uid, id, CASE WHEN status IN ('active', 'pending') THEN {_FACT_TEXT} ELSE '' END AS text FROM facts")
def c3_searchable(spark: S, sf: P) -> DataFrame:
    return C.searchable(D.facts(spark, sf))


@query(f"WITH {D.FACTS} SELECT uid, id, status FROM facts WHERE CAST(uid AS BIGINT) % 10 > 0")
def w10_reset(spark: S, sf: P) -> DataFrame:
    f = D.facts(spark, sf)
    return FA.without(f, f.where("CAST(uid AS BIGINT) % 10 = 0")).select("uid", "id", "status")


@query(f"WITH {D.FACTS} SELECT uid, id, predicate, object, importance FROM facts WHERE status = 'active' AND valid_to IS NULL")
def s4_list_facts(spark: S, sf: P) -> DataFrame:
    return FA.list_facts(D.facts(spark, sf)).select("uid", "id", "predicate", "object", "importance")


@query(f"WITH {D.FACTS} SELECT uid, id, object FROM facts WHERE status = 'pending'")
def s5_pending(spark: S, sf: P) -> DataFrame:
    return FA.pending(D.facts(spark, sf)).select("uid", "id", "object")


@query(f"WITH {D.FACTS}, ids AS (SELECT CAST(user_id AS VARCHAR) AS uid, 'F-' || lpad(CAST(event_id + 1 AS VARCHAR), 9, '0') AS id FROM events) SELECT uid, id, object FROM facts WHERE EXISTS (SELECT 1 FROM ids WHERE ids.uid = facts.uid AND ids.id = facts.id)")
def s7_fetch(spark: S, sf: P) -> DataFrame:
    ids = D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.format_string("F-%09d", F.col("event_id") + 1).alias("id"))
    return FA.fetch(D.facts(spark, sf), ids).select("uid", "id", "object")


@query(f"WITH {D.OPS} SELECT uid, n AS seq, op FROM e WHERE event_type || '-' || CAST(k % 5 AS VARCHAR) = 'click-1'")
def s12_history(spark: S, sf: P) -> DataFrame:
    return FA.history(D.ops(spark, sf), "click-1").select("uid", "seq", "op")


@query(f"WITH {D.FACTS} SELECT uid, count(*) AS total, count(*) FILTER (status = 'active' AND valid_to IS NULL) AS live, count(*) FILTER (status = 'pending') AS pending FROM facts GROUP BY uid")
def a1_fact_stats(spark: S, sf: P) -> DataFrame:
    return FA.stats(D.facts(spark, sf))


@query(f"WITH {D.FACTS} SELECT f.uid, f.id, count(e.event_id) AS use_count, max(strftime(e.ts, '%Y-%m-%d')) AS last_used_at FROM facts f LEFT JOIN events e ON f.uid = CAST(e.user_id AS VARCHAR) AND f.id = 'F-' || lpad(CAST(e.event_id - e.event_id % 7 AS VARCHAR), 9, '0') GROUP BY f.uid, f.id")
def w12_usage(spark: S, sf: P) -> DataFrame:
    usage = D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), F.format_string("F-%09d", F.col("event_id") - F.col("event_id") % 7).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("ts"))
    return FA.with_usage(D.facts(spark, sf), usage).select("uid", "id", "use_count", "last_used_at")


_TOK = "CASE WHEN length({s}) < 2 THEN list_filter([{s}], lambda x: x <> '') ELSE list_transform(list_zip(string_split({s}, '')[1:length({s}) - 1], string_split({s}, '')[2:]), lambda x: x[1] || x[2]) END"
_WORDY = "regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def _tok(x: str) -> str:
    return _TOK.format(s=_WORDY.format(x=x))


@query(f"SELECT doc_id, {_tok('text')} AS tokens FROM documents")
def i1_tokenize(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))


_MARKED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def _postings(table: str, key: str) -> str:
    return f"SELECT {key} AS id, length AS length, translate(lower(token), '{_MARKED}', '{_PLAIN}') AS token, count(*) AS tf FROM (SELECT {key}, len(t) AS length, unnest(t) AS token FROM (SELECT {key}, {_tok('text')} AS t FROM {table})) GROUP BY 1, 2, 3"


def _corpus(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "documents").select(F.lit("all").alias("uid"), F.col("doc_id").alias("id"), "text")


@query(f"SELECT id, token, tf, CAST(length AS INTEGER) AS length FROM ({_postings('documents', 'doc_id')})")
def i2_postings(spark: S, sf: P) -> DataFrame:
    return RE.postings(_corpus(spark, sf)).select("id", "token", "tf", "length")


_BM25 = f"""p AS ({_postings('documents', 'doc_id')}), q AS ({_postings('benchmark', 'item_id')}), sz AS (SELECT count(*) AS docs, avg(len({_tok('text')})) AS mean FROM documents), df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
w AS (SELECT q.id AS qid, q.token, greatest(ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * q.tf AS w FROM q JOIN df USING (token), sz),
sc AS (SELECT w.qid, p.id, CAST(sum(CAST(round(w.w * p.tf * 2.2::DOUBLE / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * p.length / mean)), 12) AS DECIMAL(28,12))) AS DOUBLE) AS score FROM p JOIN w USING (token), sz GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM sc)"""


@query(f"WITH {_BM25} SELECT qid, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 16")
def i3_bm25_topk(spark: S, sf: P) -> DataFrame:
    asked = D.read(spark, sf, "benchmark").select(F.lit("all").alias("uid"), F.col("item_id").alias("qid"), "text")
    return RE.bm25(_corpus(spark, sf), asked, 16).select("qid", "id", F.round("score", 6).alias("score"), "rank")


def _asked(spark: S, sf: P) -> DataFrame:
    """A query of each user of each type of event."""
    e = D.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("uid"), "event_type").distinct()
    return e.select("uid", F.col("event_type").alias("qid"), F.when(F.col("event_type").startswith("c"), "k1 k2").when(F.col("event_type").startswith("p"), "说过 k3").otherwise("k4").alias("text"), F.lit(D.NOW).cast("timestamp").alias("now"))


_ASKED = "asked AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid, event_type AS qid, CASE WHEN event_type LIKE 'c%' THEN 'k1 k2' WHEN event_type LIKE 'p%' THEN '说过 k3' ELSE 'k4' END AS text FROM events)"
_SLOT = f"""tk AS (SELECT uid, qid, i AS place, list_extract(t, i) AS token FROM (SELECT uid, qid, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT uid, qid, {_tok('text')} AS t FROM asked)) WHERE length(list_extract(t, i)) >= 2),
hit AS (SELECT t.uid, t.qid, t.place, f.id, row_number() OVER (PARTITION BY t.uid, t.qid, t.place ORDER BY f.first_seq, f.id) AS n FROM tk t JOIN facts f ON t.uid = f.uid AND (f.predicate = t.token OR f.object = t.token) WHERE f.status = 'active' AND f.valid_to IS NULL),
slot AS (SELECT uid, qid, id, row_number() OVER (PARTITION BY uid, qid ORDER BY min(place * 100 + n)) AS rank FROM hit WHERE n <= 8 GROUP BY uid, qid, id)"""


@query(f"WITH {D.FACTS}, {_ASKED}, {_SLOT} SELECT uid, qid, id, CAST(rank AS INTEGER) AS rank FROM slot")
def i4_slot_hits(spark: S, sf: P) -> DataFrame:
    return RE.slot_hits(D.facts(spark, sf), _asked(spark, sf)).select("uid", "qid", "id", "rank")


_COS = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"SELECT qid, id, round(cos, 6) AS cos, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {_COS} AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 20 = 0) WHERE cos >= 0.2) WHERE rank <= 16")
def i5_vector_topk(spark: S, sf: P) -> DataFrame:
    v = D.vectors(spark, sf)
    asked = v.where("vec_id % 20 = 0").select("uid", F.col("vec_id").alias("qid"), "vec")
    return RE.vector_hits(v.withColumn("fact_id", F.col("vec_id")), asked, 16, 0.2).select("qid", "id", F.round("cos", 6).alias("cos"), "rank")


_LIVE = "status = 'active' AND valid_to IS NULL AND (pinned OR confidence >= 0.5)"
_W = "importance * (0.5::DOUBLE + persona_attention)"
_HOT_ORDER = f"pinned DESC, CASE WHEN kind <> 'fact' THEN 0 ELSE 1 END, CASE WHEN kind <> 'fact' THEN coalesce(due, '9999') END ASC NULLS LAST, {_W} DESC, id"
_CARD = "subject || predicate || object || CASE WHEN kind <> 'fact' AND due IS NOT NULL THEN '（' || due || ' 之前）' ELSE '' END"
_TOKENS = "CAST(floor(length({x}) / 1.5::DOUBLE) + 1 AS BIGINT)"
_HOT = f"""h0 AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {_HOT_ORDER}) AS r FROM facts WHERE status = 'active' AND valid_to IS NULL),
h1 AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY {_HOT_ORDER}) AS pos FROM h0 WHERE r <= 400 AND {_LIVE}),
h2 AS (SELECT * EXCLUDE (pos), min(pos) OVER (PARTITION BY uid, subject, predicate) AS pos, row_number() OVER (PARTITION BY uid, subject, predicate ORDER BY pinned DESC, valid_from DESC, importance DESC, id) AS b FROM h1),
h3 AS (SELECT *, row_number() OVER w AS place, sum({_TOKENS.format(x=_CARD)}) OVER (PARTITION BY uid ORDER BY pinned DESC, CASE WHEN pinned THEN pos END ASC NULLS LAST, CASE WHEN kind <> 'fact' THEN 0 ELSE 1 END, CASE WHEN kind <> 'fact' THEN coalesce(due, '9999') END ASC NULLS LAST, {_W} DESC, id ROWS UNBOUNDED PRECEDING) AS used
 FROM h2 WHERE b = 1 WINDOW w AS (PARTITION BY uid ORDER BY pinned DESC, CASE WHEN pinned THEN pos END ASC NULLS LAST, CASE WHEN kind <> 'fact' THEN 0 ELSE 1 END, CASE WHEN kind <> 'fact' THEN coalesce(due, '9999') END ASC NULLS LAST, {_W} DESC, id)),
hot AS (SELECT * FROM h3 WHERE place = 1 OR used <= 40)"""
_SMALL = Config(hot_tokens=40)


@query(f"WITH {D.FACTS}, {_HOT} SELECT uid, id, {_CARD} AS card, CAST(place AS INTEGER) AS place, CAST(used AS BIGINT) AS used FROM hot")
def t1_hot_facts(spark: S, sf: P) -> DataFrame:
    return RE.hot_facts(D.facts(spark, sf), _SMALL).select("uid", "id", FA.card().alias("card"), "place", "used")


@query(f"WITH {D.FACTS}, {_HOT} SELECT uid, id, CAST(pos AS INTEGER) AS pos FROM h2 WHERE b = 1")
def a5_slot_dedup(spark: S, sf: P) -> DataFrame:
    live = FA.list_facts(D.facts(spark, sf)).where(FA.live(F.lit(False), 0.5))
    return RE.dedup_slots(live, ["uid"], RE.hot_order()).select("uid", "id", "pos")


_NOT_PAST = "NOT regexp_matches(text, '" + T.PAST + "')"
_TRIGGER = f"""ht AS (SELECT DISTINCT uid, unnest({_tok(_CARD)}) AS token FROM hot),
trig AS (SELECT a.uid, a.qid, regexp_matches(a.text, '{T.PAST}') OR NOT EXISTS (SELECT 1 FROM hot WHERE hot.uid = a.uid) AND EXISTS (SELECT 1 FROM facts f WHERE f.uid = a.uid AND f.status = 'active' AND f.valid_to IS NULL)
 OR EXISTS (SELECT 1 FROM (SELECT uid, qid, unnest({_tok('text')}) AS token FROM asked) t JOIN ht ON ht.uid = t.uid AND ht.token = t.token WHERE t.uid = a.uid AND t.qid = a.qid AND length(t.token) >= 2) AS triggered FROM asked a)"""


@query(f"WITH {D.FACTS}, {_ASKED}, {_HOT}, {_TRIGGER} SELECT uid, qid, triggered FROM trig")
def i10_cold_trigger(spark: S, sf: P) -> DataFrame:
    f = D.facts(spark, sf)
    return RE.cold_triggered(_asked(spark, sf), RE.hot_facts(f, _SMALL), f).select("uid", "qid", "triggered")


@query(f"SELECT conv_id, turn, regexp_matches(trim(text), '{T.PAST}') AS past FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '你上次说 ' || text ELSE text END AS text FROM conversations)")
def i9_past_mention(spark: S, sf: P) -> DataFrame:
    c = D.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", T.past_mentioned(F.when(F.col("turn") % 3 == 0, F.concat(F.lit("你上次说 "), "text")).otherwise(F.col("text"))).alias("past"))


@query(f"WITH {D.FACTS} SELECT uid, id, round(0.6::DOUBLE + 0.4::DOUBLE / (1 + CAST(greatest(0, date_diff('day', CAST(valid_from AS DATE), DATE '{D.NOW}')) AS DOUBLE) / 180), 9) AS recency FROM facts")
def i7_recency(spark: S, sf: P) -> DataFrame:
    return D.facts(spark, sf).select("uid", "id", F.round(RE.recency(F.col("valid_from"), F.lit(D.NOW).cast("timestamp")), 9).alias("recency"))


def _legs(spark: S, sf: P) -> DataFrame:
    """Three lists cut from one of the nearest."""
    v = D.vectors(spark, sf).withColumn("fact_id", F.col("vec_id"))
    asked = v.where("vec_id % 20 = 0").select("uid", F.col("vec_id").alias("qid"), "vec")
    near = RE.vector_hits(v, asked, 16, 0.2)
    r = F.col("rank")
    one = lambda name, rank: F.struct(F.lit(name).alias("leg"), rank.alias("rank"))
    legs = F.array(one("slot", F.when(r <= 5, 6 - r)), one("fts", F.when(r > 3, r - 3)), one("vec", r))
    return near.select("uid", "qid", "id", F.inline(legs)).where("rank IS NOT NULL")


_NEAR = f"near AS (SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) AS rank FROM (SELECT b.vec_id AS qid, a.vec_id AS id, {_COS} AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id % 20 = 0) WHERE cos >= 0.2) WHERE rank <= 16)"


@query(f"WITH {_NEAR} SELECT qid, id, CASE WHEN rank <= 5 THEN 1::DOUBLE / (66 - rank) ELSE 0 END + CASE WHEN rank > 3 THEN 1::DOUBLE / (57 + rank) ELSE 0 END + 1::DOUBLE / (60 + rank) AS rrf FROM near")
def a4_rrf(spark: S, sf: P) -> DataFrame:
    return RE.fuse_legs(_legs(spark, sf), ["slot", "fts", "vec"]).select("qid", "id", "rrf")


def _recall_sql(budget: int) -> str:
    """Slot, full text and pins of every query, fused; ``rc`` are the answers."""
    order = "pinned DESC, score DESC, id"
    return f"""ft AS (SELECT uid, id, t, len(t) AS length FROM (SELECT uid, id, {_tok(_FACT_TEXT)} AS t FROM facts)),
fp AS (SELECT uid, id, length, lower(token) AS token, count(*) AS tf FROM (SELECT uid, id, length, unnest(t) AS token FROM ft) GROUP BY ALL),
fz AS (SELECT uid, count(*) AS docs, avg(length) AS mean FROM ft GROUP BY uid), fd AS (SELECT uid, token, count(*) AS df FROM fp GROUP BY uid, token),
fq AS (SELECT uid, qid, lower(token) AS token, count(*) AS times FROM (SELECT uid, qid, unnest({_tok('text')}) AS token FROM asked) GROUP BY ALL),
fw AS (SELECT fq.uid, fq.qid, fq.token, mean, greatest(ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6) * times AS w FROM fq JOIN fd USING (uid, token) JOIN fz USING (uid)),
fs AS (SELECT fw.uid, fw.qid, fp.id, CAST(sum(CAST(round(fw.w * fp.tf * 2.2::DOUBLE / (fp.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * fp.length / fw.mean)), 12) AS DECIMAL(28,12))) AS DOUBLE) AS s
 FROM fp JOIN fw USING (uid, token) JOIN facts f ON f.uid = fp.uid AND f.id = fp.id AND f.status = 'active' AND f.valid_to IS NULL GROUP BY 1, 2, 3),
fts AS (SELECT uid, qid, id, row_number() OVER (PARTITION BY uid, qid ORDER BY s DESC, id) AS rank FROM fs QUALIFY rank <= 16),
pins AS (SELECT uid, id FROM facts WHERE status = 'active' AND valid_to IS NULL AND pinned QUALIFY row_number() OVER (PARTITION BY uid ORDER BY id) <= 64),
ids AS (SELECT uid, qid, id, max(slot) AS slot, max(fts) AS fts, max(pin) AS pin FROM (SELECT uid, qid, id, rank AS slot, NULL AS fts, NULL AS pin FROM slot UNION ALL SELECT uid, qid, id, NULL, rank, NULL FROM fts UNION ALL SELECT a.uid, a.qid, p.id, NULL, NULL, 1 FROM asked a JOIN pins p ON a.uid = p.uid) GROUP BY 1, 2, 3),
r0 AS (SELECT i.qid, i.slot, i.fts, f.* FROM ids i JOIN facts f ON f.uid = i.uid AND f.id = i.id WHERE {_LIVE}),
r1 AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY uid, qid, subject, predicate ORDER BY pinned DESC, valid_from DESC, importance DESC, id) = 1),
r2 AS (SELECT *, least(1, (coalesce(1::DOUBLE / (slot + 60), 0) + coalesce(1::DOUBLE / (fts + 60), 0)) * 61) * (0.75::DOUBLE + 0.25::DOUBLE * (0.5::DOUBLE * importance + 0.5::DOUBLE * persona_attention))
 * (0.6::DOUBLE + 0.4::DOUBLE / (1 + CAST(greatest(0, date_diff('day', CAST(valid_from AS DATE), DATE '{D.NOW}')) AS DOUBLE) / 180)) AS raw FROM r1),
r3 AS (SELECT *, CASE WHEN pinned THEN 1::DOUBLE ELSE round(raw, 4) END AS score, CASE WHEN pinned THEN 'pin' WHEN slot IS NOT NULL THEN 'slot' ELSE 'fts' END AS match FROM r2 WHERE pinned OR raw >= 0.35),
r4 AS (SELECT *, {_CARD} AS card, row_number() OVER w AS n, sum({_TOKENS.format(x=_CARD)}) OVER (PARTITION BY uid, qid ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS spent FROM r3 WINDOW w AS (PARTITION BY uid, qid ORDER BY {order})),
rc AS (SELECT * EXCLUDE (n), row_number() OVER (PARTITION BY uid, qid ORDER BY {order}) AS place FROM r4 WHERE n = 1 OR spent <= {budget} QUALIFY place <= 4)"""


@query(f"WITH {D.FACTS}, {_ASKED}, {_SLOT}, {_recall_sql(300)} SELECT uid, qid, id, score, match, CAST(place AS INTEGER) AS place FROM rc")
def i13_recall(spark: S, sf: P) -> DataFrame:
    """Slot, full text and pins of every user's queries."""
    return RE.recall(D.facts(spark, sf), _asked(spark, sf)).select("uid", "qid", "id", "score", "match", "place")


_CONTEXT = f"""WITH {D.FACTS}, {_ASKED}, {_SLOT}, {_recall_sql(40)}, {_HOT}, {_TRIGGER},
cx AS (SELECT a.uid, a.qid, h.id, {_CARD} AS card, 'hot' AS source, h.place FROM asked a JOIN hot h ON a.uid = h.uid
 UNION ALL SELECT r.uid, r.qid, r.id, r.card, 'cold', r.place FROM rc r JOIN trig t ON r.uid = t.uid AND r.qid = t.qid AND t.triggered WHERE NOT EXISTS (SELECT 1 FROM hot WHERE hot.uid = r.uid AND hot.id = r.id))"""


@query(_CONTEXT + " SELECT uid, qid, id, card, source, CAST(row_number() OVER (PARTITION BY uid, qid ORDER BY source DESC, place) AS INTEGER) AS place FROM cx")
def i14_context(spark: S, sf: P) -> DataFrame:
    return RE.context(D.facts(spark, sf), _asked(spark, sf), _SMALL).select("uid", "qid", "id", "card", "source", "place")


@query(_CONTEXT + f" SELECT uid, qid, count(*) FILTER (source = 'hot') AS hot, count(*) FILTER (source = 'cold') AS cold, CAST(sum({_TOKENS.format(x='card')}) AS BIGINT) AS used_tokens FROM cx GROUP BY uid, qid")
def a10_used_tokens(spark: S, sf: P) -> DataFrame:
    return RE.context_totals(RE.context(D.facts(spark, sf), _asked(spark, sf), _SMALL))


@query(_CONTEXT + " SELECT t.uid, t.qid, CASE WHEN NOT triggered THEN 'skipped' WHEN count(rc.id) = 0 THEN 'no_hit' ELSE 'ok' END AS reason, count(rc.id) AS hits FROM trig t LEFT JOIN rc ON rc.uid = t.uid AND rc.qid = t.qid GROUP BY t.uid, t.qid, triggered")
def i15_outcomes(spark: S, sf: P) -> DataFrame:
    f, q = D.facts(spark, sf), _asked(spark, sf)
    return RE.outcomes(q, RE.cold_triggered(q, RE.hot_facts(f, _SMALL), f), RE.recall(f, q, _SMALL)).select("uid", "qid", "reason", "hits")


@query("SELECT event_type, share, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) e, (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 1::DOUBLE]) AS share) WHERE r = least(n - 1, floor(n * share)) + 1")
def a11_percentiles(spark: S, sf: P) -> DataFrame:
    return RE.nearest_rank(D.read(spark, sf, "events"), ["event_type"], "value", (0.5, 0.95, 1.0))


@query(f"WITH {D.PROSE}, {D.SUMMARIES} SELECT uid, id, day, text FROM summaries")
def w7_summary_ids(spark: S, sf: P) -> DataFrame:
    return D.summaries(spark, sf).select("uid", "id", "day", "text")


_LISTED = f"WITH {D.PROSE}, {D.SUMMARIES}, ls AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY day DESC, id DESC) AS rank FROM summaries)"


@query(_LISTED + " SELECT uid, id, day, CAST(rank AS INTEGER) AS rank FROM ls WHERE rank <= 20")
def s8_list_summaries(spark: S, sf: P) -> DataFrame:
    return FA.list_summaries(D.summaries(spark, sf)).select("uid", "id", "day", "rank")


def _clip(x: str, b: int) -> str:
    keep = int((b - 1) * 1.5) - 1
    return f"CASE WHEN {_TOKENS.format(x=x)} <= {b} THEN {x} ELSE regexp_replace(substr({x}, 1, {keep}), '\\s+$', '') || '…' END"


def _prose_sql(listed: str, budget: int, k: int, fetch: int) -> str:
    return f"""pr AS (SELECT *, CASE WHEN rank = 1 THEN {_clip('text', budget)} ELSE text END AS said FROM {listed} WHERE rank <= {fetch}),
pb AS (SELECT *, sum({_TOKENS.format(x='said')}) OVER (PARTITION BY uid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS spent FROM pr)
SELECT uid, id, said AS text, CAST(spent AS BIGINT) AS used FROM pb WHERE (rank = 1 OR spent <= {budget}) AND rank <= {k}"""


@query(_LISTED + ", " + _prose_sql("ls", 160, 3, 12))
def t8_hot_summaries(spark: S, sf: P) -> DataFrame:
    return RE.hot_summaries(D.summaries(spark, sf)).select("uid", "id", "text", "used")


@query(f"WITH {D.PROSE}, {D.TOPICS} SELECT uid, id, day, kind, due_day, text FROM topics")
def w7_topic_ids(spark: S, sf: P) -> DataFrame:
    return D.topics(spark, sf).select("uid", "id", "day", "kind", "due_day", "text")


_OPEN = f"WITH {D.PROSE}, {D.TOPICS_USED}, lt AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY due_day = '', due_day, day DESC, id) AS rank FROM open_topics WHERE NOT used)"


@query(_OPEN + " SELECT uid, id, due_day, CAST(rank AS INTEGER) AS rank FROM lt WHERE rank <= 8")
def s9_list_topics(spark: S, sf: P) -> DataFrame:
    return FA.list_topics(D.topics(spark, sf)).select("uid", "id", "due_day", "rank")


@query(_OPEN + ", " + _prose_sql("lt", 80, 2, 6))
def t9_hot_topics(spark: S, sf: P) -> DataFrame:
    return RE.hot_topics(D.topics(spark, sf)).select("uid", "id", "text", "used")


@query(_LISTED + " SELECT uid, string_agg('## ' || day || ' ' || id || chr(10) || text, chr(10) ORDER BY rank DESC) AS view FROM ls WHERE rank <= 500 GROUP BY uid")
def w11_render_summaries(spark: S, sf: P) -> DataFrame:
    return FA.render_summaries(D.summaries(spark, sf))


@query(f"WITH {D.PROSE}, {D.TOPICS_USED}, allt AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY due_day = '', due_day, day DESC, id) AS rank FROM open_topics) SELECT uid, string_agg('- ' || day || ' ' || text || ' (' || id || ', ' || kind || CASE WHEN used THEN ', used' ELSE '' END || CASE WHEN due_day <> '' THEN ', by ' || due_day ELSE '' END || ')', chr(10) ORDER BY rank) AS view FROM allt WHERE rank <= 200 GROUP BY uid")
def w11_render_topics(spark: S, sf: P) -> DataFrame:
    return FA.render_topics(D.topics(spark, sf))


@query(_OPEN + " SELECT o.uid, o.id, o.used OR coalesce(lt.rank <= 2, false) AS used FROM open_topics o LEFT JOIN lt ON lt.uid = o.uid AND lt.id = o.id")
def w13_use_topics(spark: S, sf: P) -> DataFrame:
    t = D.topics(spark, sf)
    return FA.use_topics(t, FA.list_topics(t, 2)).select("uid", "id", "used")


@query(f"WITH {D.PROSE}, {D.TOPICS_USED} SELECT uid, count(*) AS total, count(*) FILTER (NOT used) AS open FROM open_topics GROUP BY uid")
def a2_topic_stats(spark: S, sf: P) -> DataFrame:
    return FA.topic_stats(D.topics(spark, sf))


@query(f"SELECT doc_id, {_TOKENS.format(x='text')} AS tokens FROM documents")
def f1_estimate_tokens(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {_clip('text', 50)} AS text FROM documents")
def f2_clip(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "documents").select("doc_id", T.clip_to_tokens(F.col("text"), 50).alias("text"))


_sql_class = lambda x: x.replace("'", "''")


@query(f"SELECT doc_id, regexp_replace(text, '{_sql_class(T.NOISE)}', '', 'g') AS norm, CAST(length(regexp_replace(text, '{_sql_class(T.WIDE_NOISE)}', '', 'g')) AS INTEGER) AS core FROM documents")
def f6_norm_core(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "documents").select("doc_id", T.norm(F.col("text")).alias("norm"), T.core_len(F.col("text")).alias("core"))


@query("SELECT page_id, CASE WHEN n = '' THEN 'default' ELSE n END AS name FROM (SELECT page_id, regexp_replace(url, '[^\\p{L}\\p{Nd}_\\-]', '', 'g') AS n FROM pages)")
def f9_safe_name(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


_PHRASES = ("上周五去看展", "这周三开会", "下周一，明天", "昨天和前天", "上个月搬了家", "以前住北京", "本周日后天今天", "没有日期")
_PHRASE = f"list_extract([{', '.join(repr(x) for x in _PHRASES)}], CAST(event_id % 8 AS INTEGER) + 1)"


def _absolute_sql(x: str) -> str:
    for word, days in {"上周": -7, "这周": 0, "本周": 0, "下周": 7}.items():
        for i, c in enumerate("一二三四五六日天"):
            x = f"replace({x}, '{word}{c}', strftime(CAST(date_trunc('week', d) AS DATE) + {days + min(i, 6)}, '%Y-%m-%d'))"
    for word, days in {"今天": 0, "昨天": -1, "前天": -2, "明天": 1, "后天": 2}.items():
        x = f"replace({x}, '{word}', strftime(d + {days}, '%Y-%m-%d'))"
    return f"regexp_replace({x}, '上周|这周|本周|下周|上个月|这个月|下个月', '', 'g')"


def _phrases(spark: S, sf: P) -> DataFrame:
    phrase = F.element_at(F.array(*(F.lit(x) for x in _PHRASES)), (F.col("event_id") % 8 + 1).cast("int"))
    return D.read(spark, sf, "events").select("event_id", phrase.alias("phrase"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


_PH = f"p AS (SELECT event_id, {_PHRASE} AS phrase, CAST(ts AS DATE) AS d FROM events)"


@query(f"WITH {_PH} SELECT event_id, {_absolute_sql('phrase')} AS text, nullif(regexp_extract({_absolute_sql('phrase')}, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS due FROM p")
def f3_absolutize(spark: S, sf: P) -> DataFrame:
    return _phrases(spark, sf).select("event_id", T.absolutize(F.col("phrase"), F.col("day")).alias("text"), T.norm_due(F.col("phrase"), F.col("day")).alias("due"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.7::DOUBLE ELSE least(1::DOUBLE, greatest(0::DOUBLE, value / 100)) END AS v FROM events")
def f5_clamp(spark: S, sf: P) -> DataFrame:
    raw = F.when(F.col("event_id") % 5 == 0, "abc").otherwise((F.col("value") / 100).cast("string"))
    return D.read(spark, sf, "events").select("event_id", T.clamp(raw, 0.0, 1.0, 0.7).alias("v"))


def _answers(spark: S, sf: P) -> DataFrame:
    fact = F.format_string('{"turn_ref":"T-%d","quote":"q","object":"k%s","confidence":0.5,}', "event_id", F.get_json_object("props", "$.k"))
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('sure:\n```json\n{"facts":['), fact, F.lit('],"summary":" s "}\n```')))
    raw = raw.when(F.col("event_id") % 4 == 1, F.concat(F.lit('here {"facts": ['), fact, F.lit(", "), fact, F.lit('], "summary": "x"} end')))
    raw = raw.when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), fact, F.lit(",]"))).otherwise("no json { at all")
    return D.read(spark, sf, "events").select("event_id", raw.alias("raw"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS n, CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'k' || json_extract_string(props, '$.k') END AS object,
CASE event_id % 4 WHEN 0 THEN 's' WHEN 1 THEN 'x' ELSE '' END AS summary FROM events"""
)
def f11_json_rescue(spark: S, sf: P) -> DataFrame:
    found = X.parse_facts(F.col("raw"))
    return _answers(spark, sf).select("event_id", F.size(found).alias("n"), F.get(found, F.lit(0))["object"].alias("object"), X.parse_summary(F.col("raw")).alias("summary"))


@query(
    """SELECT event_id, least(3, CAST(event_id % 6 AS INTEGER)) AS n, CASE WHEN event_id % 6 > 0 THEN CASE WHEN event_id % 2 = 0 THEN 'ask' ELSE 'share' END END AS kind,
CASE WHEN event_id % 6 > 0 THEN strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') END AS due_day FROM events"""
)
def f14_parse_topics(spark: S, sf: P) -> DataFrame:
    one = F.format_string('{"text":"t%d","kind":"%s","due_day":"明天"}', "event_id", F.when(F.col("event_id") % 2 == 0, "ASK").otherwise("odd"))
    raw = F.concat(F.lit('{"topics":['), F.array_join(F.array_repeat(one, (F.col("event_id") % 6).cast("int")), ","), F.lit("]}"))
    found = X.parse_topics(raw, F.date_format("ts", "yyyy-MM-dd"))
    head = F.get(found, F.lit(0))
    return D.read(spark, sf, "events").select("event_id", F.size(found).alias("n"), head["kind"].alias("kind"), head["due_day"].alias("due_day"))


def _norm_sql(x: str) -> str:
    return f"regexp_replace({x}, '{_sql_class(T.NOISE)}', '', 'g')"


@query(
    f"""WITH b AS (SELECT d.doc_id, d.text, b.text AS quote, d.doc_id % 3 AS role FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40),
c AS (SELECT *, contains({_norm_sql('text')}, {_norm_sql('quote')}) AS whole, {_tok('quote')} AS t, {_norm_sql('text')} AS body FROM b),
s AS (SELECT *, CASE WHEN len(t) = 0 THEN 0 ELSE CAST(len(list_filter(t, lambda x: contains(body, x))) AS DOUBLE) / len(t) END AS share FROM c)
SELECT doc_id, CASE WHEN role = 2 OR quote IS NULL THEN 'drop' WHEN whole THEN 'active' WHEN share >= 0.6 THEN 'pending' ELSE 'drop' END AS verdict FROM s"""
)
def v2_verify(spark: S, sf: P) -> DataFrame:
    d, b = D.read(spark, sf, "documents"), D.read(spark, sf, "benchmark")
    turns = d.select(F.lit("u").alias("uid"), F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 == 2, "assistant").otherwise("user").alias("role"), "text", F.lit("2024-01-01").alias("day"))
    quoted = d.select("doc_id", (F.col("doc_id") % 40).alias("item_id")).join(b.select("item_id", F.col("text").alias("quote")), "item_id", "left")
    cand = quoted.select(F.lit("u").alias("uid"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("turn_ref"), "quote", F.lit("fact").alias("kind"), F.lit("他").alias("subject"))
    return X.verify(cand, turns).select(F.col("seq").alias("doc_id"), "verdict")


@query(
    """WITH c AS (SELECT event_id, event_type, value, ts, 'k' || json_extract_string(props, '$.k') AS o, CAST(event_id % 4 AS INTEGER) AS m FROM events WHERE event_id % 6 > 0)
SELECT event_id AS seq, CASE WHEN m = 1 OR event_id % 7 = 0 THEN '她' ELSE '他' END AS subject, event_type AS predicate, o AS object, list_extract(['fact', 'promise', 'commitment', 'fact'], m + 1) AS kind, least(1::DOUBLE, greatest(0::DOUBLE, value / 100)) AS confidence, 0.5::DOUBLE AS importance,
strftime(ts, '%Y-%m-%d') AS valid_from, CASE WHEN event_id % 6 = 1 THEN 'pending' ELSE 'active' END AS status, CASE WHEN event_id % 2 = 0 THEN strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') END AS due FROM c"""
)
def v3_clean(spark: S, sf: P) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(x) for x in (" FACT", "promise ", "Commitment", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = D.read(spark, sf, "events").select(
        F.lit("u").alias("uid"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 7 == 0, " 她").otherwise("someone").alias("subject"), F.concat(F.lit(" "), "event_type").alias("predicate"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k"), F.lit(" ")).alias("object"), F.when(F.col("event_id") % 2 == 0, "明天").otherwise("null").alias("due"), F.lit("T-1").alias("turn_ref"), F.lit("q").alias("quote"),
        (F.col("value") / 100).cast("string").alias("confidence"), F.lit("many").alias("importance"), F.lit(None).cast("string").alias("persona_attention"), F.date_format("ts", "yyyy-MM-dd").alias("turn_day"),
        F.when(F.col("event_id") % 6 == 0, "drop").when(F.col("event_id") % 6 == 1, "pending").otherwise("active").alias("verdict"),
    )
    return X.clean(rows).select("seq", "subject", "predicate", "object", "kind", "confidence", "importance", "valid_from", "status", "due")


@query(f"WITH {D.FACTS} SELECT uid, id, greatest(0.05::DOUBLE, round(importance * 0.7::DOUBLE, 3)) AS importance FROM facts WHERE status = 'active' AND valid_to IS NULL AND NOT pinned AND kind = 'fact' AND CAST(valid_from AS DATE) < DATE '2024-04-15' - 90 AND greatest(0.05::DOUBLE, round(importance * 0.7::DOUBLE, 3)) < importance")
def c2_decay_ops(spark: S, sf: P) -> DataFrame:
    return C.decay_ops(D.facts(spark, sf).withColumn("last_used_at", F.lit(None).cast("string")), "2024-04-15")


_DUP = f"""WITH RECURSIVE {D.FACTS}, it AS (SELECT uid, predicate, id, object, confidence, {_tok('object')} AS t, row_number() OVER (PARTITION BY uid, predicate ORDER BY pinned DESC, importance DESC, persona_attention DESC, id) AS n FROM facts WHERE status = 'active' AND valid_to IS NULL),
fold(uid, predicate, n, leaders, id, leader) AS (SELECT uid, predicate, n, [{{'id': id, 't': list_distinct(t)}}], id, id FROM it WHERE n = 1 UNION ALL
 SELECT uid, predicate, n, CASE WHEN len(alike) = 0 THEN list_append(leaders, {{'id': id, 't': x}}) ELSE leaders END, id, CASE WHEN len(alike) = 0 THEN id ELSE alike[1].id END FROM (
 SELECT i.uid, i.predicate, i.n, f.leaders, i.id, list_distinct(i.t) AS x, list_filter(f.leaders, lambda y: CAST(len(list_intersect(y.t, list_distinct(i.t))) AS DOUBLE) / least(len(y.t), len(list_distinct(i.t))) >= 0.8
  AND CAST(len(list_intersect(y.t, list_distinct(i.t))) AS DOUBLE) / len(list_distinct(list_concat(y.t, list_distinct(i.t)))) >= 0.8::DOUBLE * 0.6::DOUBLE) AS alike FROM fold f JOIN it i ON i.uid = f.uid AND i.predicate = f.predicate AND i.n = f.n + 1)),
du AS (SELECT uid, leader, id FROM fold QUALIFY count(*) OVER (PARTITION BY uid, leader) > 1)"""


@query(_DUP + " SELECT uid, leader, id FROM du")
def a7_find_duplicates(spark: S, sf: P) -> DataFrame:
    """A fold in list order."""
    return C.duplicates(D.facts(spark, sf))


@query(_DUP + ", best AS (SELECT du.uid, du.id, first_value(du.id) OVER (PARTITION BY du.uid, du.leader ORDER BY length(f.object) DESC, f.confidence DESC, du.id) AS merged_into FROM du JOIN facts f ON f.uid = du.uid AND f.id = du.id) SELECT uid, id, merged_into FROM best WHERE id <> merged_into")
def c1_merge_ops(spark: S, sf: P) -> DataFrame:
    """The objects have no signs, so their content is their length."""
    return C.merge_ops(D.facts(spark, sf))


@query(
    f"""WITH {D.FACTS}, w AS (SELECT uid, id, substr(sha1(subject || ' ' || predicate || ' ' || object), 1, 16) AS h FROM facts WHERE status IN ('active', 'pending')),
v AS (SELECT uid, id, substr(sha1(subject || ' ' || predicate || ' ' || CASE WHEN first_seq % 7 = 0 THEN 'old' ELSE object END), 1, 16) AS h FROM facts WHERE first_seq % 5 > 0)
SELECT coalesce(w.uid, v.uid) AS uid, coalesce(w.id, v.id) AS id, CASE WHEN w.h IS NULL THEN 'drop' ELSE 'encode' END AS action FROM w FULL JOIN v ON w.uid = v.uid AND w.id = v.id WHERE w.h IS NULL OR v.h IS NULL OR w.h <> v.h"""
)
def m7_reindex_plan(spark: S, sf: P) -> DataFrame:
    f = D.facts(spark, sf)
    stale = F.when(F.col("first_seq") % 7 == 0, "old").otherwise(F.col("object"))
    held = f.where("first_seq % 5 > 0").select("uid", F.col("id").alias("fact_id"), F.lit(8).alias("dim"), T.text_hash(F.concat_ws(" ", "subject", "predicate", stale)).alias("text_hash"), F.lit("m").alias("model"))
    return V.plan(f, held, "m", 8)


@query(f"WITH {D.FACTS} SELECT CAST(label AS VARCHAR) AS uid, vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.uid = CAST(e.label AS VARCHAR) AND f.id = 'F-' || lpad(CAST(e.vec_id AS VARCHAR), 9, '0'))")
def j6_orphans(spark: S, sf: P) -> DataFrame:
    return V.orphans(D.vectors(spark, sf), D.facts(spark, sf)).select("uid", "vec_id")


@query(f"WITH {D.FACTS}, f AS (SELECT uid, count(*) AS n FROM facts WHERE status IN ('active', 'pending') GROUP BY uid), v AS (SELECT CAST(label AS VARCHAR) AS uid, count(*) AS n, max(len(embedding)) AS dim FROM embeddings GROUP BY 1) SELECT coalesce(f.uid, v.uid) AS uid, coalesce(f.n, 0) AS facts, coalesce(v.n, 0) AS vectors, CAST(coalesce(dim, 0) AS INTEGER) AS dim, greatest(0, coalesce(f.n, 0) - coalesce(v.n, 0)) AS stale, CASE WHEN v.n > 0 THEN 'm' ELSE '' END AS models, coalesce(v.n, 0) > 0 AS model_mismatch FROM f FULL JOIN v ON f.uid = v.uid")
def a3_vector_stats(spark: S, sf: P) -> DataFrame:
    found = V.stats(D.facts(spark, sf), D.vectors(spark, sf), "another")
    return found.select("uid", "facts", "vectors", "dim", "stale", F.array_join("models", ",").alias("models"), "model_mismatch")


@query()
def f16_mock_embed(spark: S, sf: P) -> DataFrame:
    rows = D.read(spark, sf, "benchmark")
    return rows.select("item_id", T.mock_embedding(F.col("text")).alias("vec"))


@query(
    f"""WITH {D.FACTS}, r AS (SELECT *, CASE WHEN status = 'active' THEN 0 ELSE 1 END AS part FROM facts WHERE (status = 'active' AND valid_to IS NULL) OR status = 'superseded'),
l AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY part, pinned DESC, importance DESC, persona_attention DESC, id) AS n, CASE WHEN part = 0 THEN '## ' || subject || predicate || object || ' (#' || id || ', ' || status || ', ' || format('{{:.1f}}', floor(importance * 10 + 0.5) / 10) || ', ' || format('{{:.1f}}', floor(persona_attention * 10 + 0.5) / 10) || CASE WHEN pinned THEN ', pinned' ELSE '' END || ')' || chr(10) || '- ' || valid_from || ' ' || quote || ' (' || turn_ref || ')'
 ELSE '- ' || id || ' ' || subject || predicate || object || ': until ' || coalesce(valid_to, '?') END AS line FROM r) SELECT uid, string_agg(line, chr(10) ORDER BY n) AS view FROM l GROUP BY uid"""
)
def w11_render_facts(spark: S, sf: P) -> DataFrame:
    return FA.render(D.facts(spark, sf))


@query("SELECT conv_id, turn, replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(13), chr(92) || 'r'), chr(10), chr(92) || 'n') AS line, text AS back FROM conversations")
def f17_escape(spark: S, sf: P) -> DataFrame:
    return D.read(spark, sf, "conversations").select("conv_id", "turn", T.escape(F.col("text")).alias("line"), T.unescape(T.escape(F.col("text"))).alias("back"))
