"""The data model over the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-15"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("uid"), F.col("turn").alias("pos"), "role", "text")


MESSAGES = "messages AS (SELECT CAST(conv_id AS VARCHAR) AS uid, turn AS pos, role, text FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a message, with the day by its conversation."""
    rows = messages(spark, sf_dir)
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("uid").cast("long") % 30).cast("int")), "yyyy-MM-dd")
    return rows.select("uid", (F.col("pos") + 1).alias("seq"), F.format_string("T-%06d", F.col("pos") + 1).alias("id"), day.alias("day"), role.alias("role"), "text")


TURNS = (
    "turns AS (SELECT CAST(conv_id AS VARCHAR) AS uid, turn + 1 AS seq, 'T-' || lpad(CAST(turn + 1 AS VARCHAR), 6, '0') AS id, "
    "strftime(DATE '2024-01-01' + CAST(conv_id % 30 AS INTEGER), '%Y-%m-%d') AS day, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations)"
)

_E = "CAST({} AS DOUBLE) / {}"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact for each event; its number sets its state."""
    e = read(spark, sf_dir, "events").selectExpr("event_id AS n", "CAST(user_id AS STRING) AS uid", "event_type", "date_format(ts, 'yyyy-MM-dd') AS day", "get_json_object(props, '$.k') AS k")
    kind = "CASE WHEN n % 13 = 0 THEN 'commitment' WHEN n % 17 = 0 THEN 'promise' ELSE 'fact' END"
    return e.selectExpr(
        "uid", "concat('F-', lpad(CAST(n AS STRING), 9, '0')) AS id", "'他' AS subject", "event_type AS predicate", "concat('k', k) AS object", "concat('said ', event_type, ' ', k) AS quote",
        "concat('T-', lpad(CAST(n % 50 AS STRING), 6, '0')) AS turn_ref", f"{kind} AS kind", "day AS valid_from", "CASE WHEN n % 11 = 0 THEN '2024-02-01' END AS valid_to",
        "CAST(n % 9 AS DOUBLE) / 8 AS confidence", "CAST(n % 17 AS DOUBLE) / 16 AS importance", "CAST(n % 5 AS DOUBLE) / 4 AS persona_attention", "n % 37 = 0 AS pinned",
        "CASE WHEN n % 19 = 0 THEN 'pending' WHEN n % 23 = 0 THEN 'superseded' ELSE 'active' END AS status", f"CASE WHEN {kind} <> 'fact' AND n % 2 = 0 THEN day END AS due", "'extract' AS source", "n AS first_seq",
    )


_KIND = "CASE WHEN event_id % 13 = 0 THEN 'commitment' WHEN event_id % 17 = 0 THEN 'promise' ELSE 'fact' END"
FACTS = f"""facts AS (SELECT CAST(user_id AS VARCHAR) AS uid, 'F-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS id, '他' AS subject, event_type AS predicate, 'k' || json_extract_string(props, '$.k') AS object,
 'said ' || event_type || ' ' || json_extract_string(props, '$.k') AS quote, 'T-' || lpad(CAST(event_id % 50 AS VARCHAR), 6, '0') AS turn_ref, {_KIND} AS kind, strftime(ts, '%Y-%m-%d') AS valid_from,
 CASE WHEN event_id % 11 = 0 THEN '2024-02-01' END AS valid_to, CAST(event_id % 9 AS DOUBLE) / 8 AS confidence, CAST(event_id % 17 AS DOUBLE) / 16 AS importance, CAST(event_id % 5 AS DOUBLE) / 4 AS persona_attention,
 event_id % 37 = 0 AS pinned, CASE WHEN event_id % 19 = 0 THEN 'pending' WHEN event_id % 23 = 0 THEN 'superseded' ELSE 'active' END AS status,
 CASE WHEN {_KIND} <> 'fact' AND event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS due, event_id AS first_seq FROM events)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event says its user's value of its type."""
    return read(spark, sf_dir, "events").selectExpr("CAST(user_id AS STRING) AS uid", "event_id AS seq", "'他' AS subject", "event_type AS predicate", "concat('v', CAST(get_json_object(props, '$.k') AS INT) % 4) AS object", "'active' AS status")


CANDIDATES = "cand AS (SELECT CAST(user_id AS VARCHAR) AS uid, event_id AS seq, '他' AS subject, event_type AS predicate, 'v' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS VARCHAR) AS object FROM events)"
OP_KINDS = ("ADD", "SUPERSEDE", "EDIT", "INVALIDATE", "PIN", "CONFIRM", "FORGET", "MERGE", "DEROGATE", "ADD", "EDIT", "ADD")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of all kinds of operation: events in their order, on five facts for each user and type."""
    e = read(spark, sf_dir, "events").selectExpr("event_id AS n", "CAST(user_id AS STRING) AS uid", "event_type", "date_format(ts, 'yyyy-MM-dd') AS day", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    op = f"element_at(array({', '.join(repr(x) for x in OP_KINDS)}), CAST((n * 7 + k) % 12 AS INT) + 1)"
    nul = lambda *names: [f"CAST(NULL AS STRING) AS {x}" for x in names]
    return e.selectExpr(
        "uid", "n AS seq", f"{op} AS op", "concat(event_type, '-', k % 5) AS id", "concat(day, 'T00:00:00') AS ts", "'他' AS subject", "event_type AS predicate", "concat('o', n % 100) AS object",
        "concat('q', n) AS quote", "'T-000001' AS turn_ref", "'fact' AS kind", "day AS valid_from", "CAST(NULL AS STRING) AS valid_to", "CAST(0.75 AS DOUBLE) AS confidence", "CAST(n % 16 AS DOUBLE) / 16 AS importance",
        "CAST(0.5 AS DOUBLE) AS persona_attention", "n % 2 = 0 AS pinned", "CASE WHEN n % 3 = 0 THEN 'pending' ELSE 'active' END AS status", *nul("due", "source"), "concat(event_type, '-', (k + 1) % 5) AS replaces",
        "map('object', concat('e', n % 100)) AS edits", "CASE WHEN n % 4 = 0 THEN 'purge' ELSE 'archive' END AS mode", *nul("merged_into", "reason"), "day", *nul("created_at", "text", "due_day", "ref"),
    )


_OP = f"list_extract([{', '.join(repr(x) for x in OP_KINDS)}], CAST((event_id * 7 + CAST(json_extract_string(props, '$.k') AS INTEGER)) % 12 AS INTEGER) + 1)"
OPS = f"""e AS (SELECT event_id AS n, CAST(user_id AS VARCHAR) AS uid, event_type, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, {_OP} AS op FROM events),
steps AS (SELECT uid, event_type || '-' || CAST((k + 1) % 5 AS VARCHAR) AS id, n, 0 AS sub, 'END' AS step, day FROM e WHERE op = 'SUPERSEDE'
 UNION ALL SELECT uid, event_type || '-' || CAST(k % 5 AS VARCHAR), n, 1, CASE WHEN op = 'SUPERSEDE' THEN 'ADD' ELSE op END, day FROM e)"""


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a user's notes: the source is the user."""
    d = read(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")), "yyyy-MM-dd")
    due = F.when(F.col("doc_id") % 3 == 0, day).otherwise("")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("followup", "share", "ask", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select(F.col("source").alias("uid"), day.alias("day"), F.coalesce("text", F.lit("")).alias("text"), kind.alias("kind"), due.alias("due_day"), "doc_id")


PROSE = """prose AS (SELECT source AS uid, strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') AS day, trim(coalesce(text, ''), ' ') AS text,
 list_extract(['followup', 'share', 'ask', 'other'], CAST(doc_id % 4 AS INTEGER) + 1) AS kind0, CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 60 AS INTEGER), '%Y-%m-%d') ELSE '' END AS due_day, doc_id FROM documents)"""
SUMMARIES = "summaries AS (SELECT DISTINCT uid, 'S-' || replace(day, '-', '') || '-' || substr(sha1(day || chr(10) || text), 1, 12) AS id, day, text FROM prose WHERE text <> '')"
TOPICS = """topics AS (SELECT uid, id, any_value(day) AS day, any_value(text) AS text, min(kind) AS kind, min(due_day) AS due_day FROM (SELECT uid, 'TP-' || replace(day, '-', '') || '-' || substr(sha1(day || chr(10) || text), 1, 10) AS id, day, text,
 CASE WHEN kind0 = 'other' THEN 'share' ELSE kind0 END AS kind, due_day FROM prose WHERE text <> '') GROUP BY uid, id)"""


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.facts import summary_ops

    return summary_ops(prose(spark, sf_dir)).withColumn("created_at", F.lit(""))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.facts import topic_ops

    return topic_ops(prose(spark, sf_dir)).withColumns({"created_at": F.lit(""), "used": F.ascii(F.substring("id", -1, 1)) % 5 == 0})


TOPICS_USED = TOPICS + ", open_topics AS (SELECT *, ascii(right(id, 1)) % 5 = 0 AS used FROM topics)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as stored vectors; the label is the user."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("uid"), F.format_string("F-%09d", "vec_id").alias("fact_id"), F.size("embedding").alias("dim"), F.col("embedding").alias("vec"), F.sha1(F.col("vec_id").cast("string")).alias("text_hash"), F.lit("m").alias("model"), "vec_id")
