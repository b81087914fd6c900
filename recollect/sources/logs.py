"""Text logs of turns and operations: reading files of an older layout, and exporting to it."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import OPS

_LINE = r"^- (T-\d{6,}) (\d{2}:\d{2}:\d{2}) (user|assistant) (.*)$"


def parse_days(files: DataFrame) -> DataFrame:
    """``uid, day, text`` whole files to turns. A last line without its break is torn and left out; a ``## `` line dates those after it; an assistant's leading ``[tags]`` are taken off."""
    whole = F.regexp_replace("text", r"\r\n", "\n")
    lines = F.split(whole, "\n")
    rows = files.select("uid", "day", F.posexplode(F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))).alias("n", "line"))
    w = Window.partitionBy("uid", "day").orderBy("n")
    heading = F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 100)))
    rows = rows.withColumn("hour", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(""))).where(F.col("line").rlike(_LINE))
    part = lambda i: F.regexp_extract("line", _LINE, i)
    rows = rows.select("uid", "day", "n", "hour", part(1).alias("id"), part(2).alias("time"), part(3).alias("role"), part(4).alias("said"))
    tags = F.when(F.col("role") == "assistant", F.regexp_extract("said", r"^((?:\[[^\]]*\]\s*)*)", 1)).otherwise("")
    rows = rows.withColumn("_tags", tags)
    named = F.transform(F.regexp_extract_all("_tags", F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda x: x)
    body = F.substring(F.col("said"), F.length("_tags") + 1, F.length("said"))
    return rows.select("uid", F.regexp_extract("id", r"(\d+)", 1).cast("long").alias("seq"), "id", "day", "hour", "time", "role", named.alias("tags"), T.unescape(body).alias("text"))


def read_days(spark: SparkSession, root: str) -> DataFrame:
    """Day files ``root/xx/uid/sessions/day.md`` and archived ``day.md.gz``; of a day in both the live file counts."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,md.gz}")
    path = F.input_file_name()
    named = files.select(F.regexp_extract(path, r"/([^/]+)/sessions[^/]*/\d{4}-\d{2}-\d{2}\.md", 1).alias("uid"), F.regexp_extract(path, r"/(\d{4}-\d{2}-\d{2})\.md(?:\.gz)?$", 1).alias("day"), path.endswith(".gz").alias("old"), F.col("value").alias("text"))
    first = F.row_number().over(Window.partitionBy("uid", "day").orderBy("old"))
    return parse_days(named.where("day <> ''").withColumn("_n", first).where("_n = 1"))


def parse_ops(lines: DataFrame) -> DataFrame:
    """``uid, seq, line`` JSON lines to log rows; what isn't an object with an ``op`` is left out."""
    fields = [x.split(" ", 1) for x in OPS.split(", ") if x.split(" ", 1)[0] not in ("uid", "seq", "edits")]
    schema = ", ".join(f"{n} {t}" for n, t in fields) + ", `set` map<string,string>"
    rows = lines.select("uid", "seq", F.from_json("line", schema).alias("o")).where("coalesce(o.op, '') <> ''")
    return rows.select("uid", "seq", *(F.col(f"o.{n}").alias(n) for n, _ in fields), F.col("o.set").alias("edits"))


def read_ops(spark: SparkSession, root: str) -> DataFrame:
    """Operation logs ``root/xx/uid/log.jsonl``, numbered in their order."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="log.jsonl")
    named = files.select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/log\.jsonl$", 1).alias("uid"), F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return parse_ops(named.select("uid", (F.col("seq") + 1).cast("long").alias("seq"), "line"))


def day_text(turns: DataFrame) -> DataFrame:
    """``uid, day, text`` of turns, as files hold them."""
    line = F.format_string("- %s %s %s %s", "id", F.coalesce("time", F.lit("00:00:00")), "role", T.escape(F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return turns.groupBy("uid", "day").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def move_old_months(turns: DataFrame, plan: DataFrame, archive: str) -> DataFrame:
    """Writes the months of ``plan(uid, month)`` to the archive (zstd) and returns the turns that stay.

    What the archive holds already isn't written again, so the move may be repeated; another version of a turn is kept beside it.
    """
    rows = turns.withColumn("month", F.substring("day", 1, 7))
    old = rows.join(plan.select("uid", "month"), ["uid", "month"], "left_semi")
    try:
        held = turns.sparkSession.read.parquet(archive).withColumn("day", F.col("day").cast("string"))
        same = lambda df: F.sha2(F.to_json(F.struct(*(df[c] for c in turns.columns))), 256)
        held = held.select("uid", "day", same(held).alias("_key")).distinct()
        old = old.withColumn("_key", same(old)).join(held, ["uid", "day", "_key"], "left_anti").drop("_key").select("month", *turns.columns)
    except AnalysisException:
        pass  # there is no archive yet
    old.drop("month").write.mode("append").option("compression", "zstd").partitionBy("day").parquet(archive)
    return rows.join(plan.select("uid", "month"), ["uid", "month"], "left_anti").drop("month")
