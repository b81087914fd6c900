"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
_WEEKDAYS = "一二三四五六日天"
_WEEKS = {"上周": -7, "这周": 0, "本周": 0, "下周": 7}
_DAYS = {"今天": 0, "昨天": -1, "前天": -2, "明天": 1, "后天": 2}
#: Days of a week count from its Monday, single days from the day itself.
_OFFSETS = {w + c: n + min(i, 6) for w, n in _WEEKS.items() for i, c in enumerate(_WEEKDAYS)} | _DAYS
_RELATIVE = "|".join(_OFFSETS)
_BARE = "|".join([*_WEEKS, *(w + "个月" for w in "上这下")])
_QUOTES = "\"'“”‘’"
_BRACKETS = "()（）\\[\\]【】"
_STOPS = ".,:;!?、。，：；！？…"
#: Signs that quotes are compared without, and the wider class that content is measured without.
NOISE = f"[\\s{_STOPS}{_QUOTES}{_BRACKETS}—\\-]+"
WIDE_NOISE = f"[\\s{_STOPS}{_QUOTES}{_BRACKETS}〔〕—~～·|/\\\\\\-]+"
PAST = "上次|那次|之前|以前|从前|当年|那时候|记得|说过|提过|你刚来|刚认识"
DATE = r"\d{4}-\d{2}-\d{2}"


def estimate_tokens(text: Column) -> Column:
    return (F.floor(F.length(F.coalesce(text, F.lit(""))) / 1.5) + 1).cast("long")


def clip_to_tokens(text: Column, budget: Column | int) -> Column:
    """The text if it fits, else as much as the budget holds with an ellipsis; nothing for a budget of 0."""
    b = F.lit(budget) if isinstance(budget, int) else budget
    keep = F.floor((b - 1) * 1.5).cast("int") - 1
    cut = F.when(keep > 0, F.concat(F.regexp_replace(F.substring(text, F.lit(1), keep), r"(?U)\s+$", ""), F.lit(ELLIPSIS))).otherwise(F.lit(""))
    return F.when(b <= 0, "").when(estimate_tokens(text) <= b, text).otherwise(cut)


def norm(text: Column) -> Column:
    """Content without white space and signs."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)" + NOISE, "")


def core_len(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)" + WIDE_NOISE, ""))


def tokenize(text: Column) -> Column:
    """Pairs of neighbouring word characters, across what is removed between them; a lone one is itself."""
    return pairs(words(text))


def words(text: Column) -> Column:
    """The text's word characters."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+", "")


def token_count(text: Column) -> Column:
    """The size of ``tokenize`` without the tokens."""
    n = F.length(words(text))
    return F.when(n == 0, 0).otherwise(F.greatest(n - 1, F.lit(1)))


def pairs(text: Column) -> Column:
    """Neighbouring characters, in time linear in the text."""

    def of(chars: Column) -> Column:
        n = F.size(chars) - 1
        return F.when(n < 1, F.filter(chars, lambda x: x != "")).otherwise(F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b)))

    return let(F.split(text, ""), of)


def fold(text: Column) -> Column:
    """Case and Latin diacritics folded, as full-text search does."""
    marked = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
    plain = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
    return F.translate(F.lower(text), marked, plain)


def absolutize(text: Column, day: Column) -> Column:
    """Relative days become dates, counted from ``day``; bare weeks and months go. A bad day changes nothing."""
    base = F.try_to_date(day, "yyyy-MM-dd")
    # only the words that occur are looked up, each once
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(_RELATIVE), F.lit(0)))
    offsets = F.create_map(*(F.lit(x) for pair in _OFFSETS.items() for x in pair))
    dated = F.transform(found, lambda w: F.struct(w.alias("w"), F.date_format(F.date_add(F.when(F.length(w) > 2, F.date_trunc("week", base).cast("date")).otherwise(base), F.element_at(offsets, w)), "yyyy-MM-dd").alias("d")))
    out = F.aggregate(dated, text, lambda t, x: F.replace(t, x["w"], x["d"]))
    return F.when(base.isNull() | ~text.rlike("[周天月]"), text).otherwise(F.regexp_replace(out, _BARE, ""))


def norm_due(value: Column, day: Column) -> Column:
    """The first date in the text made absolute; null if there is none."""
    s = F.trim(F.coalesce(value, F.lit("")))
    found = F.regexp_extract(absolutize(s, day), DATE, 0)
    return F.when(F.lower(s).isin("", "null", "none", "无"), None).otherwise(F.nullif(found, F.lit("")))


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    """A number within bounds; ``default`` for what is none."""
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), v)))


def safe_name(uid: Column) -> Column:
    kept = F.regexp_replace(F.coalesce(uid, F.lit("")), r"(?U)[^\p{Alnum}_\-]", "")
    return F.when(kept == "", F.lit("default")).otherwise(kept)


def content_id(prefix: str, day: Column, text: Column, digits: int) -> Column:
    """``prefix-yyyymmdd-hash`` of day and text."""
    return F.concat(F.lit(prefix + "-"), F.replace(day, F.lit("-"), F.lit("")), F.lit("-"), F.substring(F.sha1(F.concat(day, F.lit("\n"), text)), 1, digits))


def text_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def escape(text: Column) -> Column:
    """One line, without loss."""
    s = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(s, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    # between doubled backslashes, so that what follows one isn't taken for an escape
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r"))), "\\")


def mock_embedding(text: Column, dim: int = 64) -> Column:
    """Counts of character pairs by CRC, at unit length; a zero vector for empty text."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    slots = F.transform(pairs(s), lambda g: (F.crc32(F.encode(g, "utf-8")) % dim).cast("int"))
    counts = let(slots, lambda x: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.size(F.filter(x, lambda y: y == j)).cast("double")))
    unit = lambda x, n: F.transform(x, lambda y: F.when(n > 0, y / n).otherwise(0.0).cast("float"))
    return let(counts, lambda x: let(F.sqrt(F.aggregate(x, F.lit(0.0), lambda t, y: t + y * y)), lambda n: unit(x, n)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def past_mentioned(query: Column) -> Column:
    return F.trim(F.coalesce(query, F.lit(""))).rlike(PAST)


def card_text(subject: Column, predicate: Column, obj: Column, kind: Column, due: Column) -> Column:
    """A fact on one line; promises with a date carry it."""
    text = F.concat(*(F.coalesce(x, F.lit("")) for x in (subject, predicate, obj)))
    dated = kind.isin("commitment", "promise") & (F.coalesce(due, F.lit("")) != "")
    return F.when(dated, F.concat(text, F.lit("（"), F.substring(due, 1, 10), F.lit(" 之前）"))).otherwise(text)


def json_candidates(raw: Column) -> list[Column]:
    """Where a model's answer may hold its JSON: a fenced block, the outermost braces; then each without trailing commas."""
    fence = F.trim(F.regexp_extract(raw, r"```(?:json)?\s*([\s\S]*?)```", 1))
    braces = F.regexp_extract(raw, r"\{[\s\S]*\}", 0)
    plain = [F.nullif(x, F.lit("")) for x in (fence, braces)]
    return [y for x in plain for y in (x, F.regexp_replace(x, r",\s*([}\]])", "$1"))]
