"""Recall: exact slots, full text and vectors fused by rank; budgets; the context of a turn. For all users' queries at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import Config
from ..functions import text as T
from . import facts as FA

PINS, SLOT_LIMIT, K1, B = 64, 8, 1.2, 0.75
Q = ["uid", "qid"]
#: Tokens of queries whose weights are broadcast: some 40 MB.
ASKED = 500_000
#: Vectors, or queries, of a block, and the products of both that a task holds at a time.
BLOCK, CELLS = 16_384, 4_000_000
#: Characters of texts whose tokens are counted at a time; the second half of a token of one character.
CHARS, LONE = 1_000_000, (1 << 21) - 1
#: Rows of one uid from which on they are spread over several tasks.
SPREAD = 500_000


def budget(rows: DataFrame, keys: list[str], order: list[Column], cost: Column, limit: int) -> DataFrame:
    """The prefix of each group that fits; its first row always does. Adds ``used``, the cost so far."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n, used = F.row_number().over(w), F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_n": n, "used": used}).where((F.col("_n") == 1) | (F.col("used") <= limit)).drop("_n")


def weight() -> Column:
    return F.coalesce("importance", F.lit(0.0)) * (F.lit(0.5) + F.coalesce("persona_attention", F.lit(0.0)))


def hot_order() -> list[Column]:
    """Pinned ones, promises by date, the rest by weight."""
    promise = F.col("kind").isin("commitment", "promise")
    due = F.when(promise, F.coalesce(F.nullif("due", F.lit("")), F.lit("9999")))
    return [F.desc("pinned"), F.when(promise, 0).otherwise(1).asc(), due.asc_nulls_last(), weight().desc(), F.asc("id")]


def dedup_slots(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One fact a slot (pinned, newest, most important), at the place (``pos``) of the slot's first one in ``order``."""
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    rows = rows.withColumns({"_s": F.trim(F.coalesce("subject", F.lit(""))), "_p": F.trim(F.coalesce("predicate", F.lit("")))})
    slot = Window.partitionBy(*keys, "_s", "_p")
    stamp = F.coalesce(F.regexp_replace(F.substring(F.coalesce("valid_from", F.lit("")), 1, 10), "-", "").try_cast("long"), F.lit(0))
    best = F.row_number().over(slot.orderBy(F.desc("pinned"), stamp.desc(), F.coalesce("importance", F.lit(0.0)).desc(), F.asc("id")))
    rows = rows.withColumns({"_b": best, "pos": F.min("pos").over(slot)})
    return rows.where("_b = 1").drop("_b", "_s", "_p")


def hot_facts(facts: DataFrame, cfg: Config = Config(), exclude: DataFrame | None = None, keys: tuple[str, ...] = ("uid",)) -> DataFrame:
    """What every turn of a ``uid`` is given, within ``hot_tokens``: facts with ``place`` and ``used``.

    ``exclude(uid, turn_ref)`` are turns just said. The candidates are the first ``hot_fetch_max`` of each.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(*hot_order())
    rows = FA.list_facts(facts).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cfg.hot_fetch_max)
    said = F.lit(False)
    if exclude is not None:
        rows = rows.join(exclude.select(*keys, "turn_ref", F.lit(True).alias("_said")).distinct(), [*keys, "turn_ref"], "left")
        said = F.coalesce("_said", F.lit(False))
    rows = dedup_slots(rows.where(FA.live(said, cfg.min_confidence)), keys, hot_order())
    first = [F.desc("pinned"), F.when(F.col("pinned"), F.col("pos")).asc_nulls_last(), *hot_order()[1:]]
    rows = budget(rows, keys, first, T.estimate_tokens(FA.card()), cfg.hot_tokens)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*first)))
    return rows.drop("_r", "_said", "pos")


def _prose(rows: DataFrame, limit: int, tokens: int) -> DataFrame:
    """Ranked texts within a budget; a first one over it is clipped."""
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("text", text).where("text <> ''")
    first = F.row_number().over(Window.partitionBy("uid").orderBy("rank")) == 1
    rows = rows.withColumn("_first", first)
    rows = rows.withColumn("text", F.when(F.col("_first"), T.clip_to_tokens(F.col("text"), tokens)).otherwise(F.col("text")))
    rows = budget(rows, ["uid"], [F.asc("rank")], T.estimate_tokens(F.col("text")), tokens)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("uid").orderBy("rank")))
    return rows.where((F.col("_n") <= limit) & (F.col("text") != "")).drop("_n", "_first")


def hot_summaries(summaries: DataFrame, cfg: Config = Config()) -> DataFrame:
    if cfg.story_k <= 0:
        return _prose(FA.list_summaries(summaries, 0), 0, 1)
    return _prose(FA.list_summaries(summaries, max(8, 4 * cfg.story_k)), cfg.story_k, cfg.story_tokens)


def hot_topics(topics: DataFrame, cfg: Config = Config()) -> DataFrame:
    if cfg.topic_k <= 0 or cfg.topic_tokens <= 0:
        return _prose(FA.list_topics(topics, 0), 0, 1)
    return _prose(FA.list_topics(topics, max(4, 3 * cfg.topic_k)), cfg.topic_k, cfg.topic_tokens)


def _counted(texts: pa.Array):
    """Tokens of texts without other than word characters, some million characters at a time: the chunk's first row, row, code and count of
    each of a row's distinct tokens, and all rows' numbers of tokens. A code has two characters, or one and ``LONE``."""
    chars = pc.utf8_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(chars), 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CHARS, "right")))
        n = chars[start:end]
        c = np.frombuffer("".join(x or "" for x in texts[start:end].to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        lone = n[row] == 1
        code = np.append(c[:-1] << 21 | c[1:], 0)[: len(c)]
        code[lone] = c[lone] << 21 | LONE
        whole = np.append(row[:-1] == row[1:], False)[: len(c)] | lone
        size = np.where(n > 1, n - 1, n)
        code, row = code[whole], row[whole]
        # rows follow one another: of each, its codes in order
        order = np.lexsort((code, row)) if len(n) >= 1 << 20 else None
        if order is None:
            key = np.sort(row << 42 | code)
            row, code = key >> 42, key & (1 << 42) - 1
        else:
            row, code = row[order], code[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)])
        yield start, row[first], code[first], np.diff(np.append(first, len(row))), size
        start = end


def _names(codes: np.ndarray) -> list[str]:
    return [chr(x >> 21) + (chr(x & LONE) if x & LONE != LONE else "") for x in codes.tolist()]


def _post(batches):
    """``uid, id, text`` to postings of each row."""
    for batch in batches:
        for start, row, code, tf, size in _counted(batch.column(2)):
            codes, at = np.unique(code, return_inverse=True)
            rows = pa.array(row + start)
            token = pa.array(_names(codes), pa.string()).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(size[row], pa.int32()), token, pa.array(tf, pa.int64())], names=["uid", "id", "length", "token", "tf"])


def _held_by(batches):
    """``uid, id, text`` to the number of a chunk's rows that hold a token: ``uid, token, n``."""
    for batch in batches:
        for start, row, code, _, _ in _counted(batch.column(2)):
            found = pa.table([batch.column(0).take(pa.array(row + start)), pa.array(code)], names=["uid", "code"]).group_by(["uid", "code"]).aggregate([([], "count_all")])
            for x in found.to_batches():
                yield pa.RecordBatch.from_arrays([x.column("uid"), pa.array(_names(x.column("code").to_numpy()), pa.string()), x.column("count_all").cast(pa.int64())], names=["uid", "token", "n"])


def postings(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``uid, id, text`` to ``uid, id, token, tf, length`` of folded tokens; rows of one id and length are one."""
    rows = rows.select("uid", F.col(id_col).alias("id"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    repeated = rows.groupBy("uid", "id").count().where("count > 1").limit(1).count() > 0
    post = spread(rows).select("uid", "id", T.words(T.fold(F.col("text"))).alias("text")).mapInArrow(_post, f"uid string, id {kind}, length int, token string, tf long")
    return post.groupBy("uid", "id", "length", "token").agg(F.sum("tf").alias("tf")) if repeated else post


def _top_scores(weights, limit: int):
    """A task's best ``limit`` rows of each query: one pass over its rows ``uid, id, text``."""

    def run(batches):
        asked = weights.value
        of_uid: dict[str, list[tuple]] = {}
        numbers: dict[str, dict[str, int]] = {}
        for (uid, qid, mean), (tokens, w) in asked.items():
            known = numbers.setdefault(uid, {})
            at = np.array([known.setdefault(t, len(known)) for t in tokens], np.int64)
            of_uid.setdefault(uid, []).append((qid, mean, at, w))
        best: dict[tuple, list] = {}
        for batch in batches:
            owners, all_ids = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
            for start, doc, code, counts, length in _counted(batch.column(2)):
                uids, ids = owners[start : start + len(length)], all_ids[start : start + len(length)]
                codes, token = np.unique(code, return_inverse=True)
                names = _names(codes)
                for uid in set(uids) & set(of_uid):
                    known = numbers[uid]
                    number = np.array([known.get(t, -1) for t in names], np.int64)
                    mine = uids == uid
                    n = number[token]
                    use = (n >= 0) & mine[doc]
                    d, t, tf = doc[use], n[use], counts[use]
                    rows, first = np.unique(d, return_index=True)
                    for qid, mean, at, w in of_uid[uid]:
                        own = np.zeros(len(known))
                        own[at] = w
                        # tenths of a trillionth, so that sums don't depend on their order
                        part = np.rint(own[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[d] / mean)) * 1e12).astype(np.int64)
                        total = np.add.reduceat(part, first) if len(first) else part
                        met = np.add.reduceat(own[t] != 0, first) > 0 if len(first) else first
                        key, held = (uid, qid), best.get((uid, qid), [])
                        floor = held[-1][0] if len(held) == limit else -(1 << 62)
                        pick = np.flatnonzero(met & (-total <= -floor))
                        if len(pick) > 4 * limit:
                            pick = pick[total[pick] >= np.partition(total[pick], len(pick) - limit)[len(pick) - limit]]
                        held = sorted([*held, *((int(total[i]), ids[rows[i]]) for i in pick)], key=lambda x: x[1])
                        best[key] = sorted(held, key=lambda x: -x[0])[:limit]
        flat = [(uid, qid, i, total) for (uid, qid), held in best.items() for total, i in held]
        columns = list(zip(*flat)) if flat else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c)) if flat else pa.array([], pa.string()) for c in columns[:3]), pa.array(list(columns[3]), pa.int64())], names=["uid", "qid", "id", "total"])

    return run


def spread(rows: DataFrame) -> DataFrame:
    """Rows of fewer partitions than there are cores, as a small file has, spread over all; others as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def bm25(rows: DataFrame, queries: DataFrame, limit: int, keep: Column | None = None, one_pass: bool = True) -> DataFrame:
    """The best ``limit`` rows of each query (``uid, qid, text``) with ``score`` and ``rank``.

    Counts and lengths are over all rows of a ``uid``; only those that ``keep`` holds for are answers. A token twice in a query counts twice.
    Where the queries' distinct tokens are ``ASKED`` at most, their weights are broadcast, each task scores its rows in one pass and
    only its best of each query are shuffled. Beyond that, or without ``one_pass`` (many users with few rows each), tokens meet
    postings on (uid, token), so a frequent token spreads over its rows.
    """
    size = rows.select("uid", T.token_count(F.col("text")).alias("n")).groupBy("uid").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    asked = queries.select(*Q, F.explode(T.tokenize(T.fold(F.col("text")))).alias("token")).groupBy(*Q, "token").agg(F.count("*").alias("times"))
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    rank = F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("score"), F.asc("id")))
    if one_pass and asked.limit(ASKED + 1).count() <= ASKED:
        tokens = spread(rows).select("uid", "id", T.words(T.fold(F.col("text"))).alias("text"), *([] if keep is None else [keep.alias("kept")]))
        df = tokens.select("uid", "id", "text").mapInArrow(_held_by, "uid string, token string, n long").groupBy("uid", "token").agg(F.sum("n").alias("df"))
        weighed = asked.join(df, ["uid", "token"]).join(size, "uid").select(*Q, "mean", "token", (idf * F.col("times")).alias("w"))
        weights: dict[tuple, tuple] = {}
        for r in weighed.groupBy(*Q, "mean").agg(F.collect_list("token").alias("t"), F.collect_list("w").alias("w")).collect():
            weights[(r.uid, r.qid, r.mean)] = (r.t, np.array(r.w))
        if keep is not None:
            tokens = tokens.where("kept").drop("kept")
        kinds = {f.name: f.dataType.simpleString() for f in [*rows.schema.fields, *queries.schema.fields]}
        schema = f"uid string, qid {kinds['qid']}, id {kinds['id']}, total long"
        scores = tokens.mapInArrow(_top_scores(rows.sparkSession.sparkContext.broadcast(weights), limit), schema)
        scores = scores.select(*Q, "id", (F.col("total") / F.lit(1e12)).alias("score"))
        return scores.withColumn("rank", rank).where(F.col("rank") <= limit)
    # only the tokens asked for leave a row, so no table of all tokens is built
    met = with_wanted(rows.select("uid", "id", "text", *([] if keep is None else [keep.alias("kept")])), asked)
    met = met.withColumn("tokens", T.tokenize(T.fold(F.col("text")))).select(*(c for c in met.columns if c not in ("text", "wanted")), F.size("tokens").alias("length"), F.filter("tokens", lambda t: F.array_contains("wanted", t)).alias("tokens"))
    post = met.select("*", F.explode("tokens").alias("token")).groupBy("uid", "_s", "id", "length", "token").agg(F.count("*").alias("tf"), *([] if keep is None else [F.max("kept").alias("kept")]))
    df = post.groupBy("uid", "token").agg(F.count("*").alias("df"))
    weighed = asked.join(df, ["uid", "token"]).join(size, "uid").withColumn("w", idf * F.col("times"))
    if keep is not None:
        post = post.where("kept")
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scores = post.join(weighed, ["uid", "token"]).withColumn("part", F.round(part, 12).cast("decimal(28,12)")).groupBy(*Q, "id").agg(F.sum("part").cast("double").alias("score"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= limit)


def with_wanted(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the ``uid``s that ask for something, with the tokens ``wanted``; a large uid's rows are spread by ``_s``."""
    cuts = F.broadcast(_blocks(rows, SPREAD, "_n"))
    wanted = asked.groupBy("uid").agg(F.collect_set("token").alias("wanted")).join(cuts, "uid", "left")
    wanted = wanted.select("uid", "wanted", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1)).alias("_s"))
    rows = rows.join(cuts, "uid", "left").withColumn("_s", F.pmod(F.xxhash64("id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    return rows.join(wanted, ["uid", "_s"])


def slot_hits(facts: DataFrame, queries: DataFrame, limit: int = SLOT_LIMIT) -> DataFrame:
    """Live facts whose predicate or object equals a token of the query (two characters or more): the first ``limit`` a token, with ``rank``."""
    tokens = queries.select(*Q, F.posexplode(T.tokenize(F.col("text"))).alias("at", "token")).where(F.length("token") >= 2)
    live = FA.list_facts(facts).select("uid", "id", "first_seq", F.array_distinct(F.array("predicate", "object")).alias("tokens"))
    hit = tokens.join(with_wanted(live, tokens).select("uid", "id", "first_seq", F.explode(F.array_intersect("tokens", "wanted")).alias("token")), ["uid", "token"])
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy(*Q, "at").orderBy("first_seq", "id"))).where(F.col("n") <= limit)
    first = hit.groupBy(*Q, "id").agg(F.min(F.struct("at", "n")).alias("f"))
    return first.select(*Q, "id", F.row_number().over(Window.partitionBy(*Q).orderBy("f.at", "f.n")).alias("rank"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    """``uid`` and into how many blocks of some ``most`` rows its rows are cut, of those that have more."""
    return rows.groupBy("uid").agg(F.ceil(F.count("*") / most).cast("int").alias(name)).where(F.col(name) > 1)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first to the last as ``dot`` does."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as lengths (-1 for those without a value, or with a missing one) and a flat array of all their numbers."""
    one = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float32()))
    size = one.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = one.flatten()
    if flat.null_count:
        row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
        bad = np.unique(row[flat.is_null().to_numpy(zero_copy_only=False)])
        keep = ~np.isin(row, bad)
        flat, size = flat.filter(pa.array(keep)), size.copy()
        size[bad] = -1
    return size, flat.to_numpy(zero_copy_only=False).astype(np.float64)


def _nearest(limit: int, min_cos: float, schema: pa.Schema):
    """The best ``limit`` of a block's vectors for each of a block's queries."""

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(stored) and len(asked):
            vsize, vflat = _matrix(stored.column("v"))
            qsize, qflat = _matrix(asked.column("vec"))
            vat, qat = (np.cumsum(np.maximum(x, 0)) - np.maximum(x, 0) for x in (vsize, qsize))
            place = np.empty(len(stored), np.int64)
            place[pc.sort_indices(stored.column("id")).to_numpy()] = np.arange(len(stored))
            owners = pc.unique(pa.chunked_array([*stored.column("uid").chunks, *asked.column("uid").chunks]))
            vown, qown = (pc.index_in(t.column("uid"), owners).to_numpy() for t in (stored, asked))
            groups: dict[tuple, np.ndarray] = {}
            order = np.lexsort((vsize, vown))
            cuts = np.flatnonzero((np.diff(vown[order]) != 0) | (np.diff(vsize[order]) != 0)) + 1
            for rows in np.split(order, cuts):
                groups[vown[rows[0]], vsize[rows[0]]] = rows
            order = np.lexsort((qsize, qown))
            cuts = np.flatnonzero((np.diff(qown[order]) != 0) | (np.diff(qsize[order]) != 0)) + 1
            for qrows in np.split(order, cuts):
                n, rows = int(qsize[qrows[0]]), groups.get((qown[qrows[0]], qsize[qrows[0]]))
                if n < 1 or rows is None:
                    continue
                v = vflat[vat[rows][:, None] + np.arange(n)]
                reach = float(np.sqrt(np.nan_to_num((v * v).sum(1), posinf=0.0)).max())
                step = max(1, CELLS // len(rows))
                for some in (qrows[i : i + step] for i in range(0, len(qrows), step)):
                    q = qflat[qat[some][:, None] + np.arange(n)]
                    norm = np.sqrt(_in_order(q, q))
                    some, q, norm = some[norm != 0], q[norm != 0], norm[norm != 0]
                    if not len(some):
                        continue
                    # products of matrices leave out what can't be among the best; what remains is added in order
                    with np.errstate(all="ignore"):
                        near = q @ v.T / norm[:, None]
                    near[np.isnan(near)] = np.inf
                    floor = np.full(len(some), float(min_cos))
                    if len(rows) > limit:
                        floor = np.maximum(floor, np.partition(near, len(rows) - limit, 1)[:, len(rows) - limit])
                    at, which = np.nonzero(near >= (floor - 1e-9 * max(1.0, reach))[:, None])
                    with np.errstate(all="ignore"):
                        cos = _in_order(q[at], v[which]) / norm[at]
                    # as in Spark, what is no number is greater than all
                    nan = np.isnan(cos)
                    good = nan | (cos >= min_cos)
                    at, which, cos, nan = at[good], which[good], cos[good], nan[good]
                    best = np.lexsort((place[rows[which]], -np.where(nan, 0.0, cos), ~nan, at))
                    at, which, cos = at[best], which[best], cos[best]
                    nth = np.arange(len(at)) - np.searchsorted(at, at)
                    out.append((some[at[nth < limit]], rows[which[nth < limit]], cos[nth < limit]))
        i, j, cos = (np.concatenate([x[k] for x in out]) for k in range(3)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([asked.column("uid").take(pa.array(i)), asked.column("qid").take(pa.array(i)), stored.column("id").take(pa.array(j)), pa.array(cos, from_pandas=False)], names=["uid", "qid", "id", "cos"]).cast(schema)

    return run


def vector_hits(vectors: DataFrame, queries: DataFrame, limit: int, min_cos: float, model: str | None = None) -> DataFrame:
    """The nearest stored vectors (unit length) of each query (``uid, qid, vec``) with ``cos`` and ``rank``; only those of its length.

    Blocks of vectors meet blocks of queries of their ``uid``: a task holds a block of each and returns its best of each query, so all pairs are
    compared but none is shuffled. A query without direction (all zeros) has no answer.
    """
    stored = vectors if model is None else vectors.where(F.col("model") == model)
    stored = stored.select("uid", F.col("fact_id").alias("id"), F.col("vec").alias("v")).where("uid IS NOT NULL")
    asked = queries.select(*Q, "vec").where("uid IS NOT NULL")
    # small ones share groups of some BLOCK rows; a large uid's blocks have a group each
    groups = F.broadcast(stored.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("_g")))
    cuts = F.broadcast(_blocks(stored, BLOCK, "_n").join(_blocks(asked, BLOCK, "_m"), "uid", "full"))

    def cut(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        rows = rows.join(cuts, "uid", "left").crossJoin(groups)
        own, other = (F.coalesce(c, F.lit(1)) for c in (own, other))
        rows = rows.withColumn(f"_{key}", F.pmod(F.xxhash64(key), own).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), other - 1)))
        return rows.withColumn("_u", F.when(F.col("_n").isNull() & F.col("_m").isNull(), F.pmod(F.xxhash64("uid"), F.col("_g"))).otherwise(-1 - F.pmod(F.xxhash64("uid"), F.lit(1 << 40))))

    left = cut(stored, "id", "_n", "_m").select("uid", "id", "v", F.col("_u"), F.col("_id").alias("_i"), F.col("_o").alias("_j"))
    right = cut(asked, "qid", "_m", "_n").select(*Q, "vec", F.col("_u"), F.col("_o").alias("_i"), F.col("_qid").alias("_j"))
    right = right.toDF(*right.columns)  # columns of its own, as both may be of one table
    types = StructType([queries.schema["uid"], queries.schema["qid"], StructField("id", stored.schema["id"].dataType), StructField("cos", DoubleType())])
    keys = ["_u", "_i", "_j"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(limit, min_cos, to_arrow_schema(types)), types)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("cos"), F.asc("id")))).where(F.col("rank") <= limit)


def fuse(lists: list[tuple[str, DataFrame]], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: ``rrf`` of each id, added in the lists' order, and its rank in each list."""
    rows = None
    for name, df in lists:
        part = df.select(*Q, "id", F.lit(name).alias("leg"), "rank")
        rows = part if rows is None else rows.unionByName(part)
    return fuse_legs(rows, [n for n, _ in lists], k)


def fuse_legs(rows: DataFrame, legs: list[str], k: int = 60) -> DataFrame:
    """``fuse`` of lists in one frame, which ``leg`` tells apart."""
    wide = rows.groupBy(*Q, "id").agg(*(F.min(F.when(F.col("leg") == n, F.col("rank"))).alias(n) for n in legs))
    total = F.lit(0.0)
    for n in legs:
        total = total + F.coalesce(F.lit(1.0) / (F.col(n) + k), F.lit(0.0))
    return wide.withColumn("rrf", total)


def recency(day: Column, now: Column) -> Column:
    """1 now, towards 0.6 with age; a bad date counts as now."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd").cast("timestamp"))) / 86400.0
    return F.lit(0.6) + F.lit(0.4) / (F.lit(1.0) + F.greatest(F.lit(0.0), F.coalesce(age, F.lit(0.0))) / 180.0)


def score(rrf: Column, now: Column, k: int = 60) -> Column:
    quality = 0.5 * F.coalesce("importance", F.lit(0.0)) + 0.5 * F.coalesce("persona_attention", F.lit(0.0))
    return F.least(F.lit(1.0), rrf * (k + 1)) * (F.lit(0.75) + 0.25 * quality) * recency(F.col("valid_from"), now)


def recall(facts: DataFrame, queries: DataFrame, cfg: Config = Config(), vectors: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Answers of each query (``uid, qid, text, now`` and, for the vector leg, ``vec``) with ``score, match, place``.

    Pinned facts come first whatever they score; of the rest only scores of ``min_score`` or more do.
    ``exclude(uid, qid, turn_ref)`` are turns just said.
    """
    n = max(8, 4 * cfg.recall_k)
    live = FA.list_facts(facts)
    indexed = facts.select("uid", "id", F.concat_ws(" ", "subject", "predicate", "object").alias("text"), FA.is_live().alias("is_live"))
    legs = [("slot", slot_hits(facts, queries)), ("fts", bm25(indexed, queries, n, F.col("is_live"), one_pass=False))]
    if vectors is not None:
        legs.append(("vec", vector_hits(vectors.join(live.select("uid", F.col("id").alias("fact_id")), ["uid", "fact_id"], "left_semi"), queries, n, cfg.embed_min_cos)))
    found = fuse(legs, cfg.rrf_k)
    if vectors is None:
        found = found.withColumn("vec", F.lit(None).cast("int"))
    pins = live.where("pinned").withColumn("_n", F.row_number().over(Window.partitionBy("uid").orderBy("id"))).where(F.col("_n") <= PINS).select("uid", "id")
    pinned = queries.select(*Q).join(pins, "uid")
    ids = found.join(pinned.withColumn("pin", F.lit(True)), [*Q, "id"], "full")
    # without those that no query shows
    rows = ids.join(facts.where(FA.live(F.lit(False), cfg.min_confidence)), ["uid", "id"])
    said = F.lit(False)
    if exclude is not None:
        rows = rows.join(exclude.select(*Q, "turn_ref", F.lit(True).alias("_said")).distinct(), [*Q, "turn_ref"], "left")
        said = F.coalesce("_said", F.lit(False))
    order = [F.desc_nulls_last("pin"), F.col("slot").asc_nulls_last(), F.col("fts").asc_nulls_last(), F.col("vec").asc_nulls_last(), F.asc("id")]
    rows = dedup_slots(rows.where(FA.live(said, cfg.min_confidence)), Q, order)
    rows = rows.join(queries.select(*Q, "now"), Q)
    is_pin = F.col("pinned")
    rows = rows.withColumn("raw", score(F.coalesce("rrf", F.lit(0.0)), F.col("now"), cfg.rrf_k)).where(is_pin | (F.col("raw") >= cfg.min_score))
    match = F.when(is_pin, "pin").when(F.col("slot").isNotNull(), "slot").when(F.col("fts").isNotNull(), "fts").otherwise("vec")
    rows = rows.withColumns({"score": F.when(is_pin, 1.0).otherwise(F.round("raw", 4)), "match": match})
    final = [F.desc("pinned"), F.desc("score"), F.asc("id")]
    rows = budget(rows, Q, final, T.estimate_tokens(FA.card()), cfg.hot_tokens)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*Q).orderBy(*final))).where(F.col("place") <= cfg.recall_k)
    return rows.drop("raw", "pin", "pos", "_said", "rrf", "slot", "fts", "vec")


def cold_triggered(queries: DataFrame, hot: DataFrame, facts: DataFrame) -> DataFrame:
    """``uid, qid, triggered``: speaks of the past, nothing is hot though facts are live, or shares a token with hot cards."""
    # a uid's hot cards fit a budget: few tokens, in one row
    cards = hot.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list(T.tokenize(FA.card())))).alias("held"), F.lit(True).alias("has_hot"))
    out = queries.join(cards, "uid", "left").withColumn("shares", F.arrays_overlap(F.filter(T.tokenize(F.col("text")), lambda t: F.length(t) >= 2), F.col("held")))
    out = out.join(FA.list_facts(facts).select("uid").distinct().withColumn("has_live", F.lit(True)), "uid", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(*Q, (T.past_mentioned(F.col("text")) | (~yes("has_hot") & yes("has_live")) | yes("shares")).alias("triggered"))


def context(facts: DataFrame, queries: DataFrame, cfg: Config = Config(), vectors: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """A turn's facts: the hot ones, then those recalled on demand that aren't hot; ``source`` tells which."""
    hot = hot_facts(facts, cfg, None if exclude is None else exclude.drop("qid"))
    wanted = cold_triggered(queries, hot, facts).where("triggered").select(*Q)
    cold = recall(facts, queries.join(wanted, Q, "left_semi"), cfg, vectors, exclude)
    one = lambda df, name: df.select(*Q, "id", FA.card().alias("card"), F.lit(name).alias("source"), "place")
    both = one(queries.select(*Q).join(hot, "uid"), "hot").unionByName(one(cold, "cold"))
    both = both.withColumn("_hot", F.max(F.col("source") == "hot").over(Window.partitionBy(*Q, "id"))).where((F.col("source") == "hot") | ~F.col("_hot")).drop("_hot")
    return both.withColumn("place", F.row_number().over(Window.partitionBy(*Q).orderBy(F.desc("source"), "place")))


def outcomes(queries: DataFrame, triggered: DataFrame, found: DataFrame) -> DataFrame:
    """``uid, qid, reason, hits, by_vector`` of each query: ``skipped`` (not triggered), ``no_hit`` or ``ok``; sums of it are the counters."""
    hits = found.groupBy(*Q).agg(F.count("*").alias("hits"), F.count_if(F.col("match") == "vec").alias("by_vector"))
    rows = queries.select(*Q).join(triggered.select(*Q, "triggered"), Q, "left").join(hits, Q, "left")
    rows = rows.withColumns({"hits": F.coalesce("hits", F.lit(0)), "by_vector": F.coalesce("by_vector", F.lit(0))})
    reason = F.when(~F.coalesce("triggered", F.lit(False)), "skipped").when(F.col("hits") == 0, "no_hit").otherwise("ok")
    return rows.select(*Q, reason.alias("reason"), "hits", "by_vector")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """For each share q the value at place floor(n q) of the ordered values, the last at most; null values are left out."""
    w = Window.partitionBy(*keys)
    ranked = rows.where(F.col(value).isNotNull()).select(*keys, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    wanted = ranked.withColumn("share", F.explode(F.array(*(F.lit(float(q)) for q in shares))))
    at = F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.col("share"))) + 1
    return wanted.where(F.col("_r") == at).select(*keys, "share", value)


def context_totals(rows: DataFrame) -> DataFrame:
    """Facts and tokens of each context."""
    return rows.groupBy(*Q).agg(F.count_if(F.col("source") == "hot").alias("hot"), F.count_if(F.col("source") == "cold").alias("cold"), F.sum(T.estimate_tokens(F.col("card"))).alias("used_tokens"))
