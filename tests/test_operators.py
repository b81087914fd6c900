import functools
import random

import pytest
from pyspark.sql import functions as F

from recollect.config import Config
from recollect.operators import consolidate as C
from recollect.operators import extract as X
from recollect.operators import facts as FA
from recollect.operators import retrieve as RE
from recollect.operators import turns as TU
from recollect.schemas import FACTS

DEFAULT = {"uid": "u", "subject": "他", "quote": "", "turn_ref": "", "kind": "fact", "valid_from": "2024-01-01", "confidence": 0.9, "importance": 0.5, "persona_attention": 0.5, "pinned": False, "status": "active", "source": "x", "first_seq": 1}


def facts(spark, *rows):
    names = [x.split()[0] for x in FACTS.split(", ")]
    return spark.createDataFrame([tuple((DEFAULT | r).get(n) for n in names) for r in rows], FACTS)


def test_config():
    c = Config.from_env(env={"RECOLLECT_HOT_TOKENS": "9", "RECOLLECT_ENABLED": "off", "RECOLLECT_RRF_K": "many", "RECOLLECT_DIR": "/x"})
    assert (c.hot_tokens, c.enabled, c.rrf_k, c.root) == (9, False, 60, "/x")
    assert Config(decay_floor=3, retain_months=-1).decay_floor == 0.05 and Config(retain_months=-1).retain_months == 0


def test_validate():
    assert FA.validate({"object": " x ", "importance": 1, "due": None, "other": 3}) == {"object": "x", "importance": 1.0, "due": ""}
    for bad in ({"object": ""}, {"object": "x" * 201}, {"importance": True}, {"importance": 2}, {"due": "soon"}, {"kind": "plan"}):
        with pytest.raises(FA.EditError):
            FA.validate(bad)


def test_resolve(spark):
    held = facts(spark, {"id": "F-0001", "predicate": "p", "object": "a"})
    rows = [("u", 1, "他", "p", "a"), ("u", 2, "他", "p", "b"), ("u", 3, "他", "p", "b"), ("u", 4, "他", "p", "a"), ("u", 5, "他", "q", "z")]
    cand = spark.createDataFrame(rows, "uid string, seq long, subject string, predicate string, object string")
    last = spark.createDataFrame([("u", 1)], "uid string, seq long")
    got = {r.seq: (r.action, r.id, r.replaces) for r in X.resolve(cand, held, last).collect()}
    assert got == {1: ("NOOP", None, None), 2: ("SUPERSEDE", "F-0002", "F-0001"), 3: ("NOOP", None, None), 4: ("SUPERSEDE", "F-0003", "F-0002"), 5: ("ADD", "F-0004", None)}


def test_verify(spark):
    turns = spark.createDataFrame([("u", "T-1", "user", "我家猫叫团子，三岁了", "2024-01-01"), ("u", "T-2", "assistant", "我答应你去看展", "2024-01-01")], "uid string, id string, role string, text string, day string")
    rows = [("u", 1, "T-1", "猫叫团子 三岁", "fact", "他"), ("u", 2, "T-1", "我家猫叫猫", "fact", "他"), ("u", 3, "T-9", "x", "fact", "他"), ("u", 4, "T-2", "去看展", "fact", "他"), ("u", 5, "T-2", "去看展", "promise", "他"), ("u", 6, "T-1", "", "fact", "他")]
    cand = spark.createDataFrame(rows, "uid string, seq long, turn_ref string, quote string, kind string, subject string")
    got = {r.seq: (r.verdict, r.score) for r in X.verify(cand, turns).collect()}
    assert got == {1: ("active", 1.0), 2: ("pending", 0.75), 3: ("drop", 0.0), 4: ("drop", 0.0), 5: ("active", 1.0), 6: ("drop", 0.0)}


def test_parsing(spark):
    raws = ['```json\n{"facts":[{"object":"a"},],}\n```', '[{"object":"b"}]', "{not json", "", None]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", X.parse_facts(F.col("raw"))["object"].alias("o"), X.parse_summary(F.col("raw")).alias("s")).orderBy("i").collect()
    assert [r.o for r in rows] == [["a"], ["b"], [], [], []]
    assert all(r.s == "" for r in rows)


def test_hot_facts_tiers_and_budget(spark):
    f = facts(
        spark, {"id": "F-1", "predicate": "a", "object": "x", "importance": 0.9}, {"id": "F-2", "predicate": "b", "object": "y", "pinned": True, "confidence": 0.1}, {"id": "F-3", "predicate": "c", "object": "z", "kind": "promise", "due": "2024-03-01"},
        {"id": "F-4", "predicate": "a", "object": "newer", "valid_from": "2024-02-01", "importance": 0.1}, {"id": "F-5", "predicate": "d", "object": "w", "confidence": 0.1}, {"id": "F-6", "predicate": "e", "object": "gone", "status": "forgotten"},
    )
    assert [r.id for r in RE.hot_facts(f).orderBy("place").collect()] == ["F-2", "F-3", "F-4"]
    assert [r.id for r in RE.hot_facts(f, Config(hot_tokens=1)).collect()] == ["F-2"]
    said = spark.createDataFrame([("u", "T-1")], "uid string, turn_ref string")
    quoted = facts(spark, {"id": "F-1", "predicate": "a", "turn_ref": "T-1"}, {"id": "F-2", "predicate": "b", "turn_ref": "T-1", "pinned": True})
    assert [r.id for r in RE.hot_facts(quoted, exclude=said).collect()] == ["F-2"]


def test_recall_by_hand(spark):
    f = facts(spark, {"id": "F-1", "predicate": "养的猫叫", "object": "团子", "first_seq": 1}, {"id": "F-2", "predicate": "住在", "object": "北京", "first_seq": 2}, {"id": "F-3", "predicate": "喜欢", "object": "咖啡", "pinned": True, "first_seq": 3})
    q = spark.createDataFrame([("u", 1, "团子"), ("u", 2, "完全无关")], "uid string, qid int, text string").withColumn("now", F.lit("2024-01-02").cast("timestamp"))
    got = {(r.qid, r.id): (r.match, r.place, r.score) for r in RE.recall(f, q).collect()}
    assert got[(1, "F-3")][:2] == ("pin", 1) and got[(1, "F-1")][:2] == ("slot", 2) and got[(2, "F-3")][:2] == ("pin", 1)
    assert len(got) == 3
    wanted = min(1.0, 2 / 61 * 61) * (0.75 + 0.25 * 0.5) * (0.6 + 0.4 / (1 + 1 / 180))
    assert abs(got[(1, "F-1")][2] - wanted) < 1e-3


def test_rrf(spark):
    lists = [("slot", "abc"), ("fts", "bcd"), ("vec", "c")]
    legs = [(n, spark.createDataFrame([("u", 1, x, i + 1) for i, x in enumerate(ids)], "uid string, qid int, id string, rank int")) for n, ids in lists]
    got = {r.id: r.rrf for r in RE.fuse(legs).collect()}
    assert got == {"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 63 + 1 / 62 + 1 / 61, "d": 1 / 63}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_match_brute_force(spark, monkeypatch):
    """Over blocks, with ties, other lengths, missing numbers, a query of zeros (which divided by zero before); no pairs are joined."""
    monkeypatch.setattr(RE, "BLOCK", 7)
    r = random.Random(5)
    some = lambda n: [round(r.uniform(-1, 1), 1) for _ in range(n)]
    rows = [(r.choice("abc"), f"F-{i:03d}", some(r.choice((3, 3, 4)))) for i in range(90)]
    rows += [("a", f"G-{i}", [0.5, 0.5, 0.5]) for i in range(9)] + [("a", "H-1", [0.5, None, 0.5]), ("a", "H-2", None), (None, "H-3", [1.0, 0.0, 0.0])]
    asked = [(r.choice("abcd"), i, some(r.choice((3, 4)))) for i in range(40)] + [("a", 90, [0.0, 0.0, 0.0]), ("a", 91, [1.0, 1.0, 1.0]), ("a", 92, None)]
    v = spark.createDataFrame(rows, "uid string, fact_id string, vec array<double>")
    q = spark.createDataFrame(asked, "uid string, qid int, vec array<double>")
    dot = lambda a, b: functools.reduce(lambda t, i: t + a[i] * b[i], range(len(a)), 0.0)  # noqa: E731  # sum() compensates
    wanted = set()
    for uid, qid, x in asked:
        if x and any(x):
            norm, near = dot(x, x) ** 0.5, []
            for u, i, y in rows:
                if u == uid and y and None not in y and len(y) == len(x):
                    near.append((-dot(y, x) / norm, i))
            wanted |= {(uid, qid, i, n + 1) for n, (cos, i) in enumerate(sorted(c for c in near if -c[0] >= 0.1)[:4])}
    got = RE.vector_hits(v, q, 4, 0.1)
    assert "FlatMapCoGroupsInArrow" in plan_of(got)
    assert {(x.uid, x.qid, x.id, x.rank) for x in got.collect()} == wanted


def test_fused_query_computes_its_list_once(spark):
    from recollect.plans.queries import a4_rrf

    got = a4_rrf(spark, "/root/testdata/sf0.001")
    assert plan_of(got).count("FlatMapCoGroupsInArrow ") <= 2 and got.count() > 0  # once in the plan, once more where the first plan is shown
    assert got.where("rrf > 0").count() == got.count()


def test_only_tokens_asked_for_leave_a_fact(spark, monkeypatch):
    """No table of all tokens is shuffled, and a large uid's facts are spread with the same answers."""
    f = facts(spark, *({"uid": u, "id": f"F-{i}", "predicate": f"p{i % 3}", "object": f"k{i % 7}", "pinned": i == 5, "first_seq": i} for u in "ab" for i in range(40)))
    q = spark.createDataFrame([("a", 1, "k1 k2"), ("b", 1, "k3"), ("b", 2, "zz"), ("c", 1, "k1")], "uid string, qid int, text string").withColumn("now", F.lit("2024-01-02").cast("timestamp"))
    plan = plan_of(RE.bm25(f.select("uid", "id", F.col("object").alias("text")), q, 3, one_pass=False))
    assert "array_contains(wanted" in plan
    ask = lambda: [r.asDict() for r in RE.recall(f, q).orderBy("uid", "qid", "place").collect()]
    whole = ask()
    monkeypatch.setattr(RE, "SPREAD", 6)
    assert ask() == whole and {(r["uid"], r["qid"]) for r in whole} == {("a", 1), ("b", 1), ("b", 2)}


def test_postings_are_counted_within_rows(spark, monkeypatch):
    """No token is shuffled unless an id occurs twice; over several chunks the counts are those of a row's pairs."""
    monkeypatch.setattr(RE, "CHARS", 5)
    texts = ["Ábab ab", "", None, "x", "-- 团子团子", "_1 1_", "𠀀𠀀𠀀", "b"]
    rows = spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "uid string, id int, text string")
    wanted = {(i, t, n, k) for i, n, pairs in [(0, 5, {"ab": 2, "ba": 2, "bá": 0}), (3, 1, {"x": 1}), (4, 3, {"团子": 2, "子团": 1}), (5, 3, {"_1": 1, "11": 1, "1_": 1}), (6, 2, {"𠀀𠀀": 2}), (7, 1, {"b": 1})] for t, k in pairs.items() if k}
    wanted = {x for x in wanted if x[0]} | {(0, "ab", 5, 3), (0, "ba", 5, 2)}
    got = RE.postings(rows)
    assert "Aggregate" not in plan_of(got)
    assert {(x.id, x.token, x.length, x.tf) for x in got.collect()} == wanted
    twice = RE.postings(rows.unionByName(rows))
    assert {(x.id, x.token, x.length, x.tf) for x in twice.collect()} == {(i, t, n, 2 * k) for i, t, n, k in wanted}


def leaders(rows, floor):
    """Groups of like values in order, item by item."""
    cut = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))} if s else set()
    out = {}
    for i, (a, x) in enumerate(rows):
        if a in out:
            continue
        out[a] = a
        for b, y in rows[i + 1 :]:
            p, q = cut(x), cut(y)
            n = len(p & q)
            like = x == y if not p or not q else n / min(len(p), len(q)) >= floor and n / len(p | q) >= 0.6 * floor
            if b not in out and like:
                out[b] = a
    return {b: a for b, a in out.items() if list(out.values()).count(a) > 1}


def test_duplicates_match_brute_force(spark):
    r = random.Random(3)
    rows = [(f"F-{i:03d}", "".join(r.choice("ab") for _ in range(r.randint(0, 5)))) for i in range(60)]
    f = facts(spark, *({"id": i, "predicate": "p", "object": o} for i, o in rows))
    assert {x.id: x.leader for x in C.duplicates(f, 0.8).collect()} == leaders(rows, 0.8)


def test_merge_keeps_most_content(spark):
    f = facts(spark, {"id": "F-1", "predicate": "p", "object": "团子。"}, {"id": "F-2", "predicate": "p", "object": "团子"})
    assert [(x.id, x.merged_into) for x in C.merge_ops(f).collect()] == [("F-1", "F-2")]


def test_decay(spark):
    f = facts(spark, {"id": "F-1", "predicate": "p", "valid_from": "2023-01-01"}, {"id": "F-2", "predicate": "q", "valid_from": "2023-01-01", "pinned": True}, {"id": "F-3", "predicate": "r", "valid_from": "2024-01-30"}, {"id": "F-4", "predicate": "s", "valid_from": "bad", "importance": 0.05})
    got = C.decay_ops(f.withColumn("last_used_at", F.lit(None).cast("string")), "2024-02-01").collect()
    assert [(x.id, x.importance) for x in got] == [("F-1", 0.35)]


def test_turns_and_chunks(spark):
    said = [("user", "a"), ("user", "b"), ("system", "c"), ("assistant", " "), ("user", "d"), ("assistant", "e" * 300)]
    m = spark.createDataFrame([("u", i, r, t) for i, (r, t) in enumerate(said)], "uid string, pos long, role string, text string")
    turns = TU.normalise(m).orderBy("turn_no").collect()
    assert [(t.user, t.assistant) for t in turns] == [("a\nb", ["c"]), ("d", ["e" * 300])]
    rows = TU.number(TU.normalise(m).withColumn("day", F.lit("2024-01-01")))
    assert [r.id for r in rows.orderBy("seq").collect()] == ["T-000001", "T-000002", "T-000003", "T-000004"]
    lines = TU.lines(rows, TU.chunks(rows, size=1)).orderBy("seq").collect()
    assert [(r.chunk, len(r.text)) for r in lines] == [(0, 3), (0, 1), (1, 1), (1, 160)]


def test_triggers(spark):
    rows = spark.createDataFrame([("a", 5, 5, 0.0), ("b", 5, 1, 0.0), ("c", 300, 1, 9000.0), ("d", 3, 1, 9000.0)], "uid string, user_rounds long, done long, last_ts double")
    assert {r.uid: r.reason for r in TU.should_run(rows, 9500.0).collect()} == {"a": "", "b": "idle", "c": "turns", "d": ""}
