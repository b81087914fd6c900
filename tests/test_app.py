import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from recollect.adapters import http
from recollect.adapters.scripted import PairEncoder, ScriptedModel
from recollect.config import Config, Persona
from recollect.memory import Memory
from recollect.operators import facts as FA
from recollect.operators import replay as R
from recollect.schemas import OPS
from recollect.sources import logs, tables
from recollect.streaming import worker


def model(prompt, limit):
    facts = [{"turn_ref": line[1:9], "quote": "猫叫团子", "subject": "他", "predicate": "养的猫叫", "object": "团子", "confidence": 0.9} for line in prompt.split("\n") if "猫叫团子" in line]
    return json.dumps({"facts": facts, "summary": "他有猫", "topics": [{"text": "猫", "kind": "ask"}]}, ensure_ascii=False), "stop"


def test_memory(spark, tmp_path):
    m = Memory(spark, "u1", Config(root=str(tmp_path / "m")), model=model, encoder="mock", now="2024-01-05T10:00:00")
    assert m.get_all() == []
    assert m.remember({"user": "我家猫叫团子", "assistant": "好"}) == ["T-000001", "T-000002"]
    assert m.remember("再见") == ["T-000003"]
    assert m.extract_now()["ops"] == 1
    fact = m.get_all()[0]
    assert (fact["id"], fact["object"], fact["status"]) == ("F-0001", "团子", "active")
    assert m.extract_now()["chunks"] == 0
    assert m.recall("团子")[0]["id"] == "F-0001"
    assert m.update("F-0001", importance=0.75) and m.get("F-0001")["importance"] == 0.75
    assert not m.update("F-9", importance=0.5)
    assert m.pin("F-0001") and m.get("F-0001")["pinned"]
    c = m.context("团子", proactive=True)
    assert c["hot"] == 1 and c["topics"][0]["text"] == "猫" and c["summaries"][0]["text"] == "他有猫"
    assert m.topics() == [] and "团子" in m.render()
    assert m.forget("F-0001") and m.get("F-0001")["status"] == "forgotten"
    assert Memory(spark, "u2", Config(root=str(tmp_path / "m"))).get_all() == []


def test_memory_ids_are_never_given_again(spark, tmp_path):
    answer = lambda o: json.dumps({"facts": [{"turn_ref": "T-00000%d" % o, "quote": "数%d" % o, "predicate": "p%d" % o, "object": "数%d" % o}]}, ensure_ascii=False)
    m = Memory(spark, "u 1/x", Config(root=str(tmp_path / "m")), model=ScriptedModel([answer(1)]), now="2024-01-05T10:00:00")
    m.remember("数1")
    m.extract_now()
    assert m.get_all()[0]["id"] == "F-0001" and m.forget("F-0001", "purge") and m.get("F-0001") is None
    m.model = ScriptedModel([answer(2)])
    m.remember("数2")
    m.extract_now()
    assert [f["id"] for f in m.get_all()] == ["F-0002"] and m.state()["extracted_rounds"] == 2
    assert "F-0002" in (tmp_path / "m/views/u1x/facts.md").read_text()


def test_memory_vectors(spark, tmp_path):
    enc = PairEncoder(32)
    m = Memory(spark, "u1", Config(root=str(tmp_path / "m"), embed_min_cos=0.1, min_score=0.0, render_views=False), model=model, encoder=enc, now="2024-01-05T10:00:00")
    m.remember("我家猫叫团子")
    m.extract_now()
    assert m.reindex() == {"encoded": 1, "dropped": 0, "vectors": 1} and m.reindex()["encoded"] == 0
    assert m.recall("叫团")[0]["id"] == "F-0001" and m.counters["ok"] == 1
    m.encoder = PairEncoder(32)
    m.encoder.repo = "another"
    assert m.vector_stats()["model_mismatch"] and m.reindex()["encoded"] == 1
    m.encoder = lambda texts: None
    assert m.recall("团子")[0]["match"] == "slot"


def test_memory_reset_and_outcomes(spark, tmp_path):
    cfg = Config(root=str(tmp_path / "m"), render_views=False)
    m, other = (Memory(spark, u, cfg, model=model, now="2024-01-05T10:00:00") for u in ("u1", "u2"))
    for x in (m, other):
        x.remember("我家猫叫团子")
        x.extract_now()
    assert m.has_material() and m.has_openable_topic() and m.use_topics() == 1 and not m.has_openable_topic()
    assert m.recall("zzz") == [] and m.last["reason"] == "no_hit"
    assert m.reset("archive") == {"mode": "archive", "leftover": []}
    assert m.get_all() == [] and not m.has_material() and len(other.get_all()) == 1
    assert list((tmp_path / "m/archived").glob("*/ops/uid=u1"))
    assert other.reset()["mode"] == "purge" and other.get_all() == [] and other.state() == {}
    late = Memory(spark, "u3", replace(cfg, recall_ms=1), now="2024-01-05T10:00:00", deadline=True)
    assert late.recall("团子") == [] and late.last["reason"] == "timeout"
    with m.folder.lock("u1"), pytest.raises(tables.Busy), m.folder.lock("u1", wait=0.1):
        pass


def test_extract_users_like_one(spark, tmp_path):
    """All users' turns in one plan give what each user's handle gives."""
    roots = [str(tmp_path / x) for x in "ab"]
    for root, users in zip(roots, (("u1", "u2"), ("u2",))):
        for u in users:
            Memory(spark, u, Config(root=root), now="2024-01-05T10:00:00").remember({"user": "我家猫叫团子", "assistant": "好"})
    folder = tables.Folder(spark, roots[0])
    due = spark.createDataFrame([("u1",), ("u2",), (None,)], "uid string")
    assert worker.extract_users(folder, due, model, "2024-01-05T10:00:00") == {"users": 2, "ops": 6}
    assert worker.extract_users(folder, due, model, "2024-01-05T10:00:00") == {"users": 0, "ops": 0}
    one, got = (Memory(spark, "u2", Config(root=r, render_views=False), model=model, now="2024-01-05T10:00:00") for r in roots[::-1])
    one.extract_now()
    assert got.get_all() == one.get_all() and got.summaries() == one.summaries() and got.topics() == one.topics()


def test_http_adapters():
    seen = []

    def send(url, key, body, timeout):
        seen.append((url, body))
        if url.endswith("embeddings"):
            return {"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}][: len(body["input"])]}
        return {"choices": [{"message": {"content": "{}"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}

    enc = http.HttpEncoder("k", "some", dim=2, send=send)
    assert enc(["a", "b"]) == [[1.0, 0.0], [0.0, 1.0]] and enc([]) == []
    assert enc(["a", "b", "c"]) is None and "3 texts" in enc.error
    used = []
    llm = http.HttpModel("k", send=send, today="2024-01-05", persona=Persona("Mia", "a friend"), on_usage=lambda *x: used.append(x))
    assert llm("[T-000001] 他说：hi", 100) == ("{}", "stop") and used == [(5, 2)]
    system, asked = seen[-1][1]["messages"]
    assert "Mia" in system["content"] and "2024-01-05" in asked["content"] and seen[-1][1]["max_tokens"] == 100
    with pytest.raises(ValueError):
        http.HttpEncoder("k", "unknown")


def test_material_of_a_session():
    assert not FA.recall_material({}) and not FA.recall_material({"_mem": 3, "memory": []})
    assert FA.recall_material({"_mem": {"topics": [1]}}) and FA.recall_material({"memory": {"promises": ["x"]}})
    assert FA.context_rows({"_mem": {"facts": [1]}}, "facts") == [1] and FA.context_rows({"_mem": {"facts": 2}}, "facts") == []


def test_logs(spark):
    text = "# day\n## 09:00\n- T-000001 09:00:01 user a\\nb\n- T-000002 09:00:02 assistant [x] [y] hi\n- T-000003 09:00:03 user torn"
    rows = logs.parse_days(spark.createDataFrame([("u", "2024-01-01", text)], "uid string, day string, text string")).orderBy("seq").collect()
    assert [(r.id, r.hour, r.role, r.tags, r.text) for r in rows] == [("T-000001", "09:00", "user", [], "a\nb"), ("T-000002", "09:00", "assistant", ["x", "y"], "hi")]
    lines = [("u", 1, '{"op":"ADD","id":"F-1","object":"x","importance":0.5}'), ("u", 2, "torn {"), ("u", 3, '{"op":"EDIT","id":"F-1","set":{"object":"y"}}'), ("u", 4, "[1]")]
    ops = logs.parse_ops(spark.createDataFrame(lines, "uid string, seq long, line string"))
    f = R.facts(ops, "2024-01-01").first()
    assert (f.object, f.importance) == ("y", 0.5)


def test_facts_stream(spark, tmp_path):
    names = [x.split()[0] for x in OPS.split(", ")]
    row = lambda **k: tuple(k.get(n) for n in names)
    src, out = str(tmp_path / "ops"), str(tmp_path / "facts")
    add = row(uid="u", seq=1, op="ADD", id="F-1", object="a", ts="2024-01-01")
    end = row(uid="u", seq=2, op="INVALIDATE", id="F-1", ts="2024-01-02")
    for part in ([add], [end]):
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(src)
        q = worker.maintain_facts(worker.ops_stream(spark, src), out, "2024-01-03").trigger(availableNow=True).start()
        q.awaitTermination()
    f = worker.facts_at(spark, out, 9).first()
    assert (f.status, f.valid_to, f.object) == ("superseded", "2024-01-02", "a")
    for part in ([row(uid="u", seq=3, op="FORGET", id="F-1", mode="purge")], [row(uid="v", seq=1, op="ADD", id="F-9", ts="2024-01-01")]):
        spark.createDataFrame(part, OPS).coalesce(1).write.mode("append").parquet(src)
        worker.maintain_facts(worker.ops_stream(spark, src), out, "2024-01-03").trigger(availableNow=True).start().awaitTermination()
    assert [r.id for r in worker.facts_at(spark, out, 9).collect()] == ["F-9"] and worker.facts_at(spark, out, 0).first().status == "active"


def test_trigger_stream(spark, tmp_path):
    src = str(tmp_path / "turns")
    spark.createDataFrame([("a", "user", float(i)) for i in range(5)] + [("b", "user", 1.0), ("a", "assistant", 9.0)], "uid string, role string, ts double").write.parquet(src)
    rows = spark.readStream.schema("uid string, role string, ts double").parquet(src)
    q = worker.triggers(rows, max_turns=5).writeStream.format("memory").queryName("trig").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    # with a timeout in use there is always another batch to come, so the query never counts as idle
    end = time.time() + 60
    while not spark.table("trig").count() and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert [(r.uid, r.reason, r.rounds) for r in spark.table("trig").collect()] == [("a", "turns", 5)]


def test_archive(spark, tmp_path):
    from recollect.operators import turns as TU

    rows = spark.createDataFrame([("u", "2024-01-01", 1), ("u", "2024-03-01", 2)], "uid string, day string, seq long")
    plan = TU.archive_plan(rows, "2024-03-20", 2)
    stay = logs.move_old_months(rows, plan, str(tmp_path / "a"))
    assert [r.seq for r in stay.collect()] == [2]
    old = spark.read.parquet(str(tmp_path / "a")).withColumn("day", F.col("day").cast("string")).select("uid", "day", "seq")
    assert TU.union_days(stay, old).count() == 2
    logs.move_old_months(rows, plan, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_entry_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50
