import random

from recollect.operators import replay as R
from recollect.schemas import OPS

NAMES = [x.split()[0] for x in OPS.split(", ")]
KINDS = ["ADD", "SUPERSEDE", "EDIT", "INVALIDATE", "PIN", "CONFIRM", "FORGET", "MERGE", "DEROGATE", "odd"]


def log(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], OPS)


def random_ops(n, seed):
    r = random.Random(seed)
    return [
        {
            "uid": r.choice("ab"), "seq": i, "op": r.choice(KINDS), "id": r.choice(["f1", "f2", "f3", "f4", None]), "ts": f"2024-01-{i % 28 + 1:02d}T00:00:00", "object": f"o{i}", "importance": r.choice([None, 0.25, 0.5]),
            "pinned": r.random() < 0.5, "status": r.choice([None, "active", "pending"]), "replaces": r.choice([None, "f1", "f2"]), "edits": r.choice([None, {"object": f"e{i}"}, {"due": None, "importance": "0.125"}]), "mode": r.choice([None, "archive", "purge"]),
        }
        for i in range(n)
    ]


def sequential(rows):
    """The log, one operation after the other."""
    facts = {}
    for o in sorted(rows, key=lambda o: o["seq"]):
        if not o["id"] or o["op"] == "odd":
            continue
        key, day = (o["uid"], o["id"]), o["ts"][:10]
        if o["op"] == "SUPERSEDE" and o["replaces"] and (t := facts.get((o["uid"], o["replaces"]))):
            t.update(status="superseded", valid_to=day)
        if o["op"] in ("ADD", "SUPERSEDE"):
            facts[key] = {"object": o["object"], "importance": 0.5 if o["importance"] is None else o["importance"], "pinned": o["pinned"], "status": o["status"] or "active", "valid_to": None, "due": None}
            continue
        if not (f := facts.get(key)):
            continue
        if o["op"] == "EDIT" and o["edits"] is not None:
            f.update({k: float(v) if k == "importance" else v for k, v in o["edits"].items()})
        elif o["op"] == "INVALIDATE":
            f.update(status="superseded", valid_to=day)
        elif o["op"] == "PIN":
            f["pinned"] = o["pinned"]
        elif o["op"] == "CONFIRM":
            f["status"] = o["status"] or "active"
            if f["status"] == "active":
                f["valid_to"] = None
        elif o["op"] == "FORGET":
            if o["mode"] == "purge":
                del facts[key]
            else:
                f.update(status="forgotten", valid_to=day)
        elif o["op"] == "MERGE" and f["status"] == "active":
            f.update(status="merged", valid_to=day)
        elif o["op"] == "DEROGATE" and o["importance"] is not None:
            f["importance"] = o["importance"]
    return facts


def as_dict(df):
    return {(r.uid, r.id): {k: r[k] for k in ("object", "importance", "pinned", "status", "valid_to", "due")} for r in df.collect()}


def test_fold_is_sequential(spark):
    rows = random_ops(600, 1)
    assert as_dict(R.facts(log(spark, rows), "2024-02-01")) == sequential(rows)


def test_incremental_is_full(spark):
    rows = random_ops(300, 2)
    first = R.facts(log(spark, rows[:150]), "2024-02-01")
    both = R.facts(log(spark, rows[150:]), "2024-02-01", first)
    assert as_dict(both) == sequential(rows)


def test_empty_log_and_defaults(spark):
    assert R.facts(log(spark, []), "2024-02-01").count() == 0
    f = R.facts(log(spark, [{"uid": "a", "seq": 1, "op": "ADD", "id": "x"}]), "2024-02-01").first()
    assert (f.kind, f.status, f.valid_from, f.pinned, f.object) == ("fact", "active", "2024-02-01", False, "")
    assert R.bad_ops(log(spark, [{"uid": "a", "seq": 1, "op": "WHAT", "id": "x"}, {"uid": "a", "seq": 2, "op": "ADD"}])).count() == 2


def test_topic_opens_again(spark):
    rows = log(spark, [{"uid": "a", "seq": 1, "op": "TOPIC", "id": "t", "day": "2024-01-01", "text": "x", "kind": "ask"}, {"uid": "a", "seq": 3, "op": "TOPIC", "id": "u", "day": "2024-01-01", "text": "y", "kind": "ask"}])
    used = spark.createDataFrame([("a", "t", 2), ("a", "u", 2)], "uid string, id string, seq long")
    assert {r.id: r.used for r in R.topics(rows, used).collect()} == {"t": True, "u": False}
