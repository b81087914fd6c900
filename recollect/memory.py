"""One user's memory: a handle over the tables under a folder, for applications. Batch jobs use the operators."""

from __future__ import annotations

import datetime as dt
import threading
import time
import traceback
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, Persona
from .functions import text as T
from .operators import consolidate as C
from .operators import extract as X
from .operators import facts as FA
from .operators import replay as R
from .operators import retrieve as RE
from .operators import turns as TU
from .operators import vectors as V
from .schemas import FACTS, OPS
from .sources.tables import Folder

_OP_TYPES = dict(x.split(" ", 1) for x in OPS.split(", "))


class Memory:
    """Turns and the operation log are appended to; all else is computed from them. ``now`` fixes the time, for tests.

    ``encoder`` is ``"mock"``, or a function of texts to vectors (with ``dim`` and ``repo``, its name), which fills the
    vector table by ``reindex``. With ``deadline`` a recall that takes longer than ``recall_ms`` gives nothing.
    """

    def __init__(self, spark: SparkSession, uid: str, config: Config = Config(), persona: Persona = Persona(), model=None, encoder=None, now: str | None = None, deadline: bool = False, on_usage=None):
        self.spark, self.uid, self.config, self.persona, self.model, self.encoder, self._now = spark, str(uid), config, persona, model, encoder, now
        self.deadline, self.on_usage, self.folder = deadline, on_usage, Folder(spark, config.root)
        self._held, self._seq = None, None
        self.counters = dict.fromkeys(("search", "timeout", "no_hit", "ok", "vec", "error"), 0)
        self.last, self.errors = {"reason": "", "ms": 0, "vec": 0}, []

    # tables
    def now(self) -> str:
        return self._now or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%S")

    def _read(self, table: str) -> DataFrame:
        return self.folder.read(table, self.uid) if self.uid else self.folder.read(table).where("false")

    def _append(self, table: str, rows: list[dict]) -> None:
        self.folder.append_rows(table, rows)

    def _turns(self) -> DataFrame:
        return self._read("turns")

    def _ops(self) -> DataFrame:
        return self._read("ops")

    def _log(self, *ops: dict) -> None:
        if not ops:
            return
        with self.folder.lock(self.uid):
            last = self._ops().agg(F.max("seq")).first()[0] or 0
            self._append("ops", [{"uid": self.uid, "seq": last + i, "ts": self.now()} | o for i, o in enumerate(ops, 1)])

    def _facts(self) -> DataFrame:
        ops = self._ops()
        seq = ops.agg(F.max("seq")).first()[0]
        if seq != self._seq or self._held is None:
            # one user's facts are few: the fold is kept until the log grows
            rows = R.facts(ops, self.now()[:10]).collect()
            self._held, self._seq = self.spark.createDataFrame([tuple(r) for r in rows], FACTS).coalesce(1), seq
        return FA.with_usage(self._held, self._read("usage"))

    def _used(self, ids: list[str]) -> None:
        if ids:
            self._append("usage", [{"uid": self.uid, "id": i, "ts": self.now()} for i in ids])

    @staticmethod
    def _dicts(df: DataFrame) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]

    # writing
    def remember(self, messages) -> list[str]:
        """Appends a turn ``{user, assistant}``, a text, or a list of messages; the new ids."""
        if not self.config.enabled or not self.uid:
            return []
        if isinstance(messages, str):
            messages = [{"role": "user", "content": messages}]
        elif isinstance(messages, dict):
            said = messages.get("assistant") or []
            said = [said] if isinstance(said, str) else said
            messages = [{"role": "user", "content": messages.get("user") or ""}, *({"role": "assistant", "content": s} for s in said)]
        rows = [(self.uid, i, str(m.get("role") or ""), str(m.get("content") or m.get("text") or "")) for i, m in enumerate(messages) if isinstance(m, dict)]
        day = self.now()[:10]
        turns = TU.normalise(self.spark.createDataFrame(rows, "uid string, pos long, role string, text string")).withColumn("day", F.lit(day))
        stamp = self.now()[11:19]
        with self.folder.lock(self.uid):
            last = self._turns().groupBy("uid").agg(F.max("seq").alias("seq"))
            new = TU.number(turns, last).orderBy("seq").collect()
            self._append("turns", [r.asDict() | {"hour": stamp[:5], "time": stamp, "tags": []} for r in new])
        return [r.id for r in new]

    add = remember

    def update(self, fact_id: str, **fields) -> bool:
        values = FA.validate(fields)
        if not values or self.get(fact_id) is None:
            return False
        self._log({"op": "EDIT", "id": fact_id, "edits": {k: str(v) for k, v in values.items()}})
        return True

    def forget(self, fact_id: str, mode: str | None = None) -> bool:
        if self.get(fact_id) is None:
            return False
        self._log({"op": "FORGET", "id": fact_id, "mode": mode or self.config.forget_mode})
        return True

    delete = forget

    def confirm(self, fact_id: str, accept: bool = True) -> bool:
        if self.get(fact_id) is None:
            return False
        self._log({"op": "CONFIRM", "id": fact_id, "status": "active"} if accept else {"op": "FORGET", "id": fact_id, "mode": "archive"})
        return True

    def pin(self, fact_id: str, pinned: bool = True) -> bool:
        if self.get(fact_id) is None:
            return False
        self._log({"op": "PIN", "id": fact_id, "pinned": pinned})
        return True

    def _note(self, op: str, row: DataFrame, more: dict) -> str:
        found = row.first()
        if found is None:
            return ""
        self._log({"op": op, "created_at": self.now()} | {k: v for k, v in found.asDict().items() if k != "uid"} | more)
        return found.id

    def note_summary(self, text: str, day: str | None = None, turn_ref: str = "") -> str:
        row = self.spark.createDataFrame([(self.uid, day or self.now()[:10], text)], "uid string, day string, text string")
        return self._note("SUMMARY", FA.summary_ops(row), {"turn_ref": turn_ref})

    def note_topic(self, text: str, kind: str = "share", due_day: str = "", day: str | None = None, ref: str = "") -> str:
        row = self.spark.createDataFrame([(self.uid, day or self.now()[:10], text, kind, due_day)], "uid string, day string, text string, kind string, due_day string")
        return self._note("TOPIC", FA.topic_ops(row), {"ref": ref})

    # reading
    def get(self, fact_id: str) -> dict | None:
        """From the operations of this fact alone."""
        one = R.fact(self._ops(), self.uid, fact_id, self.now()[:10])
        found = self._dicts(FA.with_usage(one, self._read("usage").where(F.col("id") == fact_id)))
        return found[0] if found else None

    def get_all(self, include_dead: bool = True) -> list[dict]:
        return self._dicts(FA.list_facts(self._facts(), include_dead=include_dead).orderBy(*FA.list_order()))

    def pending(self) -> list[dict]:
        return self._dicts(FA.pending(self._facts()))

    def summaries(self, limit: int = 20) -> list[dict]:
        return self._dicts(FA.list_summaries(R.summaries(self._ops()), limit).orderBy("rank"))

    def topics(self, limit: int = 8, include_used: bool = False) -> list[dict]:
        used = self._read("topic_usage")
        return self._dicts(FA.list_topics(R.topics(self._ops(), used), limit, include_used).orderBy("rank"))

    def history(self, fact_id: str = "") -> list[dict]:
        return self._dicts(FA.history(self._ops(), fact_id))

    def _query(self, text: str) -> DataFrame:
        """The query, with its vector where there is an encoder that answers."""
        q = self.spark.createDataFrame([(self.uid, 0, text)], "uid string, qid int, text string").withColumn("now", F.lit(self.now()).cast("timestamp"))
        if self.encoder == "mock":
            return q.withColumn("vec", T.mock_embedding(F.col("text")))
        found = self.encoder([text]) if self.encoder else None
        return q.withColumn("vec", F.array(*(F.lit(float(x)) for x in found[0])).cast("array<float>")) if found else q

    def _encoder_name(self) -> str:
        return str(getattr(self.encoder, "repo", "") or getattr(self.encoder, "name", "") or "unknown")

    def _vectors(self, facts: DataFrame) -> DataFrame | None:
        """Stored vectors of the current encoder, of one user the first ``embed_scan_max``."""
        if self.encoder is None:
            return None
        if self.encoder == "mock":
            return V.mock_encode(facts)
        held = self._read("vectors").where((F.col("model") == self._encoder_name()) & (F.col("dim") == self._dim()))
        return held.orderBy("fact_id").limit(self.config.embed_scan_max)

    def _dim(self) -> int:
        return int(getattr(self.encoder, "dim", 0) or self.config.embed_dim)

    def reindex(self) -> dict:
        """Brings the vector table up to the facts: new, changed and other encoders' vectors are made anew, orphans go."""
        if self.encoder is None or self.encoder == "mock":
            return {"encoded": 0, "dropped": 0, "vectors": 0}
        facts, held = self._facts(), self._read("vectors")
        plan = {r.action: r["count"] for r in V.plan(facts, held, self._encoder_name(), self._dim()).groupBy("action").count().collect()}
        if plan:
            rows = V.reindex(facts, held, self.encoder, self._encoder_name(), self._dim()).collect()
            with self.folder.lock(self.uid):
                if rows:
                    self.folder.replace("vectors", self.spark.createDataFrame([tuple(r) for r in rows], held.schema))
        return {"encoded": plan.get("encode", 0), "dropped": plan.get("drop", 0), "vectors": self._read("vectors").count()}

    def vector_stats(self) -> dict:
        found = self._dicts(V.stats(self._facts(), self._read("vectors"), self._encoder_name() if self.encoder else None))
        return found[0] if found else {}

    def _timed(self, work):
        """Rows of ``work()``; nothing if it fails or, with a deadline, takes too long. Counters tell which."""
        began, timer, group = time.monotonic(), None, f"recall-{uuid.uuid4().hex}"
        sc = self.spark.sparkContext
        self.counters["search"] += 1
        late = []
        if self.deadline and self.config.recall_ms > 0:
            sc.addJobTag(group)
            timer = threading.Timer(self.config.recall_ms / 1000, lambda: (late.append(1), sc.cancelJobsWithTag(group)))
            timer.start()
        try:
            rows, reason = work(), ""
        except Exception:  # a recall that fails gives nothing; why is kept
            rows, reason = [], "timeout" if late else "error"
            if not late:
                self.errors = [*self.errors, traceback.format_exc()][-5:]
        finally:
            if timer:
                timer.cancel()
                sc.removeJobTag(group)
        if late:
            rows, reason = [], "timeout"
        reason = reason or ("ok" if rows else "no_hit")
        by_vector = sum(r.get("match") == "vec" for r in rows)
        self.counters[reason] += 1
        self.counters["vec"] += by_vector
        self.last = {"reason": reason, "ms": int((time.monotonic() - began) * 1000), "vec": by_vector}
        return rows

    def recall(self, text: str, k: int | None = None, budget_tokens: int | None = None, track: bool = True) -> list[dict]:
        if not self.config.enabled or not self.uid:
            self.last = {"reason": "disabled", "ms": 0, "vec": 0}
            return []
        cfg = replace(self.config, recall_k=k or self.config.recall_k, hot_tokens=budget_tokens or self.config.hot_tokens)

        def work():
            facts, query = self._facts(), self._query(text)
            vectors = self._vectors(facts) if "vec" in query.columns else None
            return self._dicts(RE.recall(facts, query, cfg, vectors).orderBy("place"))

        found = self._timed(work)
        if track:
            self._used([r["id"] for r in found])
        return found

    search = recall

    def context(self, text: str, recent_refs: tuple[str, ...] = (), proactive: bool = False) -> dict:
        """A turn's facts, story and, when it speaks first, topics."""
        out = {"facts": [], "summaries": [], "topics": [], "hot": 0, "cold": 0, "used_tokens": 0, "enabled": self.config.enabled and bool(self.uid)}
        out |= {"reason": "disabled", "ms": 0, "backend": "none" if self.encoder is None else "mock" if self.encoder == "mock" else self._encoder_name()}
        if not out["enabled"]:
            return out
        facts = self._facts()
        if not recent_refs:
            recent_refs = ()
        exclude = self.spark.createDataFrame([(self.uid, 0, r) for r in recent_refs[-self.config.history_window :]], "uid string, qid int, turn_ref string") if recent_refs else None

        def work():
            query = self._query(text)
            return self._dicts(RE.context(facts, query, self.config, self._vectors(facts) if "vec" in query.columns else None, exclude).orderBy("place"))

        rows = self._timed(work)
        out |= {k: self.last[k] for k in ("reason", "ms")}
        ops = self._ops()
        out["facts"] = rows
        out["summaries"] = self._dicts(RE.hot_summaries(R.summaries(ops), self.config).orderBy("rank"))
        if proactive:
            used = self._read("topic_usage")
            out["topics"] = self._dicts(RE.hot_topics(R.topics(ops, used), self.config).orderBy("rank"))
            last = ops.agg(F.max("seq")).first()[0] or 0
            if out["topics"]:
                self.use_topics([t["id"] for t in out["topics"]], last)
        out["hot"], out["cold"] = (sum(r["source"] == s for r in rows) for s in ("hot", "cold"))
        texts = [r["card"] for r in rows] + [x["text"] for x in out["summaries"] + out["topics"]]
        out["used_tokens"] = sum(int(len(t) / 1.5) + 1 for t in texts)
        self._used([r["id"] for r in rows])
        return out

    def use_topics(self, ids: list[str] | None = None, seq: int | None = None) -> int:
        """Marks topics as used, all open ones if none are named; how many."""
        if ids is None:
            ids = [t["id"] for t in self.topics(1 << 30)]
        if ids:
            seq = seq or self._ops().agg(F.max("seq")).first()[0] or 0
            self._append("topic_usage", [{"uid": self.uid, "id": i, "seq": seq} for i in ids])
        return len(ids)

    def has_material(self) -> bool:
        """A live fact, a summary or a topic."""
        ops = self._ops()
        return self.config.enabled and not (FA.list_facts(self._facts()).limit(1).isEmpty() and ops.where("op IN ('SUMMARY', 'TOPIC')").limit(1).isEmpty())

    def has_openable_topic(self) -> bool:
        return self.config.enabled and bool(self.topics(1))

    def last_error(self) -> str:
        return self.errors[-1] if self.errors else ""

    def state(self) -> dict:
        found = self._dicts(TU.state(self._turns(), self._read("cursor")))
        return found[0] if found else {}

    def stats(self) -> dict:
        facts = self._dicts(FA.stats(self._facts()))
        turns = self._dicts(TU.stats(self._turns()))
        return {"facts": facts[0] if facts else {}, "turns": turns[0] if turns else {}}

    def export(self) -> dict:
        return {"facts": self.get_all(), "pending": self.pending(), "summaries": self.summaries(100), "topics": self.topics(100, True), "ops": self.history()}

    def render(self, kind: str = "facts") -> str:
        """A readable view of ``facts``, ``summaries`` or ``topics``."""
        ops = self._ops()
        rows = FA.render(self._facts()) if kind == "facts" else FA.render_summaries(R.summaries(ops)) if kind == "summaries" else FA.render_topics(R.topics(ops, self._read("topic_usage")))
        found = rows.first()
        return found.view if found else ""

    def write_views(self) -> list[str]:
        """Views as files beside the tables, if the settings want them."""
        if not self.config.render_views:
            return []
        name = self.spark.range(1).select(T.safe_name(F.lit(self.uid))).first()[0]
        paths = [f"views/{name}/{kind}.md" for kind in ("facts", "summaries", "topics")]
        for kind, path in zip(("facts", "summaries", "topics"), paths):
            self.folder.write_text(path, self.render(kind))
        return paths

    # background work
    def extract_now(self) -> dict:
        """Reads new user turns with the model and logs what they hold; the cursor moves past chunks that didn't fail."""
        turns = self._turns()
        state = TU.state(turns, self._read("cursor")).withColumn("done", F.col("extracted_rounds"))
        done = TU.clamp_cursor(state.withColumn("claimed", F.col("done"))).select("uid", F.col("cursor").cast("long").alias("rounds"))
        chunks = TU.chunks(turns, done, self.config.extract_max_calls)
        prompts = X.prompt_lines(TU.lines(turns, chunks))
        answers = X.call_model(prompts, self.model, self.config.extract_max_tokens, self.config.extract_tokens_per_turn)
        answers = self.spark.createDataFrame(answers.orderBy("chunk").collect(), answers.schema)
        failed = answers.where("status = 'failed'").agg(F.min("chunk")).first()[0]
        good = answers if failed is None else answers.where(F.col("chunk") < failed)
        facts = self._facts()
        last = R.last_fact_ids(self._ops())
        rows = X.clean(X.verify(X.candidates(good), turns, self.config.pending_tolerance), self.persona.name)
        ops = X.ops_of(X.resolve(rows, facts, last)).orderBy("seq").collect()
        self._log(*({k: v for k, v in r.asDict().items() if k in _OP_TYPES and k not in ("uid", "seq", "ts")} for r in ops))
        for r in good.where("status = 'ok'").select("day", X.parse_summary(F.col("raw")).alias("s"), X.parse_topics(F.col("raw"), F.col("day")).alias("t")).collect():
            if r.s:
                self.note_summary(r.s, r.day)
            for t in r.t:
                self.note_topic(t.text, t.kind, t.due_day, r.day, t.ref)
        read = good.agg(F.sum("n_user")).first()[0] or 0
        if read:
            before = done.first()
            self._append("cursor", [{"uid": self.uid, "rounds": int((before.rounds if before else 0) + read)}])
        spent = self._dicts(X.model_usage(answers))
        if spent:
            self._append("model_usage", [spent[0] | {"ts": self.now()}])
            if self.on_usage:
                self.on_usage(spent[0]["tin"], spent[0]["tout"])
        self.write_views()
        return {"chunks": answers.count(), "failed": 0 if failed is None else 1, "ops": len(ops), "rounds": int(read)}

    def consolidate(self, dry_run: bool = False) -> dict:
        facts, last = self._facts(), self._ops().groupBy("uid").agg(F.max("seq").alias("seq"))
        ops = C.consolidate(facts, self.now(), last, self.config).collect()
        if ops and not dry_run:
            self._append("ops", [r.asDict() for r in ops])
        return {"merged": sum(r.op == "MERGE" for r in ops), "derogated": sum(r.op == "DEROGATE" for r in ops)}

    def reset(self, mode: str | None = None) -> dict:
        """Ends all that is kept of this user: ``purge`` deletes it, ``archive`` sets it aside; ``leftover`` names tables that couldn't be."""
        mode = (mode or self.config.reset_mode or "purge").lower()
        with self.folder.lock(self.uid):
            left = self.folder.end(self.uid, mode)
        self._held, self._seq = None, None
        return {"mode": mode, "leftover": left}
