"""Fixed schemas of the tables."""

from __future__ import annotations

TURNS = "uid string, seq long, id string, day string, hour string, time string, role string, tags array<string>, text string"
#: One wide row for all kinds of operation; ``edits`` has the presence of keys, which columns couldn't tell from nulls.
OPS = (
    "uid string, seq long, op string, id string, ts string, subject string, predicate string, object string, quote string, turn_ref string, "
    "kind string, valid_from string, valid_to string, confidence double, importance double, persona_attention double, pinned boolean, status string, "
    "due string, source string, replaces string, edits map<string,string>, mode string, merged_into string, reason string, day string, created_at string, "
    "text string, due_day string, ref string"
)
FACT_FIELDS = (
    ("subject", "string"), ("predicate", "string"), ("object", "string"), ("quote", "string"), ("turn_ref", "string"), ("kind", "string"),
    ("valid_from", "string"), ("valid_to", "string"), ("confidence", "double"), ("importance", "double"), ("persona_attention", "double"),
    ("pinned", "boolean"), ("status", "string"), ("due", "string"), ("source", "string"),
)
FACTS = "uid string, id string, " + ", ".join(f"{n} {t}" for n, t in FACT_FIELDS) + ", first_seq long"
SUMMARIES = "uid string, id string, day string, created_at string, text string, turn_ref string"
TOPICS = "uid string, id string, day string, created_at string, kind string, text string, due_day string, ref string, used boolean"
VECTORS = "uid string, fact_id string, dim int, vec array<float>, text_hash string, model string"
USAGE = "uid string, id string, ts string"
STATUSES = ("active", "pending", "superseded", "forgotten", "merged")
KINDS = ("fact", "commitment", "promise")
TOPIC_KINDS = ("followup", "share", "ask")
