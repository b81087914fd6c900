"""Settings, passed to operators explicitly."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass(frozen=True)
class Config:
    """Budgets and thresholds. ``retain_months`` 0 keeps turns for ever."""

    enabled: bool = True
    root: str = "memory"
    reset_mode: str = "purge"
    forget_mode: str = "archive"
    retain_months: int = 24
    render_views: bool = True
    hot_tokens: int = 300
    hot_fetch_max: int = 400
    story_k: int = 3
    story_tokens: int = 160
    topic_k: int = 2
    topic_tokens: int = 80
    recall_k: int = 4
    recall_ms: int = 50
    min_score: float = 0.35
    min_confidence: float = 0.5
    pending_tolerance: float = 0.6
    rrf_k: int = 60
    embed_dim: int = 512
    embed_min_cos: float = 0.48
    embed_batch: int = 32
    embed_scan_max: int = 2000
    idle_min: int = 30
    max_turns: int = 200
    extract_max_calls: int = 8
    extract_model: str = ""
    extract_tokens_per_turn: int = 200
    extract_max_tokens: int = 8000
    consolidate_days: int = 90
    decay_floor: float = 0.05
    merge_similarity: float = 0.8
    commitment_slots: int = 3
    history_window: int = 24
    idle_split_sec: int = 600

    def __post_init__(self):
        fix = lambda k, v: object.__setattr__(self, k, v)
        fix("root", str(Path(self.root).expanduser()))
        fix("retain_months", max(0, self.retain_months))
        fix("embed_dim", max(1, self.embed_dim))
        fix("idle_split_sec", max(0, self.idle_split_sec))
        if not 0 <= self.decay_floor <= 1:
            fix("decay_floor", 0.05)

    @classmethod
    def from_env(cls, prefix: str = "RECOLLECT_", env: dict[str, str] | None = None) -> Config:
        """Fields from ``{prefix}{FIELD}``; blank values are unset, and what can't be read leaves the default."""
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + ("DIR" if f.name == "root" else f.name.upper()), "").strip()
            if not raw:
                continue
            kind = type(f.default)
            if kind is bool:
                if raw.lower() in _TRUE | _FALSE:
                    found[f.name] = raw.lower() in _TRUE
            elif kind is str:
                found[f.name] = raw
            else:
                try:
                    found[f.name] = kind(raw)
                except ValueError:
                    pass
        return cls(**found)


@dataclass(frozen=True)
class Persona:
    """Who the assistant is; facts about it get ``name`` as their subject."""

    name: str = "她"
    description: str = ""
    attention_hint: str = ""
