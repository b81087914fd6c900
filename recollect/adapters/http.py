"""Encoders and models behind an HTTP endpoint of the widespread chat-completions and embeddings form. Objects travel to the workers, which make the calls."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from ..config import Persona
from ..operators.extract import messages

#: Lengths of well-known encoders' vectors.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}


def post(url: str, key: str, body: dict, timeout: float) -> dict:
    head = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
    with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as r:
        return json.loads(r.read())


class HttpEncoder:
    """``texts -> vectors``, or None if the call fails or gives vectors of another number or length; then the vector leg rests. ``error`` tells why."""

    def __init__(self, key: str, model: str = "text-embedding-3-small", url: str = "https://api.openai.com/v1", dim: int = 0, timeout: float = 30, send: Callable = post):
        self.key, self.model, self.url, self.timeout, self.send, self.error = key, model, url.rstrip("/"), timeout, send, ""
        self.dim, self.repo = int(dim or DIMENSIONS.get(model, 0)), f"http/{model}"
        if self.dim < 1:
            raise ValueError(f"the length of {model!r}'s vectors isn't known; give dim")

    def __call__(self, texts: list[str]) -> list[list[float]] | None:
        if not texts:
            return []
        try:
            data = self.send(f"{self.url}/embeddings", self.key, {"model": self.model, "input": [str(t or "") for t in texts]}, self.timeout)["data"]
            found = [[float(x) for x in row["embedding"]] for row in sorted(data, key=lambda row: row.get("index", 0))]
        except Exception as e:  # whatever fails here, text search still works
            self.error = f"{type(e).__name__}: {e}"
            return None
        if len(found) != len(texts) or any(len(v) != self.dim for v in found):
            self.error = f"{len(found)} vectors of {sorted({len(v) for v in found})} for {len(texts)} texts of {self.dim}"
            return None
        return found


class HttpModel:
    """``(lines, max_tokens) -> (text, finish_reason)``; errors are raised, so that the cursor stays."""

    def __init__(self, key: str, model: str = "gpt-4o-mini", url: str = "https://api.openai.com/v1", persona: Persona = Persona(), today: str = "", temperature: float | None = 0.0, timeout: float = 60, send: Callable = post, on_usage: Callable | None = None):
        self.key, self.model, self.url, self.persona, self.today = key, model, url.rstrip("/"), persona, today
        self.temperature, self.timeout, self.send, self.on_usage = temperature, timeout, send, on_usage

    def __call__(self, prompt: str, max_tokens: int) -> tuple[str, str]:
        body = {"model": self.model, "messages": messages(prompt, self.today, self.persona)}
        if max_tokens > 0:
            body["max_tokens"] = int(max_tokens)
        if self.temperature is not None:
            body["temperature"] = self.temperature
        data = self.send(f"{self.url}/chat/completions", self.key, body, self.timeout)
        choice = (data.get("choices") or [{}])[0]
        if self.on_usage:
            used = data.get("usage") or {}
            self.on_usage(int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0))
        return str((choice.get("message") or {}).get("content") or ""), str(choice.get("finish_reason") or "")
