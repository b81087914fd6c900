"""Stand-ins for tests: an encoder by character pairs, a model that answers from a script."""

from __future__ import annotations

import zlib


class PairEncoder:
    """Counts of character pairs by CRC, at unit length: the same vectors as ``functions.text.mock_embedding``."""

    repo = "pairs-v1"

    def __init__(self, dim: int = 64):
        self.dim = max(1, int(dim))

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [self._one("".join(str(t or "").split())) for t in texts]

    def _one(self, s: str) -> list[float]:
        v = [0.0] * self.dim
        for g in [s[i : i + 2] for i in range(len(s) - 1)] or [x for x in [s] if x]:
            v[zlib.crc32(g.encode()) % self.dim] += 1
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v


class ScriptedModel:
    """Gives its answers one after the other, then ``default``. ``asked`` keeps the prompts of this process."""

    def __init__(self, answers: list[str] | None = None, default: str = "", finish: str = "stop"):
        self.answers, self.default, self.finish, self.asked = list(answers or []), default, finish, []

    def __call__(self, prompt: str, max_tokens: int) -> tuple[str, str]:
        self.asked.append(prompt)
        return self.answers.pop(0) if self.answers else self.default, self.finish
