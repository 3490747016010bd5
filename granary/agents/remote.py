"""A model behind a chat-completions interface over HTTP: chat, continued answers, filling in, and samples with log probabilities.

Only the standard library is used. A client is made once a task; a failed call raises, and the callers in client.py retry once
and keep the error in a column.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass
class RemoteModel:
    """url: the interface's root, without the endpoint; header: what goes before an answer that a prefix begins."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.0
    max_tokens: int = 4096
    stop: tuple[str, ...] = ()
    timeout: float = 120.0
    header: str = "\nassistant: "
    extra: dict = field(default_factory=dict)

    def _post(self, endpoint: str, body: dict) -> dict:
        settings = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens} | ({"stop": list(self.stop)} if self.stop else {}) | self.extra
        request = urllib.request.Request(f"{self.url.rstrip('/')}/{endpoint}", json.dumps(settings | body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        with urllib.request.urlopen(request, timeout=self.timeout) as response:
            return json.load(response)

    def _prompt(self, history: list[dict], prefix: str) -> str:
        return "\n".join(f"{m['role']}: {m['content']}" for m in history) + self.header + prefix

    def chat(self, member: str, history: list[dict], row: dict) -> str:
        return self._post("chat/completions", {"messages": history})["choices"][0]["message"]["content"] or ""

    def continued(self, history: list[dict], prefix: str) -> str:
        """The answer that begins with prefix, which is part of it."""
        return prefix + self._post("completions", {"prompt": self._prompt(history, prefix)})["choices"][0]["text"]

    def filled(self, before: str, after: str) -> str:
        """What stands between two texts."""
        return self._post("completions", {"prompt": before, "suffix": after})["choices"][0]["text"]

    def samples(self, row: dict, n: int) -> list[tuple[str, list[float]]]:
        """n answers to row["history"], each after row["prefix"] if there is one, with the log probabilities of their tokens."""
        prefix = row.get("prefix") or ""
        body = {"prompt": self._prompt(row["history"], prefix), "n": n, "logprobs": 1, "temperature": self.temperature or 1.0}
        choices = self._post("completions", body)["choices"]
        return [(prefix + c["text"], [p for p in (c.get("logprobs") or {}).get("token_logprobs") or [] if p is not None]) for c in choices]


def remote(**settings) -> Callable[[], RemoteModel]:
    """A factory for the functions of client.py; the key is read from what is given, never from the code."""
    return lambda: RemoteModel(**settings)
