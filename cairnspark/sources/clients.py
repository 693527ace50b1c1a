"""Clients of model servers over HTTP. They are plain values that travel to
executors; a connection lives for one request."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any
from urllib import error, request


def post(url: str, payload: dict[str, Any], timeout: float, key: str | None = None) -> dict[str, Any]:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    with request.urlopen(request.Request(url, json.dumps(payload).encode(), headers, method="POST"), timeout=timeout) as reply:
        return json.loads(reply.read().decode())


@dataclass(frozen=True)
class HttpEmbedder:
    """Vectors of texts: one call for all, and where that gives none a call
    for each. Usable as the embedder of ``documents.embedded``."""

    url: str
    model: str
    timeout: float = 420.0

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        base = self.url.rstrip("/")
        try:
            found = post(f"{base}/api/embed", {"model": self.model, "input": texts}, self.timeout).get("embeddings") or []
        except error.HTTPError:
            found = []
        if not found:
            found = [post(f"{base}/api/embeddings", {"model": self.model, "prompt": t}, self.timeout).get("embedding") or [] for t in texts]
        return [[float(x) for x in v] for v in found]


@dataclass(frozen=True)
class HttpChat:
    """One chat call: the text of the reply. ``services.chat_json`` checks the
    prompt's size before the call and reads the object."""

    url: str
    model: str
    timeout: float = 120.0
    temperature: float = 0.0
    num_predict: int = 2048
    num_ctx: int = 16384
    key: str | None = None

    def __call__(self, system: str, user: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": user}]
        options = {"temperature": self.temperature, "num_predict": self.num_predict, "num_ctx": self.num_ctx}
        reply = post(self.url, {"model": self.model, "messages": messages, "stream": False, "format": "json", "options": options}, self.timeout, self.key)
        return str((reply.get("message") or {}).get("content") or "")
