"""Embedding services: what is asked, what an answer must hold, and which errors are worth another attempt."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

import numpy as np

#: Seconds before an attempt is given up, attempts after the first, statuses below 500 that may pass.
TIMEOUT, RETRIES, PASSING = 120, 3, (408, 429)


class EmbeddingError(RuntimeError):
    """The service failed: indexing stops and its documents stay in the queue."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


def request(provider: str, base_url: str, model: str, texts: list[str], key: str = "", user: str | None = None) -> tuple[str, dict[str, str], bytes]:
    """Address, headers and body. Two kinds of service: the openai one takes a user name, the other one truncates."""
    base = base_url.rstrip("/")
    if provider == "openai":
        url, body = f"{base}/embeddings", {"model": model, "input": texts} | ({"user": user} if user else {})
    else:
        url, body = f"{base}/api/embed", {"model": model, "input": texts, "truncate": True}
    return url, {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}), json.dumps(body).encode()


def vectors_of(answer, expected: int) -> np.ndarray:
    """The vectors of either kind of answer, in the order of the texts."""
    rows = None
    if isinstance(answer, dict):
        if isinstance(answer.get("embeddings"), list):
            rows = answer["embeddings"]
        elif isinstance(answer.get("data"), list):
            rows = [x.get("embedding") for x in sorted(answer["data"], key=lambda x: x.get("index") or 0)]
    if rows is None or len(rows) != expected:
        raise EmbeddingError(f"unexpected answer: {expected} vectors expected")
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and np.isfinite(x)
    if any(not isinstance(v, list) or not v or len(v) != len(rows[0]) or not all(map(number, v)) for v in rows):
        raise EmbeddingError("unexpected answer: vectors differ in length or are not numbers")
    return np.array(rows, np.float64).reshape(expected, -1)


def post(url: str, headers: dict[str, str], body: bytes, timeout: float = TIMEOUT):
    """The decoded answer. Network trouble, time-outs, broken answers and statuses that may pass are retryable."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as got:  # noqa: S310
            return json.loads(got.read())
    except urllib.error.HTTPError as e:
        raise EmbeddingError(f"status {e.code}", e.code >= 500 or e.code in PASSING) from e
    except (OSError, ValueError) as e:
        raise EmbeddingError(str(e), True) from e


def retried(call: Callable[[], np.ndarray], retries: int = RETRIES, wait: Callable[[float], None] | None = None) -> np.ndarray:
    """Up to `retries` more attempts after retryable errors, 1 s, 2 s, 4 s apart; other errors at once."""
    for k in range(retries + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError, EmbeddingError) as e:
            if k == retries or not getattr(e, "retryable", True):
                raise
            (wait or time.sleep)(2.0**k)
    raise AssertionError


def remote(provider: str, base_url: str, model: str, key: str = "", user: str | None = None, send: Callable[..., object] = post) -> Callable[[list[str]], np.ndarray]:
    """An embedder that asks a service. Check the address with guards.url_allowed before."""

    def embed(texts: list[str]) -> np.ndarray:
        return vectors_of(send(*request(provider, base_url, model, texts, key, user)), len(texts)) if texts else np.zeros((0, 0))

    return embed
