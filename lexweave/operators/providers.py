"""Completion clients of providers with a public HTTP interface, as factories for ``completion.client``."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from email.utils import parsedate_to_datetime

from lexweave.functions.formats import DEFAULT_PROVIDER, PRICES
from lexweave.operators.completion import Answer

# Where keys are, addresses, longest answer in tokens.
KEYS = {"cursor": "CURSOR_API_KEY", "openai": "OPENAI_API_KEY", "anthropic": "ANTHROPIC_API_KEY", "google": "GOOGLE_API_KEY"}
URLS = {
    "openai": "https://api.openai.com/v1/chat/completions",
    "anthropic": "https://api.anthropic.com/v1/messages",
    "google": "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent",
}
MOST_TOKENS = 8192

#: From an address, headers and a body to the answer's JSON.
Post = Callable[[str, dict[str, str], dict, float], dict]


def catalogue() -> list[tuple[str, bool]]:
    """Selectors with whether a client is built here; others take one that the caller gives."""
    return [(name, name.split(":")[0] in URLS) for name in sorted(PRICES)]


def wait_of(header: str | None) -> float | None:
    """Seconds of a Retry-After header: a number or a date; None if it says nothing."""
    if header is None:
        return None
    try:
        return max(0.0, float(header.strip()))
    except ValueError:
        pass
    try:
        return max(0.0, parsedate_to_datetime(header.strip()).timestamp() - time.time())
    except ValueError:
        return None


def post(url: str, headers: dict[str, str], body: dict, seconds: float) -> dict:
    """Statuses worth another attempt raise ConnectionError with the server's hint, others RuntimeError."""
    request = urllib.request.Request(url, data=json.dumps(body).encode(), headers={"Content-Type": "application/json", **headers}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        if e.code in (408, 429) or e.code >= 500:
            again = ConnectionError(f"HTTP {e.code}")
            again.retry_after = wait_of(e.headers.get("Retry-After"))
            raise again from None
        raise RuntimeError(f"HTTP {e.code}: {e.read()[:500].decode('utf-8', 'replace')}") from None
    except urllib.error.URLError as e:
        raise ConnectionError(str(e.reason)) from None


def _request(provider: str, model: str, key: str, system: str, user: str) -> tuple[dict[str, str], dict]:
    said = {"role": "user", "content": user}
    if provider == "openai":
        return {"Authorization": f"Bearer {key}"}, {"model": model, "messages": [{"role": "system", "content": system}, said]}
    if provider == "anthropic":
        return {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": model, "max_tokens": MOST_TOKENS, "system": system, "messages": [said]}
    return {"x-goog-api-key": key}, {"system_instruction": {"parts": [{"text": system}]}, "contents": [{"role": "user", "parts": [{"text": user}]}]}


def _answer(provider: str, got: dict) -> tuple[str, int, int]:
    """Text, tokens in and tokens out of an answer."""
    if provider == "openai":
        used = got.get("usage") or {}
        return got["choices"][0]["message"].get("content") or "", used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0
    if provider == "anthropic":
        used = got.get("usage") or {}
        return "".join(b.get("text", "") for b in got["content"]), used.get("input_tokens") or 0, used.get("output_tokens") or 0
    used = got.get("usageMetadata") or {}
    return "".join(p.get("text", "") for p in got["candidates"][0]["content"]["parts"]), used.get("promptTokenCount") or 0, used.get("candidatesTokenCount") or 0


def factory(selector: str, key: str | None = None, seconds: float = 300.0, send: Post = post, used: Callable[[int, int], None] | None = None, counts: bool = False) -> Callable[[], Callable[[str, str], Answer]]:
    """A client per Python worker for a selector provider:model.

    The key is the given one or that of the worker's environment; ``used`` is told the tokens of every answer (an accumulator's add, say),
    and with ``counts`` the client returns them beside it.
    """
    provider, _, model = selector.partition(":") if ":" in selector else (DEFAULT_PROVIDER, ":", selector)
    if provider not in URLS:
        raise ValueError(f"CONFIGURATION_ERROR: {provider} has no client here; give completion.client a factory")

    def make() -> Callable[[str, str], Answer]:
        own = key or os.environ.get(KEYS[provider])
        if not own:
            raise ValueError(f"CONFIGURATION_ERROR: {KEYS[provider]} is not set")

        def ask(system: str, user: str) -> Answer:
            headers, body = _request(provider, model, own, system, user)
            text, into, out = _answer(provider, send(URLS[provider].format(model=model), headers, body, seconds))
            if not text.strip():
                raise RuntimeError(f"PIPELINE_FAILED: {provider} gave an empty answer")
            if used is not None:
                used(max(0, into), max(0, out))
            return (text.strip(), max(0, into), max(0, out)) if counts else text.strip()

        return ask

    return make
