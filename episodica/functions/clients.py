"""Clients of model servers, by plain HTTP: factories that a task calls once, whose calls take a prompt and images."""

from __future__ import annotations

import base64
import json
import os
import urllib.request
from collections.abc import Callable, Sequence

Call = Callable[..., str]


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def _coded(image: bytes) -> str:
    return base64.b64encode(image).decode()


def chat(model: str, base_url: str, key_variable: str = "", max_tokens: int = 320, temperature: float = 0.0, timeout: float = 120.0) -> Callable[[], Call]:
    """For servers of chat completions: a message of the prompt and of the images as data URLs.

    The key is read from an environment variable of the worker, so it is in no plan and no log.
    """

    def make() -> Call:
        headers = {"Authorization": f"Bearer {os.environ.get(key_variable) or 'EMPTY'}"}

        def call(prompt: str, images: Sequence[bytes] = ()) -> str:
            parts = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": f"data:image/jpeg;base64,{_coded(i)}"}} for i in images)]
            body = {"model": model, "temperature": temperature, "max_tokens": max_tokens, "messages": [{"role": "user", "content": parts}]}
            found = _post(f"{base_url.rstrip('/')}/chat/completions", body, headers, timeout)
            return found["choices"][0]["message"].get("content") or ""

        return call

    return make


def generate(model: str, base_url: str, key_variable: str = "", max_tokens: int = 2048, temperature: float = 0.1, timeout: float = 120.0) -> Callable[[], Call]:
    """For servers that generate content from parts, asked for JSON."""

    def make() -> Call:
        headers = {"x-goog-api-key": os.environ.get(key_variable, "")}

        def call(prompt: str, images: Sequence[bytes] = ()) -> str:
            parts = [{"text": prompt}, *({"inlineData": {"mimeType": "image/jpeg", "data": _coded(i)}} for i in images)]
            config = {"temperature": temperature, "maxOutputTokens": max_tokens, "responseMimeType": "application/json"}
            found = _post(f"{base_url.rstrip('/')}/models/{model}:generateContent", {"contents": [{"parts": parts}], "generationConfig": config}, headers, timeout)
            return "".join(p.get("text", "") for p in found["candidates"][0]["content"]["parts"])

        return call

    return make
