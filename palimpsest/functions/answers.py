"""Answers of language models: response text, JSON schemas without references, calls with retries and key rotation."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

#: Schema keys that providers do not take.
DROPPED = ("$defs", "title", "default", "additionalProperties")


def response_text(data) -> str:
    """The text of a response envelope: candidates[0].content.parts[*].text, or choices[0].message.content, or text; else empty."""
    if not isinstance(data, dict):
        return ""
    for c in data.get("candidates") or []:
        parts = ((c or {}).get("content") or {}).get("parts") or []
        return "".join(p.get("text", "") for p in parts if isinstance(p, dict))
    for c in data.get("choices") or []:
        return ((c or {}).get("message") or {}).get("content") or ""
    return data.get("text") or ""


def inlined(schema, defs: dict | None = None, depth: int = 0):
    """A JSON schema with every $ref replaced by what it names, and without keys that providers refuse."""
    if isinstance(schema, list):
        return [inlined(x, defs, depth) for x in schema]
    if not isinstance(schema, dict) or depth > 50:
        return schema
    defs = schema.get("$defs", defs or {})
    if "$ref" in schema:
        return inlined(defs.get(schema["$ref"].rsplit("/", 1)[-1], {}), defs, depth + 1)
    return {k: inlined(v, defs, depth + 1) for k, v in schema.items() if k not in DROPPED or (k in ("title", "default") and isinstance(v, dict) and "type" in v)}


def call(send: Callable[[str, str], str], prompt: str, keys: Sequence[str] = ("",), tries: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first answer of send(prompt, key); keys take turns, pauses double, the last error is raised."""
    error: Exception | None = None
    for i in range(max(1, tries)):
        try:
            return send(prompt, keys[i % len(keys)])
        except Exception as e:
            error = e
            if i + 1 < tries:
                sleep(pause * 2**i)
    raise error
