"""The engine's six verbs as tools: names, argument schemas and a dispatcher that takes and gives JSON values.

Any tool server can carry it; the transport is not part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable

from palimpsest.api import Engine
from palimpsest.errors import InvalidRequest, PalimpsestError

_USER = {"user_id": {"type": "string", "default": "default"}}
TOOLS: dict[str, dict] = {
    "add": {"messages": {"type": "array"}, "timestamp": {"type": ["string", "number", "null"]}, **_USER},
    "process": dict(_USER),
    "search": {"query": {"type": "string"}, "top_k_corpus": {"type": "integer", "default": 30}, **_USER},
    "inspect": {"view": {"enum": ["memories", "tree"], "default": "memories"}, "memory_type": {"type": ["string", "null"]}, **_USER},
    "forget": {"memory_id": {"type": "integer"}, **_USER},
    "reset": dict(_USER),
}


def _plain(x):
    if hasattr(x, "collect"):
        return [{k: v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for k, v in r.asDict().items()} for r in x.collect()]
    return {"context": x.context, "query_type": x.query_type, "trace": x.trace} if hasattr(x, "context") else x


def call(engine: Engine, tool: str, arguments: dict) -> dict:
    """{"ok": true, "result": ...} or {"ok": false, "error": ...}; unknown tools and arguments are errors."""
    if tool not in TOOLS or set(arguments) - set(TOOLS.get(tool, ())):
        return {"ok": False, "error": f"no such tool or argument: {tool}({', '.join(sorted(arguments))})"}
    verb: Callable = getattr(engine, tool)
    try:
        return {"ok": True, "result": _plain(verb(**arguments))}
    except (PalimpsestError, TypeError) as e:
        return {"ok": False, "error": str(e) if not isinstance(e, TypeError) else str(InvalidRequest(e))}
