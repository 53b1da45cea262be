"""Plain-text views of memories, trees and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame


def memories(df: DataFrame, limit: int = 50, width: int = 80) -> str:
    """A line a memory, newest ids first; `limit` is for the screen."""
    rows = df.orderBy(df["id"].desc()).limit(limit).collect()
    return "\n".join(f"#{r.id} [{r.memory_type}{':' + r.status if r.status else ''}] {r.topic}: {r.content[: width - 1] + '…' if len(r.content) > width else r.content}" for r in rows) or "(no memories)"


def tree(nodes: list[dict], depth: int = 0) -> str:
    """The nested dicts of an engine's tree, a step a level."""
    out = []
    for n in nodes:
        out.append("  " * depth + f"- {n['name']} ({n['id']})")
        if n["children"]:
            out.append(tree(n["children"], depth + 1))
    return "\n".join(out) or "(empty tree)"


def context(result) -> str:
    return f"query type: {result.query_type}\nentries: {len(result.trace.get('entries', []))}\n\n{result.context}"
