"""Models behind small interfaces, with deterministic defaults that need no network."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X


class Extractor(Protocol):
    """Turns a prompt and known paths into an extraction document (a JSON object)."""

    def __call__(self, prompt: str, paths: list[str]) -> dict: ...


class Embedder(Protocol):
    """(key, embedding) for the texts of a frame; dims is the length that the engine stores."""

    def __call__(self, texts: DataFrame, key: str, text: str, dims: int) -> DataFrame: ...


class Reranker(Protocol):
    """A score for each (query, text) of a candidate frame, as column `score`."""

    def __call__(self, query: str, candidates: DataFrame) -> DataFrame: ...


class Summarizer(Protocol):
    def __call__(self, items: list[str], budget: int) -> str: ...


class TreePlanner(Protocol):
    def __call__(self, tree_text: str) -> str: ...


class DecisionJudge(Protocol):
    def __call__(self, clustered: DataFrame) -> DataFrame: ...


def hashed_embeddings(texts: DataFrame, key: str, text: str = "text", dims: int = 768) -> DataFrame:
    """(key, embedding): a hashed bag of the lemmas of the first 1000 words, at length one; zeros for a text without words."""
    w = texts.select(key, F.explode_outer(F.slice(X.words(F.col(text)), 1, 1000)).alias("t"))
    n = w.groupBy(key, F.pmod(F.xxhash64(X.lemma(F.col("t"))), F.lit(dims)).cast("int").alias("i")).agg(F.count("t").alias("n"))
    bag = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", F.col("n").cast("double").alias("n")))).alias("bag"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("bag", i), F.lit(0.0)))
    return bag.select(key, X.unit(dense).alias("v")).select(key, F.transform("v", lambda x: x.cast("float")).alias("embedding"))


def first_sentences(items: list[str], budget: int = 2_000) -> str:
    """The first sentence of each item while the budget lasts."""
    out, used = [], 0
    for item in items:
        said = re.split(r"(?<=[.!?])\s", item.strip(), maxsplit=1)[0]
        if out and used + len(said) > budget:
            break
        out.append(said)
        used += len(said) + 1
    return "\n".join(out)


def rule_extractor(prompt: str, paths: list[str]) -> dict:
    """User lines as memories by plain cues: decisions, facts about the user, what happened, else knowledge."""
    bucket: dict[str, list[str]] = {"user": [], "fact": [], "epis": [], "decision": []}
    for line in re.findall(r"(?m)^User:\s*(.+)$", prompt):
        low = line.lower()
        kind = "decision" if re.search(r"\b(decided|will use|going with|chose|let's use)\b", low) else "user" if re.search(r"\b(i am|i'm|my|i like|i prefer)\b", low) else "epis" if re.search(r"\b(yesterday|today|did|went|finished)\b", low) else "fact"
        bucket[kind].append(line.strip())
    if not any(bucket.values()):
        return {"topics_root": [], "memory": []}
    root = paths[0].split(" > ") if paths else ["General"]
    return {"topics_root": root, "memory": [{"topics_branch": [], **bucket}]}


def keep_order(query: str, candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("score", F.col("rrf"))


def no_changes(tree_text: str) -> str:
    return '{"modified_nodes_only": []}'


def newest_is_active(clustered: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id", "cluster").orderBy(F.desc("ts"), F.desc("id"))
    return clustered.select("id", F.when(F.row_number().over(w) == 1, "active").otherwise("superseded").alias("new_status"))
