"""Decision lifecycle and repair of detached memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

#: States of a decision, and those that count as live.
STATES, LIVE = ("active", "inactive", "superseded", "rejected", "conditional"), ("active", "conditional")


def live(memories: DataFrame) -> DataFrame:
    return memories.filter(F.col("status").isin(*LIVE))


def to_analyse(clustered: DataFrame, by: str = "user_id") -> DataFrame:
    """Rows of clusters of several decisions of which one was never judged. clustered: by, cluster, context, last_validated_at."""
    due = clustered.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.bool_or(F.col("context").isNull() | F.col("last_validated_at").isNull()).alias("open")).filter("n > 1 and open")
    return clustered.join(due.select(by, "cluster"), [by, "cluster"], "left_semi")


def newest_wins(clustered: DataFrame, by: tuple[str, ...] = ("user_id", "cluster"), key: str = "id", ts: str = "ts") -> DataFrame:
    """(key, new_status): the default verdict; the newest of a cluster is active, the others are superseded."""
    w = Window.partitionBy(*by).orderBy(F.desc(ts), F.desc(key))
    return clustered.select(key, F.when(F.row_number().over(w) == 1, "active").otherwise("superseded").alias("new_status"))


def apply_verdicts(decisions: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Decisions with the verdicts' states; unknown ids and states change nothing."""
    ok = verdicts.filter(F.col("new_status").isin(*STATES)).select(key, "new_status")
    return decisions.join(ok, key, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def detached(memories: DataFrame) -> DataFrame:
    return memories.filter("topic_id is null and embedding is not null")


def repair(memories: DataFrame, topics: DataFrame) -> DataFrame:
    """(id, topic_id, how, sim) for detached memories: the topic of the most similar attached sibling, else the nearest topic.

    Siblings share a message. topics: topic_id, embedding; one user's topics, so broadcast after a bound on their number.
    """
    lost = detached(memories).select("id", "message_id", X.unit(F.col("embedding")).alias("_a"))
    kept = memories.filter("topic_id is not null and embedding is not null and message_id is not null").select("message_id", F.col("id").alias("_sib"), "topic_id", X.unit(F.col("embedding")).alias("_b"))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "_sib")
    by_sibling = lost.join(kept, "message_id").withColumn("sim", F.round(X.dot(F.col("_a"), F.col("_b")), 9)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("id", "topic_id", F.lit("sibling").alias("how"), "sim")
    from .cluster import nearest

    rest = lost.join(by_sibling.select("id"), "id", "left_anti")
    by_topic = nearest(rest, topics.filter("embedding is not null"), "id", "_a", "topic_id", "embedding").select("id", "topic_id", F.lit("topic").alias("how"), "sim")
    return by_sibling.unionByName(by_topic)
