"""Incremental summaries: leaf items and their deltas, batching, source maps and the bottom-up roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Memories up to which a leaf has no description, updates before a rebuild, least length of an ignored text, batch sizes.
GATE, REBUILD_AFTER, MIN_IGNORED, LEAF_CHARS, PARENT_CHARS = 50, 10, 60, 8_000, 28_000


def leaf_items(memories: DataFrame) -> DataFrame:
    """(topic_id, kind, minute, mem_id, text) of memories: id, topic_id, memory_type, content, ts and decisions' state."""
    decision = F.col("memory_type") == "decision"
    said = F.concat(F.lit("[Decision:"), F.coalesce("status", F.lit("active")), F.lit("] "), "content", F.when(F.col("context").isNotNull(), F.concat(F.lit(" | Context: "), "context")).otherwise(""), F.when(F.col("last_validated_at").isNotNull(), F.concat(F.lit(" | Last validated: "), F.date_format("last_validated_at", "yyyy-MM-dd"))).otherwise(""))
    text = F.when(decision, said).otherwise(F.concat(F.lit("["), F.initcap("memory_type"), F.lit("] "), "content"))
    return memories.filter("topic_id is not null").select("topic_id", F.when(decision, "decision").otherwise("memory").alias("kind"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"), F.col("id").alias("mem_id"), text.alias("text"))


def format_leaf(items: DataFrame) -> DataFrame:
    """(topic_id, text): newest minute first, decisions after the rest."""
    return items.groupBy("topic_id").agg(F.expr("listagg(concat(minute, ' ', text), '\\n') within group (order by kind desc, minute desc, mem_id)").alias("text"), F.count("*").alias("items"))


def leaf_delta(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items that the stored summary does not hold, and decisions whose text has changed; late ones count too."""
    s = stored.select("topic_id", "mem_id", F.col("text").alias("_old"))
    d = items.join(s, ["topic_id", "mem_id"], "left")
    return d.filter(F.col("_old").isNull() | ((F.col("kind") == "decision") & (F.col("text") != F.col("_old")))).drop("_old")


def route_leaf(n: Column, described: Column, dirty: Column, updates: Column, changed: Column) -> Column:
    """none, create, update or rebuild for a leaf of n memories."""
    return F.when(n <= GATE, "none").when(~described, "create").when(updates >= REBUILD_AFTER, "rebuild").when(changed | dirty, "update").otherwise("none")


def write_back(state: DataFrame, answers: DataFrame) -> DataFrame:
    """Leaf state (topic_id, description, updates) after answers (topic_id, new, mode); a missing or blank one leaves it."""
    ok = F.coalesce(F.trim("new"), F.lit("")) != ""
    d = state.join(answers, "topic_id", "left")
    updates = F.when(ok & (F.col("mode") == "update"), F.col("updates") + 1).when(ok, 0).otherwise(F.col("updates"))
    return d.select("topic_id", F.when(ok, F.col("new")).otherwise(F.col("description")).alias("description"), updates.cast("int").alias("updates"))


def child_delta(children: DataFrame, source_map: DataFrame, parents: DataFrame) -> DataFrame:
    """(parent_id, child_id, state, text) of children that changed since their parent: NEW, EXISTING_SOURCE or IGNORED.

    children: parent_id, child_id, description, ts; source_map: parent_id, child_id, state; parents: parent_id, ts.
    """
    d = children.join(source_map.select("parent_id", "child_id", F.col("state").alias("_s")), ["parent_id", "child_id"], "left").join(parents.select("parent_id", F.col("ts").alias("_since")), "parent_id")
    d = d.withColumn("state", F.when(F.col("_s") == "source", "EXISTING_SOURCE").when(F.col("_s") == "ignored", "IGNORED").otherwise("NEW"))
    fresh = F.col("_s").isNull() | F.col("_since").isNull() | (F.col("ts") > F.col("_since"))
    return d.filter(fresh & (F.coalesce("description", F.lit("")) != "") & ~((F.col("state") == "IGNORED") & (F.length("description") < MIN_IGNORED))).select("parent_id", "child_id", "state", F.col("description").alias("text"), "ts")


def inherit_single(children: DataFrame) -> DataFrame:
    """(parent_id, description) of parents with one child: they take its description."""
    return children.groupBy("parent_id").agg(F.count("*").alias("_n"), F.max("description").alias("description")).filter("_n = 1").drop("_n")


def tier(level: Column, deepest: Column) -> Column:
    r = level / F.greatest(deepest, F.lit(1))
    return F.when(r >= 0.7, "near_leaf").when(r >= 0.3, "mid").otherwise("high")


def patch_source_map(current: DataFrame, patch: DataFrame, offered: DataFrame) -> DataFrame:
    """The source map after a patch. current: parent_id, child_id, text, state; patch: parent_id, child_id, action, new_text.

    Offered children that a patch does not mention become ignored.
    """
    keys = ["parent_id", "child_id"]
    d = current.join(patch, keys, "full").join(offered.select(*keys).distinct().withColumn("_o", F.lit(True)), keys, "full")
    state = F.when(F.col("action") == "modify", "source").when(F.col("action").isin("remove", "add_ignore"), "ignored").when(F.col("state").isNull() & F.col("_o"), "ignored").otherwise(F.col("state"))
    text = F.when(F.col("action") == "modify", F.col("new_text")).when(state == "source", F.col("text"))
    return d.select(*keys, text.alias("text"), state.alias("state"))


def describe(source_map: DataFrame) -> DataFrame:
    """(parent_id, description): the sources' texts in order of child."""
    return source_map.filter("state = 'source'").groupBy("parent_id").agg(F.expr("listagg(text, '\\n') within group (order by child_id)").alias("description"))


def roll_up(topics: DataFrame, own: DataFrame, value: str = "value") -> DataFrame:
    """(topic_id, level, total, tier): sums over each subtree. own: topic_id, value."""
    from .tree import closure, paths

    c = closure(topics).join(own.withColumnRenamed("topic_id", "descendant"), "descendant", "left")
    total = c.groupBy(F.col("ancestor").alias("topic_id")).agg(F.coalesce(F.sum(value), F.lit(0)).alias("total"))
    lv = paths(topics).select("topic_id", "level")
    return total.join(lv, "topic_id").crossJoin(F.broadcast(lv.agg(F.max("level").alias("_deep")))).select("topic_id", "level", "total", tier(F.col("level"), F.col("_deep")).alias("tier"))


def search_text(items: DataFrame) -> DataFrame:
    """(topic_id, text): a leaf's item texts in order of memory, without their tags."""
    bare = F.regexp_replace("text", r"^\[[^\]]*\]\s*", "")
    return items.withColumn("_b", bare).groupBy("topic_id").agg(F.expr("listagg(_b, ' ') within group (order by mem_id)").alias("text"))
