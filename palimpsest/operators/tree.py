"""Topic tree: paths, closures, rendering, constraints, merges, pruning and change-sets.

topics: topic_id, parent_id, name (and user_id where several users share a table). Paths and closures are recursive SQL over the
adjacency list, so depth, not size, sets the number of rounds; chains of only children are followed by doubling pointers. Only order-dependent change-sets collect a tree (TREE_ROWS bounds it).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

#: Root names that tell nothing, the size of a tiny root, the depth that recursion may reach.
GENERIC, TINY, DEPTH = ("root", "general", "misc", "other", "miscellaneous"), 13, 100
TREE_ROWS = 100_000
MAX_LEAF, K_PER, K_MIN, K_MAX = 100, 30, 2, 5


def _unbounded(topics: DataFrame) -> DataFrame:
    """topics, in a session whose recursion is bounded by depth alone: a million rows, its default, is no large tree."""
    topics.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return topics


def paths(topics: DataFrame) -> DataFrame:
    """(topic_id, path, level, sort_key) of nodes reachable from the roots."""
    _unbounded(topics).select("topic_id", "parent_id", "name").createOrReplaceTempView("_pal_topics")
    return topics.sparkSession.sql(f"""
        WITH RECURSIVE walk(topic_id, path, level, sort_key) MAX RECURSION LEVEL {DEPTH} AS (
          SELECT topic_id, name, cast(0 as bigint), lpad(cast(topic_id as string), 20, '0') FROM _pal_topics WHERE parent_id IS NULL
          UNION ALL
          SELECT t.topic_id, concat(w.path, ' > ', t.name), w.level + 1, concat(w.sort_key, '/', lpad(cast(t.topic_id as string), 20, '0'))
          FROM walk w JOIN _pal_topics t ON t.parent_id = w.topic_id)
        SELECT * FROM walk""")


def closure(topics: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), each node its own ancestor at 0."""
    _unbounded(topics).select("topic_id", "parent_id").createOrReplaceTempView("_pal_edges")
    return topics.sparkSession.sql(f"""
        WITH RECURSIVE up(ancestor, descendant, distance) MAX RECURSION LEVEL {DEPTH} AS (
          SELECT topic_id, topic_id, cast(0 as bigint) FROM _pal_edges
          UNION ALL
          SELECT e.parent_id, u.descendant, u.distance + 1 FROM up u JOIN _pal_edges e ON e.topic_id = u.ancestor WHERE e.parent_id IS NOT NULL)
        SELECT * FROM up""")


def leaves(topics: DataFrame) -> DataFrame:
    return topics.join(topics.select(F.col("parent_id").alias("topic_id")).filter("topic_id is not null").distinct(), "topic_id", "left_anti")


def memory_counts(memories: DataFrame) -> DataFrame:
    return memories.filter("topic_id is not null").groupBy("topic_id").agg(F.count("*").alias("n"))


def render(topics: DataFrame, counts: DataFrame) -> DataFrame:
    """(root, tree): pre-order lines, a tab per level, with memories of leaves and children of the others."""
    kids = topics.filter("parent_id is not null").groupBy(F.col("parent_id").alias("topic_id")).agg(F.count("*").alias("children"))
    d = paths(topics).join(topics.select("topic_id", "name"), "topic_id").join(kids, "topic_id", "left").join(counts, "topic_id", "left")
    tag = F.when(F.col("children") > 0, F.concat(F.lit(" [children:"), F.col("children").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit(" [memories:"), F.coalesce("n", F.lit(0)).cast("string"), F.lit("]")))
    line = F.concat(F.expr("repeat('\t', cast(level as int))"), "name", tag)
    d = d.select(F.split("sort_key", "/")[0].cast("bigint").alias("root"), "sort_key", line.alias("line"))
    return d.groupBy("root").agg(F.expr("listagg(line, '\\n') within group (order by sort_key)").alias("tree"))


def creates_cycle(topics: DataFrame, moves: DataFrame) -> DataFrame:
    """Those of the moves (topic_id, new_parent) whose parent stands below the topic itself."""
    c = closure(topics).select(F.col("ancestor").alias("topic_id"), F.col("descendant").alias("new_parent"))
    return moves.join(c, ["topic_id", "new_parent"], "left_semi")


def resolve(topics: DataFrame, chains: DataFrame, first_new_id: int) -> tuple[DataFrame, DataFrame]:
    """(chain_id, topic_id) of each chain of names, and the topics with the missing ones created.

    chains: chain_id, chain (array of names). One join a level; names compare normalised. A target that has children gets a leaf
    `General <name>` below it.
    """
    from palimpsest.sources.tables import checkpointed

    norm = X.normalize_name(F.col("name"))
    depth = chains.agg(F.max(F.size("chain"))).first()[0] or 0
    at = chains.select("chain_id", "chain", F.lit(None).cast("bigint").alias("parent_id"))
    for level in range(depth):
        want = at.withColumn("name", F.when(F.size("chain") > level, F.get("chain", F.lit(level))))
        known = topics.select(F.coalesce("parent_id", F.lit(-1)).alias("_p"), norm.alias("_n"), F.col("topic_id").alias("_id")).groupBy("_p", "_n").agg(F.min("_id").alias("_id"))
        missing = want.filter("name is not null").select(F.coalesce("parent_id", F.lit(-1)).alias("_p"), norm.alias("_n"), "name", "parent_id").join(known, ["_p", "_n"], "left_anti").groupBy("_p", "_n").agg(F.min("name").alias("name"), F.first("parent_id").alias("parent_id"))
        made = missing.withColumn("topic_id", F.lit(first_new_id) + F.row_number().over(Window.orderBy("_p", "_n")) - 1).select(F.col("topic_id").cast("bigint"), "parent_id", "name")
        made = checkpointed(made)
        first_new_id += made.count()
        topics = topics.select("topic_id", "parent_id", "name").unionByName(made)
        known = topics.select(F.coalesce("parent_id", F.lit(-1)).alias("_p"), norm.alias("_n"), F.col("topic_id").alias("_id")).groupBy("_p", "_n").agg(F.min("_id").alias("_id"))
        want = want.withColumn("_p", F.coalesce("parent_id", F.lit(-1))).withColumn("_n", norm).join(known, ["_p", "_n"], "left")
        at = checkpointed(want.select("chain_id", "chain", F.coalesce("_id", "parent_id").alias("parent_id")))
    inner = topics.filter("parent_id is not null").select(F.col("parent_id").alias("topic_id")).distinct()
    split = at.select(F.col("parent_id").alias("topic_id")).distinct().join(inner, "topic_id").join(topics.select("topic_id", "name"), "topic_id")
    split = split.withColumn("want", F.concat(F.lit("General "), "name"))
    general = topics.filter(F.lower("name").startswith("general ")).groupBy("parent_id").agg(F.min("topic_id").alias("leaf"))
    split = split.join(general, split["topic_id"] == general["parent_id"], "left").select(split["topic_id"], "want", "leaf")
    new = split.filter("leaf is null").withColumn("leaf", (F.lit(first_new_id) + F.row_number().over(Window.orderBy("topic_id")) - 1).cast("bigint"))
    topics = topics.unionByName(new.select(F.col("leaf").alias("topic_id"), F.col("topic_id").alias("parent_id"), F.col("want").alias("name")))
    to = split.filter("leaf is not null").select("topic_id", "leaf").unionByName(new.select("topic_id", "leaf"))
    out = at.withColumnRenamed("parent_id", "topic_id").join(to, "topic_id", "left").select("chain_id", F.coalesce("leaf", "topic_id").alias("topic_id"))
    return out, topics


def enforce_leaves(topics: DataFrame, counts: DataFrame, first_new_id: int) -> tuple[DataFrame, DataFrame]:
    """Topics after every node with children and memories is split, and redirects (topic_id, leaf) for its memories.

    A node named `General …` hands its children to its parent instead and stays a leaf.
    """
    inner = topics.filter("parent_id is not null").select(F.col("parent_id").alias("topic_id")).distinct()
    both = topics.join(inner, "topic_id").join(counts.filter("n > 0").select("topic_id"), "topic_id", "left_semi")
    general = F.lower("name").startswith("general ")
    hoist = both.filter(general).select(F.col("topic_id").alias("_from"), F.col("parent_id").alias("_to"))
    split = both.filter(~general).withColumn("leaf", (F.lit(first_new_id) + F.row_number().over(Window.orderBy("topic_id")) - 1).cast("bigint"))
    moved = topics.join(hoist, topics["parent_id"] == F.col("_from"), "left").select("topic_id", F.when(F.col("_from").isNotNull(), F.col("_to")).otherwise(F.col("parent_id")).alias("parent_id"), "name")
    out = moved.unionByName(split.select(F.col("leaf").alias("topic_id"), F.col("topic_id").alias("parent_id"), F.concat(F.lit("General "), "name").alias("name")))
    return out, split.select("topic_id", "leaf")


def sibling_survivors(topics: DataFrame, counts: DataFrame) -> DataFrame:
    """(topic_id, survivor): siblings of one normalised name go to the one with most memories, then the smallest id."""
    d = topics.join(counts, "topic_id", "left").withColumn("_n", X.normalize_name(F.col("name"))).withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("parent_id", "_n").orderBy(F.desc("n"), "topic_id")
    return d.select("topic_id", F.first("topic_id").over(w).alias("survivor"))


def root_survivors(topics: DataFrame) -> DataFrame:
    """(topic_id, survivor, size) of roots: of one normalised name the root with most descendants stays."""
    sizes = closure(topics).groupBy(F.col("ancestor").alias("topic_id")).agg(F.count("*").alias("size"))
    d = topics.filter("parent_id is null").join(sizes, "topic_id").withColumn("_n", X.normalize_name(F.col("name")))
    return d.select("topic_id", F.first("topic_id").over(Window.partitionBy("_n").orderBy(F.desc("size"), "topic_id")).alias("survivor"), "size")


def problem_roots(topics: DataFrame) -> DataFrame:
    sizes = closure(topics).groupBy(F.col("ancestor").alias("topic_id")).agg(F.count("*").alias("size"))
    d = topics.filter("parent_id is null").join(sizes, "topic_id")
    return d.filter(F.lower(F.trim("name")).isin(*GENERIC) | (F.col("size") <= TINY)).select("topic_id", "name", "size")


def prune_empty(topics: DataFrame, counts: DataFrame) -> DataFrame:
    """Topics that hold memories or stand above some that do."""
    live = closure(topics).join(counts.filter("n > 0").select(F.col("topic_id").alias("descendant")), "descendant", "left_semi").select(F.col("ancestor").alias("topic_id")).distinct()
    return topics.join(live, "topic_id", "left_semi")


def merge_metadata(topics: DataFrame, survivors: DataFrame) -> DataFrame:
    """Survivors with descriptions joined in order of id, and the earliest time. topics: topic_id, description, ts."""
    d = topics.join(survivors.select("topic_id", "survivor"), "topic_id")
    parts = F.array_sort(F.collect_list(F.struct((F.col("topic_id") != F.col("survivor")).alias("_o"), "topic_id", "description")))
    said = F.array_join(F.filter(F.transform(parts, lambda x: x["description"]), lambda x: F.coalesce(x, F.lit("")) != ""), "\n[Merged source]\n")
    return d.groupBy("survivor").agg(F.min("ts").alias("ts"), said.alias("description"), F.count("*").alias("merged")).withColumnRenamed("survivor", "topic_id")


def merge_items(target: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Deep merge of two long summary tables: the target's filled values stay, its gaps and missing keys come from the source."""
    s = source.withColumnRenamed(value, "_s")
    return target.join(s, keys, "full").select(*keys, F.coalesce(F.nullif(value, F.lit("")), "_s", value).alias(value))


def chain_heads(links: DataFrame) -> DataFrame:
    """(topic_id, head, distance) for links (topic_id, parent_id) that form chains. The depth of chains doubles with every round of joins."""
    from palimpsest.sources.tables import checkpointed

    at = checkpointed(links.select("topic_id", F.col("parent_id").alias("head"), F.lit(1).cast("bigint").alias("distance"), F.lit(True).alias("moved")))
    n, reach = at.count(), 1
    while not at.filter("moved").isEmpty():
        if reach > 2 * n:
            raise ValueError("topics stand in a cycle")
        hop = at.select(F.col("topic_id").alias("head"), F.col("head").alias("_h"), F.col("distance").alias("_d"))
        moved = F.col("_h").isNotNull()
        at = checkpointed(at.join(hop, "head", "left").select("topic_id", F.coalesce("_h", "head").alias("head"), F.when(moved, F.col("distance") + F.col("_d")).otherwise(F.col("distance")).alias("distance"), moved.alias("moved")))
        reach *= 2
    return at.drop("moved")


def collapse_chains(topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics after every only child has folded into its parent, and redirects (topic_id, kept).

    A chain's nodes all go to its head; its name is the better of each pair from the bottom up.
    """
    kids = topics.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"), F.max("topic_id").alias("only"))
    single = kids.filter("n = 1").select(F.col("only").alias("topic_id"), F.col("parent_id").alias("up"))
    c = topics.join(single, "topic_id").select("topic_id", F.col("up").alias("parent_id"))
    below = chain_heads(c)
    chain = below.unionByName(below.select(F.col("head").alias("topic_id"), "head", F.lit(0).cast("bigint").alias("distance")).distinct())
    member = chain.select(F.col("head").alias("ancestor"), F.col("topic_id").alias("descendant"), "distance").join(topics.select(F.col("topic_id").alias("descendant"), "name"), "descendant")
    order = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")))
    zero, step = F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull(), x["name"]).otherwise(X.better_name(x["name"], acc))
    named = member.groupBy("ancestor").agg(F.aggregate(order, zero, step).alias("new_name"))
    redirect = member.filter("distance > 0").select(F.col("descendant").alias("topic_id"), F.col("ancestor").alias("kept"))
    t = topics.join(redirect.select("topic_id"), "topic_id", "left_anti").join(named.withColumnRenamed("ancestor", "topic_id"), "topic_id", "left")
    t = t.join(redirect.select(F.col("topic_id").alias("parent_id"), F.col("kept").alias("_k")), "parent_id", "left")
    return t.select("topic_id", F.coalesce("_k", "parent_id").alias("parent_id"), F.coalesce("new_name", "name").alias("name")), redirect


def purge_source_map(source_map: DataFrame, topics: DataFrame) -> DataFrame:
    """Rows of a source map whose child still is a child of its parent."""
    real = topics.filter("parent_id is not null").select("parent_id", F.col("topic_id").alias("child_id"))
    return source_map.join(real, ["parent_id", "child_id"], "left_semi")


def reorg_due(before: Column, after: Column, every: int = 60) -> Column:
    return F.floor(after / every) > F.floor(before / every)


def parse_changes(raw: str) -> list[dict]:
    """Changes of a planner's answer; a truncated one counts up to its last whole object."""
    raw = re.sub(r"```[a-zA-Z]*\s*", "", raw or "").strip()
    for attempt in (raw, raw[: raw.rfind("}") + 1] + "\n]}"):
        try:
            got = json.loads(attempt)
            return [c for c in got.get("modified_nodes_only", []) if isinstance(c, dict) and "id" in c]
        except (ValueError, AttributeError):
            continue
    return []


def category_name(key: str) -> str:
    """NEW_machineLearning -> Machine Learning."""
    words = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", key[4:].replace("_", " ")).split()
    return " ".join(w.title() if w.islower() else w for w in words)


class Forest:
    """A user's tree on the driver for order-dependent changes; at most TREE_ROWS nodes."""

    def __init__(self, rows: list[tuple[int, int | None, str]]):
        if len(rows) > TREE_ROWS:
            raise ValueError(f"a tree of over {TREE_ROWS} topics: reorganise it by subtree")
        self.parent = {i: p for i, p, _ in rows}
        self.name = {i: n for i, _, n in rows}
        self.redirect: dict[int, int] = {}
        self.next = max(self.parent, default=0) + 1

    def at(self, i):
        while i in self.redirect:
            i = self.redirect[i]
        return i

    def above(self, top, i) -> bool:
        """top is i or one of its ancestors."""
        seen = set()
        while i is not None and i not in seen:
            if i == top:
                return True
            seen.add(i)
            i = self.parent.get(i)
        return False

    def apply(self, changes: list[dict]) -> Forest:
        """New categories, then merges, then renames and moves. Unknown ids, cycles and null merges are passed over."""
        made: dict[str, int] = {}

        def number(x):
            if x is None:
                return None
            if isinstance(x, str) and x.upper().startswith("NEW_"):
                if x.lower() not in made:
                    made[x.lower()] = self.next
                    self.parent[self.next], self.name[self.next] = None, category_name(x)
                    self.next += 1
                return made[x.lower()]
            return int(x) if str(x).lstrip("-").isdigit() else -1

        for c in changes:
            for k in ("id", "parent_id", "merged_into_id"):
                if k in c:
                    number(c[k])
        moved = set()
        for c in changes:
            a, b = number(c["id"]), number(c.get("merged_into_id"))
            a, b = self.at(a), self.at(b) if b is not None else None
            if b is None or a == b or a not in self.parent or b not in self.parent:
                continue
            if self.above(a, b):  # merged into its own descendant: the bridge, a's child above it, rises first
                bridge = b
                while self.parent[bridge] != a:
                    bridge = self.parent[bridge]
                self.parent[bridge] = self.parent[a]
                moved.add(bridge)
            for child in [i for i, p in self.parent.items() if p == a and i != b]:
                self.parent[child] = b
                moved.add(child)
            del self.parent[a], self.name[a]
            self.redirect[a] = b
        for c in changes:
            a = self.at(number(c["id"]))
            if a not in self.parent or c.get("merged_into_id") is not None:
                continue
            if c.get("name"):
                self.name[a] = c["name"]
            if "parent_id" in c:
                p = number(c["parent_id"])
                p = self.at(p) if p is not None else None
                if p is None:
                    if a not in moved:
                        self.parent[a] = None
                elif p in self.parent and not self.above(a, p):
                    self.parent[a] = p
        return self

    def rows(self) -> list[tuple[int, int | None, str]]:
        return sorted((i, p, self.name[i]) for i, p in self.parent.items())


def apply_changes(topics: DataFrame, changes: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Topics after a change-set, and redirects (topic_id, kept) of merged ones."""
    spark = topics.sparkSession
    rows = [(r.topic_id, r.parent_id, r.name) for r in topics.select("topic_id", "parent_id", "name").limit(TREE_ROWS + 1).collect()]
    f = Forest(rows).apply(changes)
    out = spark.createDataFrame(f.rows(), "topic_id bigint, parent_id bigint, name string")
    return out, spark.createDataFrame([(a, f.at(a)) for a in sorted(f.redirect)], "topic_id bigint, kept bigint")
