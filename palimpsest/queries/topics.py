"""Topic tree queries, over region > nation > customer and trees made from other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import tree as T
from palimpsest.sources.tables import checkpointed

from .shared import table


def _nations(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("topic_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select((100 + F.col("n_nationkey")).cast("bigint").alias("topic_id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_name").alias("name"))
    return r.unionByName(n)


def _tree(spark, d):
    c = table(spark, d, "customer").select((1000 + F.col("c_custkey")).alias("topic_id"), (100 + F.col("c_nationkey")).cast("bigint").alias("parent_id"), F.col("c_name").alias("name"))
    return checkpointed(_nations(spark, d).unionByName(c))  # recursion reads it again and again


def _memories(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (1000 + F.col("o_custkey")).alias("topic_id"))


def tree_paths(spark, d):
    return T.paths(_tree(spark, d)).select("topic_id", "path", "level")


def tree_leaves(spark, d):
    return T.leaves(_tree(spark, d)).select("topic_id")


def topic_counts(spark, d):
    return T.memory_counts(_memories(spark, d))


def tree_render(spark, d):
    counts = table(spark, d, "customer").select((100 + F.col("c_nationkey")).cast("bigint").alias("topic_id")).groupBy("topic_id").agg(F.count("*").alias("n"))
    return T.render(checkpointed(_nations(spark, d)), counts)


def cluster_tree_text(spark, d):
    """The tree text of nations of even number and of all that stands above them, and its length in tokens."""
    t = _nations(spark, d).filter("topic_id < 100 or topic_id % 2 = 0")
    return T.render(checkpointed(t), spark.createDataFrame([], "topic_id bigint, n bigint")).select("root", F.length("tree").cast("bigint").alias("chars"), X.estimate_tokens(F.col("tree")).alias("tokens"))


def descendants(spark, d):
    return T.closure(_tree(spark, d)).groupBy(F.col("ancestor").alias("topic_id")).agg(F.count("*").alias("size"), F.max("distance").alias("height"))


def cycle_moves(spark, d):
    """Moves of each nation below each of its customers of a key divisible by seven, and of customers below regions."""
    t = _tree(spark, d)
    down = t.filter("topic_id >= 1000 and topic_id % 7 = 0").select(F.col("parent_id").alias("topic_id"), F.col("topic_id").alias("new_parent"))
    up = t.filter("topic_id >= 1000 and topic_id % 7 = 1").select("topic_id", F.lit(0).cast("bigint").alias("new_parent"))
    return T.creates_cycle(t, down.unionByName(up)).select("topic_id", "new_parent")


def normalize_names(spark, d):
    p = table(spark, d, "part").select(F.concat("p_type", F.lit("  "), "p_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("General "), "n_name", F.lit(" Countries")).alias("name"))
    return p.unionByName(n).groupBy(X.normalize_name(F.col("name")).alias("normalized")).agg(F.count("*").alias("n"))


def resolve_paths(spark, d):
    """Chains brand > type > size of parts, into a tree that has the brands of even number already."""
    p = table(spark, d, "part")
    brands = p.select("p_brand").distinct().filter("cast(right(p_brand, 1) as int) % 2 = 0")
    topics = brands.select(F.substring("p_brand", 7, 5).cast("bigint").alias("topic_id"), F.lit(None).cast("bigint").alias("parent_id"), F.col("p_brand").alias("name"))
    chains = p.select(F.col("p_partkey").alias("chain_id"), F.array("p_brand", "p_type", F.concat(F.lit("size"), F.col("p_size").cast("string"))).alias("chain"))
    to, tree = T.resolve(checkpointed(topics), checkpointed(chains), 1000)
    return to.join(T.paths(checkpointed(tree)), "topic_id").groupBy("path").agg(F.count("*").alias("parts"))


def _split_tree(spark, d):
    """Nations as a tree whose regions of even key hold memories besides children."""
    counts = spark.range(0, 5).select(F.col("id").alias("topic_id"), F.when(F.col("id") % 2 == 0, 3).otherwise(0).cast("bigint").alias("n"))
    return checkpointed(_nations(spark, d)), counts


def leaf_constraint(spark, d):
    topics, redirect = T.enforce_leaves(*_split_tree(spark, d), 10_000)
    return topics.join(redirect.select("topic_id", "leaf"), "topic_id", "left").select("topic_id", "parent_id", "name", F.col("leaf").isNotNull().alias("was_split"))


def _brands(spark, d):
    """A topic for each part: its type in one of two spellings below its brand."""
    p = table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.initcap("p_type")).otherwise(F.concat(F.lit("General "), F.lower("p_type"), F.lit("s")))
    return p.select((1000 + F.col("p_partkey")).alias("topic_id"), F.substring("p_brand", 7, 5).cast("bigint").alias("parent_id"), name.alias("name"), F.col("p_size").cast("bigint").alias("n"))


def sibling_dedup(spark, d):
    t = _brands(spark, d)
    return T.sibling_survivors(t.drop("n"), t.select("topic_id", "n"))


def metadata_merge(spark, d):
    t = _brands(spark, d)
    to = T.sibling_survivors(t.drop("n"), t.select("topic_id", "n"))
    meta = t.select("topic_id", F.when(F.col("n") % 5 != 0, F.col("name")).alias("description"), F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(n as int)) as timestamp_ntz)").alias("ts"))
    return T.merge_metadata(meta, to).select("topic_id", "merged", F.sha2("description", 256).alias("description_sha256"), F.to_date("ts").alias("first_day"))


def summary_merge(spark, d):
    """Leaf summary items of two languages merged: filled values of the first stay."""
    doc = table(spark, d, "documents")
    key = (F.col("doc_id") % 500).alias("mem_id")
    side = lambda lang: doc.filter(F.col("lang") == lang).groupBy("source", key).agg(F.max(F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise("")).alias("text"))
    return T.merge_items(side("en"), side("fr"), ["source", "mem_id"], "text")


def root_merge(spark, d):
    """Roots named by source in two spellings, documents as their children."""
    doc = table(spark, d, "documents")
    num = F.substring("source", 4, 5).cast("bigint")
    two = F.explode(F.array(F.lit(0), F.lit(50)))
    roots = doc.select("source").distinct().select(num.alias("k"), "source").select("source", "k", two.alias("off")).select((F.col("k") + F.col("off")).alias("topic_id"), F.lit(None).cast("bigint").alias("parent_id"), F.when(F.col("off") == 0, F.col("source")).otherwise(F.concat(F.lit("General "), F.upper("source"), F.lit("s"))).alias("name"))
    kids = doc.select((1000 + F.col("doc_id")).alias("topic_id"), F.when(F.col("doc_id") % 3 == 0, num + 50).otherwise(num).alias("parent_id"), F.lit("d").alias("name"))
    return T.root_survivors(checkpointed(roots.unionByName(kids)))


def problem_roots(spark, d):
    t = _nations(spark, d).withColumn("name", F.when(F.col("topic_id") == 2, "Misc").otherwise(F.col("name")))
    c = table(spark, d, "customer").filter("c_nationkey % 5 in (1, 2, 3)").select((1000 + F.col("c_custkey")).alias("topic_id"), (100 + F.col("c_nationkey")).cast("bigint").alias("parent_id"), F.col("c_name").alias("name"))
    return T.problem_roots(checkpointed(t.unionByName(c)))


def prune_empty(spark, d):
    counts = T.memory_counts(table(spark, d, "orders").filter("o_totalprice > 150000").select((1000 + F.col("o_custkey")).alias("topic_id")))
    return T.prune_empty(_tree(spark, d), counts).select("topic_id")


def _chains(spark, d):
    """Each customer a chain of its key modulo four links below its nation."""
    c = table(spark, d, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int"))).alias("i"))
    node = c.select((10_000 + F.col("c_custkey") * 10 + F.col("i")).alias("topic_id"), F.when(F.col("i") == 0, 1_000_000_000 + F.col("c_custkey") % 25).otherwise(10_000 + F.col("c_custkey") * 10 + F.col("i") - 1).alias("parent_id"), F.concat(F.lit("n"), F.col("i").cast("string")).alias("name"))
    top = c.select((1_000_000_000 + F.col("c_custkey") % 25).alias("topic_id")).distinct().select("topic_id", F.lit(None).cast("bigint").alias("parent_id"), F.lit("top").alias("name"))
    return checkpointed(node.unionByName(top))


def collapse_chains(spark, d):
    topics, redirect = T.collapse_chains(_chains(spark, d))
    folded = redirect.groupBy(F.col("kept").alias("topic_id")).agg(F.count("*").alias("folded"))
    return topics.join(folded, "topic_id", "left").select("topic_id", "parent_id", "name", F.coalesce("folded", F.lit(0)).alias("folded"))


def source_map_purge(spark, d):
    t = _tree(spark, d)
    m = t.filter("parent_id is not null").select(F.when(F.col("topic_id") % 3 == 0, F.col("parent_id") + 1).otherwise(F.col("parent_id")).alias("parent_id"), F.col("topic_id").alias("child_id"), F.col("name").alias("text"))
    return T.purge_source_map(m, t).select("parent_id", "child_id", "text")


def reorg_trigger(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", "n", T.reorg_due(F.col("n") - 30, F.col("n")).alias("due"))


def apply_changes(spark, d):
    """A fixed change-set over regions and nations: rename, merge, move, new category, a cycle that is refused."""
    changes = [{"id": 0, "name": "Africa"}, {"id": 101, "merged_into_id": 102}, {"id": 103, "parent_id": "NEW_oldWorld"}, {"id": 1, "parent_id": 100}, {"id": 2, "parent_id": 107}, {"id": 999, "name": "no such"}]
    topics, _ = T.apply_changes(_nations(spark, d), changes)
    return topics


QUERIES = {f.__name__: f for f in (
    tree_paths, tree_leaves, topic_counts, tree_render, cluster_tree_text, descendants, cycle_moves, normalize_names, resolve_paths, leaf_constraint, sibling_dedup, metadata_merge, summary_merge,
    root_merge, problem_roots, prune_empty, collapse_chains, source_map_purge, reorg_trigger, apply_changes,
)}

_NAT = "nat AS (SELECT r_regionkey::BIGINT AS topic_id, NULL::BIGINT AS parent_id, r_name AS name FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation)"
_T = _NAT + ", t AS (SELECT * FROM nat UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, c_name FROM customer)"
_UP = "up AS (SELECT topic_id AS ancestor, topic_id AS descendant, 0::BIGINT AS distance FROM t UNION ALL SELECT t.parent_id, u.descendant, u.distance + 1 FROM up u JOIN t ON t.topic_id = u.ancestor WHERE t.parent_id IS NOT NULL)"


def _norm(x: str) -> str:
    a = f"trim(lower({x}))"
    b = f"regexp_replace(trim(CASE WHEN starts_with({a}, 'general ') THEN substring({a}, 9) ELSE {a} END), '\\s+', ' ', 'g')"
    return f"CASE WHEN {b} LIKE '%ies' THEN left({b}, length({b}) - 3) || 'y' WHEN {b} LIKE '%s' AND {b} NOT LIKE '%ss' THEN left({b}, length({b}) - 1) ELSE {b} END"


_BRANDS = "b AS (SELECT 1000 + p_partkey AS topic_id, substring(p_brand, 7, 5)::BIGINT AS parent_id, CASE WHEN p_partkey % 2 = 0 THEN upper(left(p_type, 1)) || lower(substring(p_type, 2)) ELSE 'General ' || lower(p_type) || 's' END AS name, p_size::BIGINT AS n FROM part)"
_SURV = f"{_BRANDS}, s AS (SELECT *, first_value(topic_id) OVER (PARTITION BY parent_id, {_norm('name')} ORDER BY n DESC, topic_id) AS survivor FROM b)"
_RENDER = """w AS (SELECT topic_id, name, 0 AS level, lpad(topic_id::VARCHAR, 12, '0') AS k, topic_id AS root FROM x WHERE parent_id IS NULL UNION ALL SELECT x.topic_id, x.name, w.level + 1, w.k || '/' || lpad(x.topic_id::VARCHAR, 12, '0'), w.root FROM w JOIN x ON x.parent_id = w.topic_id),
  ch AS (SELECT parent_id AS topic_id, count(*) AS children FROM x WHERE parent_id IS NOT NULL GROUP BY 1)"""
_LINE = "string_agg(repeat(chr(9), level) || name || CASE WHEN children > 0 THEN ' [children:' || children || ']' ELSE ' [memories:' || coalesce(n, 0) || ']' END, chr(10) ORDER BY k)"
ORACLE_SQL = {
    "tree_paths": f"WITH RECURSIVE {_T}, w AS (SELECT topic_id, name AS path, 0::BIGINT AS level FROM t WHERE parent_id IS NULL UNION ALL SELECT t.topic_id, w.path || ' > ' || t.name, w.level + 1 FROM w JOIN t ON t.parent_id = w.topic_id) SELECT topic_id, path, level FROM w",
    "apply_changes": f"""WITH RECURSIVE {_NAT}, t AS (SELECT * FROM nat), {_UP}, mv AS (SELECT * FROM (VALUES (1, 100), (2, 107)) AS v(a, p) WHERE NOT EXISTS (SELECT 1 FROM up WHERE ancestor = a AND descendant = p)), top AS (SELECT max(topic_id) + 1 AS made FROM nat)
      SELECT topic_id, CASE WHEN topic_id = 103 THEN made WHEN topic_id IN (SELECT a FROM mv) THEN (SELECT p FROM mv WHERE a = topic_id) WHEN parent_id = 101 THEN 102 ELSE parent_id END AS parent_id, CASE WHEN topic_id = 0 THEN 'Africa' ELSE name END AS name FROM nat, top WHERE topic_id <> 101
      UNION ALL SELECT made, NULL, 'Old World' FROM top""",
    "tree_leaves": f"WITH {_T} SELECT topic_id FROM t WHERE topic_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)",
    "topic_counts": "SELECT 1000 + o_custkey AS topic_id, count(*) AS n FROM orders GROUP BY 1",
    "tree_render": f"WITH RECURSIVE {_NAT}, x AS (SELECT * FROM nat), {_RENDER}, c AS (SELECT 100 + c_nationkey AS topic_id, count(*) AS n FROM customer GROUP BY 1) SELECT root, {_LINE} AS tree FROM w LEFT JOIN ch USING (topic_id) LEFT JOIN c USING (topic_id) GROUP BY root",
    "cluster_tree_text": f"WITH RECURSIVE {_NAT}, x AS (SELECT * FROM nat WHERE topic_id < 100 OR topic_id % 2 = 0), {_RENDER}, c AS (SELECT NULL::BIGINT AS topic_id, NULL::BIGINT AS n), o AS (SELECT root, {_LINE} AS tree FROM w LEFT JOIN ch USING (topic_id) LEFT JOIN c USING (topic_id) GROUP BY root) SELECT root, length(tree) AS chars, length(tree) // 4 AS tokens FROM o",
    "descendants": f"WITH RECURSIVE {_T}, {_UP} SELECT ancestor AS topic_id, count(*) AS size, max(distance) AS height FROM up GROUP BY 1",
    "cycle_moves": f"WITH RECURSIVE {_T}, {_UP}, m AS (SELECT parent_id AS topic_id, topic_id AS new_parent FROM t WHERE topic_id >= 1000 AND topic_id % 7 = 0 UNION ALL SELECT topic_id, 0 FROM t WHERE topic_id >= 1000 AND topic_id % 7 = 1) SELECT m.* FROM m WHERE EXISTS (SELECT 1 FROM up WHERE ancestor = m.topic_id AND descendant = m.new_parent)",
    "normalize_names": f"WITH n AS (SELECT p_type || '  ' || p_name AS name FROM part UNION ALL SELECT 'General ' || n_name || ' Countries' FROM nation) SELECT {_norm('name')} AS normalized, count(*) AS n FROM n GROUP BY 1",
    # a brand's, a type's and a size's smallest spelling name the topics; sizes of a type are leaves
    "resolve_paths": "SELECT p_brand || ' > ' || p_type || ' > size' || p_size AS path, count(*) AS parts FROM part GROUP BY 1",
    "leaf_constraint": f"WITH {_NAT}, s AS (SELECT topic_id, name, row_number() OVER (ORDER BY topic_id) + 9999 AS leaf FROM nat WHERE parent_id IS NULL AND topic_id % 2 = 0 AND topic_id < 5 AND topic_id IN (SELECT parent_id FROM nat)) SELECT topic_id, parent_id, name, topic_id IN (SELECT topic_id FROM s) AS was_split FROM nat UNION ALL SELECT leaf, topic_id, 'General ' || name, false FROM s",
    "sibling_dedup": f"WITH {_SURV} SELECT topic_id, survivor FROM s",
    "metadata_merge": f"WITH {_SURV} SELECT survivor AS topic_id, count(*) AS merged, sha256(coalesce(string_agg(CASE WHEN n % 5 <> 0 THEN name END, chr(10) || '[Merged source]' || chr(10) ORDER BY topic_id <> survivor, topic_id), '')) AS description_sha256, DATE '2024-01-01' + min(n)::INT AS first_day FROM s GROUP BY 1",
    "summary_merge": "WITH i AS (SELECT lang, source, doc_id % 500 AS mem_id, max(CASE WHEN doc_id % 3 <> 0 THEN text ELSE '' END) AS text FROM documents WHERE lang IN ('en','fr') GROUP BY 1, 2, 3) SELECT source, mem_id, coalesce(nullif(e.text, ''), f.text, e.text) AS text FROM (SELECT * FROM i WHERE lang = 'en') e FULL JOIN (SELECT * FROM i WHERE lang = 'fr') f USING (source, mem_id)",
    "root_merge": """WITH k AS (SELECT DISTINCT substring(source, 4)::BIGINT AS k FROM documents), r AS (SELECT k AS topic_id, k FROM k UNION ALL SELECT k + 50, k FROM k),
      c AS (SELECT CASE WHEN doc_id % 3 = 0 THEN substring(source, 4)::BIGINT + 50 ELSE substring(source, 4)::BIGINT END AS topic_id, count(*) AS n FROM documents GROUP BY 1),
      z AS (SELECT r.topic_id, k, 1 + coalesce(n, 0) AS size FROM r LEFT JOIN c USING (topic_id)) SELECT topic_id, first_value(topic_id) OVER (PARTITION BY k ORDER BY size DESC, topic_id) AS survivor, size FROM z""",
    "problem_roots": f"WITH {_NAT}, c AS (SELECT n_regionkey AS topic_id, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 5 IN (1, 2, 3) GROUP BY 1), k AS (SELECT parent_id AS topic_id, count(*) AS kids FROM nat WHERE parent_id IS NOT NULL GROUP BY 1), z AS (SELECT n.topic_id, CASE WHEN n.topic_id = 2 THEN 'Misc' ELSE name END AS name, 1 + coalesce(kids, 0) + coalesce(c.n, 0) AS size FROM nat n LEFT JOIN c USING (topic_id) LEFT JOIN k USING (topic_id) WHERE parent_id IS NULL) SELECT topic_id, name, size FROM z WHERE lower(name) IN ('root','general','misc','other','miscellaneous') OR size <= 13",
    "prune_empty": f"WITH RECURSIVE {_T}, {_UP}, live AS (SELECT DISTINCT 1000 + o_custkey AS topic_id FROM orders WHERE o_totalprice > 150000) SELECT DISTINCT ancestor AS topic_id FROM up WHERE descendant IN (SELECT topic_id FROM live)",
    "collapse_chains": "SELECT 10000 + c_custkey * 10 AS topic_id, 1000000000 + c_custkey % 25 AS parent_id, 'n' || (c_custkey % 4) AS name, c_custkey % 4 AS folded FROM customer UNION ALL SELECT DISTINCT 1000000000 + c_custkey % 25, NULL, 'top', 0 FROM customer",
    "source_map_purge": f"WITH {_T} SELECT parent_id, topic_id AS child_id, name AS text FROM t WHERE parent_id IS NOT NULL AND topic_id % 3 <> 0",
    "reorg_trigger": "SELECT user_id, count(*) AS n, count(*) // 60 > (CASE WHEN count(*) < 30 THEN -1 ELSE (count(*) - 30) // 60 END) AS due FROM events GROUP BY 1",
}
