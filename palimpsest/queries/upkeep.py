"""Clustering, decision, repair and summary queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import cluster as C
from palimpsest.operators import decisions as D
from palimpsest.operators import summaries as S

from .shared import MEM_SQL, kind, memories, status, table
from .topics import _T, _UP, _tree


def knn_graph(spark, d):
    return C.knn(table(spark, d, "embeddings")).select("vec_id", "other", F.round("sim", 6).alias("sim"), "rank")


def centroids(spark, d):
    c = C.centroids(table(spark, d, "embeddings"), "label")
    return c.select(F.col("label").cast("bigint").alias("label"), F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    c = C.centroids(e.filter("label < 5"), "label").withColumnRenamed("label", "target")
    return C.nearest(e.filter("label >= 5"), c, "vec_id", "embedding", "target", "centroid").select("vec_id", F.col("target").cast("bigint").alias("target"), F.round("sim", 6).alias("sim"))


def split_overloaded(spark, d):
    e = table(spark, d, "embeddings").withColumn("topic", F.col("label") % 4)
    return C.split_overloaded(e)


def communities(spark, d):
    e = table(spark, d, "embeddings").withColumn("user_id", F.lit("default"))
    return C.communities(e, target=60, largest=120)


def _decisions(spark, d):
    e = table(spark, d, "embeddings").filter("label % 2 = 1")
    return e.select(F.concat(F.lit("u"), (F.col("vec_id") % 5).cast("string")).alias("user_id"), F.col("vec_id").alias("id"), "embedding", F.when(F.col("vec_id") % 3 == 0, "c").alias("context"), F.lit(None).cast("timestamp_ntz").alias("last_validated_at"), status(F.col("label")).alias("status"), "label")


def decision_clusters(spark, d):
    dec = D.live(_decisions(spark, d))
    c = C.decision_clusters(dec, similarity=0.3)
    return D.to_analyse(dec.join(c, ["user_id", "id"])).select("user_id", "id", F.col("cluster").cast("bigint").alias("cluster"))


def decision_status(spark, d):
    dec = _decisions(spark, d).withColumn("cluster", F.col("label")).withColumn("ts", F.col("id") % 17)
    return D.apply_verdicts(dec, D.newest_wins(dec)).groupBy("user_id", "status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def _memories(spark, d):
    """Vectors as memories in messages of four; those of a number divisible by five have lost their topic."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 != 0, F.floor(F.col("vec_id") / 4)).cast("bigint").alias("message_id"), F.when(F.col("vec_id") % 5 != 0, F.col("label").cast("bigint")).alias("topic_id"), F.when(F.col("vec_id") % 35 != 0, F.col("embedding")).alias("embedding"))


def detached_rows(spark, d):
    return D.detached(_memories(spark, d)).select("id", "message_id")


def _repaired(spark, d, how):
    topics = C.centroids(table(spark, d, "embeddings"), "label").select(F.col("label").cast("bigint").alias("topic_id"), F.col("centroid").alias("embedding"))
    return D.repair(_memories(spark, d), topics).filter(F.col("how") == how).select("id", "topic_id", F.round("sim", 6).alias("sim"))


def repair_sibling(spark, d):
    return _repaired(spark, d, "sibling")


def repair_topic(spark, d):
    return _repaired(spark, d, "topic")


def route_top_paths(spark, d):
    """The best leaves for three parts of a text: top four of each, ordered by their best rank."""
    e = table(spark, d, "embeddings")
    leaves = e.filter("vec_id >= 3").select("vec_id", "embedding", F.concat(F.lit("leaf"), (F.col("vec_id") % 97).cast("string")).alias("path"))
    parts = e.filter("vec_id < 3").select(F.col("vec_id").alias("part"), F.col("embedding").alias("q"))  # the parts of one text
    s = leaves.crossJoin(F.broadcast(parts)).withColumn("sim", F.round(X.dot(F.col("embedding"), F.col("q")), 9))
    from pyspark.sql import Window

    r = s.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("sim"), "vec_id")).cast("bigint")).filter("r <= 4")
    return r.groupBy("path").agg(F.min(F.col("part") * 4 + F.col("r")).alias("place")).orderBy("place").limit(12)


def stale_leaves(spark, d):
    """Leaves (event types) of which a quarter of all events or more came after the leaf was embedded."""
    e = table(spark, d, "events")
    n = F.count_if(F.col("ts") > F.expr("timestamp_ntz'2024-01-22 00:00:00'"))
    return e.groupBy("event_type", (F.col("user_id") % 20).alias("bucket")).agg(F.count("*").alias("n"), n.alias("newer")).withColumn("stale", F.col("newer") / F.col("n") >= 0.25)


def _events(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("topic_id"), kind(F.col("user_id") % 4).alias("memory_type"), F.concat("event_type", F.lit(" "), F.col("value").cast("decimal(12,2)").cast("string")).alias("content"), "ts",
        status(F.col("event_id") % 3).alias("status"), F.when(F.col("event_id") % 2 == 0, F.lit("why")).alias("context"), F.when(F.col("event_id") % 7 == 0, F.col("ts")).alias("last_validated_at"),
    )


def leaf_summary(spark, d):
    return S.format_leaf(S.leaf_items(_events(spark, d))).select("topic_id", "items", F.sha2("text", 256).alias("text_sha256"))


def summary_delta(spark, d):
    items = S.leaf_items(_events(spark, d))
    stored = items.filter("mem_id % 3 <> 0").withColumn("text", F.when(F.col("mem_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    delta = S.leaf_delta(items, stored)
    return delta.groupBy("topic_id").agg(F.count("*").alias("changed"), F.count_if(F.col("kind") == "decision").alias("decisions"))


def leaf_routing(spark, d):
    e = _events(spark, d).groupBy("topic_id").agg(F.count("*").alias("n"))
    mode = S.route_leaf(F.col("n") - 200, F.col("topic_id") % 3 != 0, F.col("topic_id") % 5 == 0, (F.col("topic_id") % 12).cast("int"), F.col("topic_id") % 2 == 0)
    st = e.select("topic_id", "n", mode.alias("mode"))
    answers = st.filter("mode <> 'none'").select("topic_id", F.when(F.col("topic_id") % 4 != 0, F.concat(F.lit("d"), F.col("topic_id").cast("string"))).alias("new"), "mode")
    state = st.select("topic_id", F.lit("old").alias("description"), (F.col("topic_id") % 12).cast("int").alias("updates"))
    return S.write_back(state, answers).join(st, "topic_id").select("topic_id", "n", "mode", "description", F.col("updates").cast("bigint").alias("updates"))


def parent_delta(spark, d):
    c = table(spark, d, "customer")
    kids = c.select(F.col("c_nationkey").cast("bigint").alias("parent_id"), F.col("c_custkey").alias("child_id"), F.when(F.col("c_custkey") % 11 != 0, F.concat("c_name", F.when(F.col("c_custkey") % 2 == 0, F.repeat("c_mktsegment", F.lit(9))).otherwise(""))).alias("description"), (F.col("c_custkey") % 10).alias("ts"))
    m = kids.filter("child_id % 3 > 0").select("parent_id", "child_id", F.when(F.col("child_id") % 3 == 1, "source").otherwise("ignored").alias("state"))
    parents = kids.select("parent_id").distinct().select("parent_id", (F.col("parent_id") % 10).alias("ts"))
    return S.child_delta(kids, m, parents).groupBy("parent_id", "state").agg(F.count("*").alias("n"), F.min("child_id").alias("first_child"))


def source_map_patch(spark, d):
    c = table(spark, d, "customer")
    cur = c.filter("c_custkey % 2 = 0").select(F.col("c_nationkey").cast("bigint").alias("parent_id"), F.col("c_custkey").alias("child_id"), F.col("c_name").alias("text"), F.lit("source").alias("state"))
    patch = c.filter("c_custkey % 3 = 0").select(F.col("c_nationkey").cast("bigint").alias("parent_id"), F.col("c_custkey").alias("child_id"), F.when(F.col("c_custkey") % 9 == 0, "remove").otherwise("modify").alias("action"), F.concat(F.lit("new "), "c_name").alias("new_text"))
    offered = c.filter("c_custkey % 5 = 0").select(F.col("c_nationkey").cast("bigint").alias("parent_id"), F.col("c_custkey").alias("child_id"))
    return S.patch_source_map(cur, patch, offered).select("parent_id", "child_id", "text", "state")


def parent_descriptions(spark, d):
    m = source_map_patch(spark, d)
    return S.describe(m).select("parent_id", F.sha2("description", 256).alias("description_sha256"))


def single_child(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") * 100 + F.col("p_partkey") % 61).cast("bigint").alias("parent_id"), F.col("p_name").alias("description"))
    return S.inherit_single(p)


def hierarchical_rollup(spark, d):
    own = table(spark, d, "orders").groupBy((1000 + F.col("o_custkey")).alias("topic_id")).agg(F.count("*").alias("value"))
    return S.roll_up(_tree(spark, d), own)


def batch_packing(spark, d):
    """Centroids of labels packed by a budget of members; the centroids are ten."""
    e = table(spark, d, "embeddings")
    rows = C.centroids(e, "label").join(e.groupBy("label").agg(F.count("*").alias("n")), "label").orderBy("label").collect()
    packs = C.pack_batches(np.array([r.centroid for r in rows]), np.array([r.n for r in rows]), int(sum(r.n for r in rows) // 3))
    return spark.createDataFrame([(b, int(rows[c].label), int(rows[c].n)) for b, p in enumerate(packs) for c in p], "batch int, label int, members int")


def forget_reset(spark, d):
    """Memories after one of every seven was forgotten and a user was reset."""
    m = memories(spark, d).withColumn("user_id", F.col("lang"))
    left = m.filter("user_id <> 'es'").join(m.filter("id % 7 = 0").select("id"), "id", "left_anti")
    return left.groupBy("user_id", "memory_type").agg(F.count("*").alias("n"))


def fill_missing_vectors(spark, d):
    """Vectors of documents without one, by the default embedder: a hashed bag of words at length one."""
    from palimpsest.models import hashed_embeddings

    doc, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    v = hashed_embeddings(doc.join(e, doc["doc_id"] == e["vec_id"], "left_anti"), "doc_id", dims=64)
    return v.select("doc_id", F.size("embedding").alias("dims"), F.round(X.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


QUERIES = {f.__name__: f for f in (
    knn_graph, centroids, nearest_centroid, split_overloaded, communities, decision_clusters, decision_status, detached_rows, repair_sibling, repair_topic, route_top_paths, stale_leaves, leaf_summary,
    summary_delta, leaf_routing, parent_delta, source_map_patch, parent_descriptions, single_child, hierarchical_rollup, batch_packing, forget_reset, fill_missing_vectors,
)}

_CENT = """ce AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2),
 cn AS (SELECT label, sqrt(sum(x * x)) AS n FROM ce GROUP BY 1), cv AS (SELECT label, list(x / n ORDER BY pos) AS v FROM ce JOIN cn USING (label) GROUP BY 1)"""
_COS = "round(list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) / sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[])), 9)"
_MEMV = "m AS (SELECT vec_id AS id, CASE WHEN vec_id % 10 <> 0 THEN vec_id // 4 END AS message_id, CASE WHEN vec_id % 5 <> 0 THEN label END AS topic_id, CASE WHEN vec_id % 35 <> 0 THEN embedding END AS v FROM embeddings), lost AS (SELECT * FROM m WHERE topic_id IS NULL AND v IS NOT NULL), sib AS (SELECT * FROM (SELECT l.id, k.topic_id, " + _COS.format("l.v", "k.v") + " AS sim, row_number() OVER (PARTITION BY l.id ORDER BY " + _COS.format("l.v", "k.v") + " DESC, k.id) AS r FROM lost l JOIN m k ON k.message_id = l.message_id AND k.topic_id IS NOT NULL AND k.v IS NOT NULL) WHERE r = 1)"
_EV = """ev AS (SELECT event_id AS id, user_id % 40 AS topic_id, ['episodic','knowledge','user','decision'][user_id % 4 + 1] AS memory_type, event_type || ' ' || value::DECIMAL(12,2)::VARCHAR AS content, ts, ['active','conditional','superseded'][event_id % 3 + 1] AS status, CASE WHEN event_id % 2 = 0 THEN 'why' END AS context, CASE WHEN event_id % 7 = 0 THEN ts END AS lv FROM events),
 it AS (SELECT topic_id, CASE WHEN memory_type = 'decision' THEN 'decision' ELSE 'memory' END AS kind, strftime(ts, '%Y-%m-%d %H:%M') AS minute, id AS mem_id, CASE WHEN memory_type = 'decision' THEN '[Decision:' || status || '] ' || content || CASE WHEN context IS NOT NULL THEN ' | Context: ' || context ELSE '' END || CASE WHEN lv IS NOT NULL THEN ' | Last validated: ' || strftime(lv, '%Y-%m-%d') ELSE '' END
   ELSE '[' || upper(left(memory_type, 1)) || substring(memory_type, 2) || '] ' || content END AS text FROM ev)"""
_PATCH = """cur AS (SELECT c_nationkey::BIGINT AS parent_id, c_custkey AS child_id, c_name, c_custkey % 2 = 0 AS c, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 9 = 0 THEN 'remove' ELSE 'modify' END END AS action, c_custkey % 5 = 0 AS o FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0),
 p AS (SELECT *, CASE WHEN action = 'modify' THEN 'source' WHEN action = 'remove' THEN 'ignored' WHEN NOT c AND o THEN 'ignored' WHEN c THEN 'source' END AS state FROM cur),
 pm AS (SELECT parent_id, child_id, CASE WHEN action = 'modify' THEN 'new ' || c_name WHEN state = 'source' THEN c_name END AS text, state FROM p)"""
ORACLE_SQL = {
    "knn_graph": f"WITH s AS (SELECT a.vec_id, b.vec_id AS other, {_COS.format('a.embedding', 'b.embedding')} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM s) SELECT vec_id, other, round(sim, 6) AS sim, rank FROM r WHERE rank <= 15",
    "centroids": f"WITH {_CENT} SELECT label::BIGINT AS label, pos, round(x / n, 6) AS x FROM ce JOIN cn USING (label)",
    "nearest_centroid": f"WITH {_CENT}, s AS (SELECT e.vec_id, cv.label AS target, {_COS.format('e.embedding', 'cv.v')} AS sim FROM embeddings e, cv WHERE e.label >= 5 AND cv.label < 5) SELECT vec_id, target::BIGINT AS target, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, target) AS r FROM s) WHERE r = 1",
    "decision_status": "WITH e AS (SELECT 'u' || (vec_id % 5) AS user_id, vec_id AS id, row_number() OVER (PARTITION BY vec_id % 5, label ORDER BY vec_id % 17 DESC, vec_id DESC) AS r FROM embeddings WHERE label % 2 = 1) SELECT user_id, CASE WHEN r = 1 THEN 'active' ELSE 'superseded' END AS status, count(*) AS n, min(id) AS first_id FROM e GROUP BY 1, 2",
    "detached_rows": f"WITH {_MEMV} SELECT id, message_id FROM lost",
    "repair_sibling": f"WITH {_MEMV} SELECT id, topic_id, round(sim, 6) AS sim FROM sib",
    "repair_topic": f"WITH {_MEMV}, {_CENT}, s AS (SELECT l.id, cv.label AS topic_id, {_COS.format('l.v', 'cv.v')} AS sim FROM lost l, cv WHERE l.id NOT IN (SELECT id FROM sib)) SELECT id, topic_id::BIGINT AS topic_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, topic_id) AS r FROM s) WHERE r = 1",
    "route_top_paths": "WITH s AS (SELECT 'leaf' || (e.vec_id % 97) AS path, p.vec_id AS part, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS sim FROM embeddings e, embeddings p WHERE e.vec_id >= 3 AND p.vec_id < 3), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY sim DESC, vec_id) AS r FROM s) SELECT path, min(part * 4 + r) AS place FROM r WHERE r <= 4 GROUP BY 1 ORDER BY 2 LIMIT 12",
    "stale_leaves": "SELECT event_type, user_id % 20 AS bucket, count(*) AS n, count_if(ts > TIMESTAMP '2024-01-22 00:00:00') AS newer, count_if(ts > TIMESTAMP '2024-01-22 00:00:00') / count(*) >= 0.25 AS stale FROM events GROUP BY 1, 2",
    "leaf_summary": f"WITH {_EV} SELECT topic_id, count(*) AS items, sha256(string_agg(minute || ' ' || text, chr(10) ORDER BY kind DESC, minute DESC, mem_id)) AS text_sha256 FROM it GROUP BY 1",
    "summary_delta": f"WITH {_EV} SELECT topic_id, count(*) AS changed, count_if(kind = 'decision') AS decisions FROM it WHERE mem_id % 3 = 0 OR (kind = 'decision' AND mem_id % 5 = 0) GROUP BY 1",
    "leaf_routing": "WITH e AS (SELECT user_id % 40 AS topic_id, count(*) AS n FROM events GROUP BY 1), m AS (SELECT *, CASE WHEN n - 200 <= 50 THEN 'none' WHEN topic_id % 3 = 0 THEN 'create' WHEN topic_id % 12 >= 10 THEN 'rebuild' WHEN topic_id % 2 = 0 OR topic_id % 5 = 0 THEN 'update' ELSE 'none' END AS mode FROM e) SELECT topic_id, n, mode, CASE WHEN mode <> 'none' AND topic_id % 4 <> 0 THEN 'd' || topic_id ELSE 'old' END AS description, CASE WHEN mode <> 'none' AND topic_id % 4 <> 0 THEN CASE WHEN mode = 'update' THEN topic_id % 12 + 1 ELSE 0 END ELSE topic_id % 12 END AS updates FROM m",
    "parent_delta": "WITH k AS (SELECT c_nationkey::BIGINT AS parent_id, c_custkey AS child_id, CASE WHEN c_custkey % 11 <> 0 THEN c_name || CASE WHEN c_custkey % 2 = 0 THEN repeat(c_mktsegment, 9) ELSE '' END END AS t, ['NEW','EXISTING_SOURCE','IGNORED'][c_custkey % 3 + 1] AS state FROM customer) SELECT parent_id, state, count(*) AS n, min(child_id) AS first_child FROM k WHERE (state = 'NEW' OR child_id % 10 > parent_id % 10) AND coalesce(t, '') <> '' AND NOT (state = 'IGNORED' AND length(t) < 60) GROUP BY 1, 2",
    "source_map_patch": f"WITH {_PATCH} SELECT parent_id, child_id, text, state FROM pm",
    "parent_descriptions": f"WITH {_PATCH} SELECT parent_id, sha256(string_agg(text, chr(10) ORDER BY child_id)) AS description_sha256 FROM pm WHERE state = 'source' GROUP BY 1",
    "single_child": "SELECT (p_size * 100 + p_partkey % 61)::BIGINT AS parent_id, max(p_name) AS description FROM part GROUP BY 1 HAVING count(*) = 1",
    "hierarchical_rollup": f"WITH RECURSIVE {_T}, {_UP}, o AS (SELECT 1000 + o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT ancestor AS topic_id, CASE WHEN ancestor < 100 THEN 0 WHEN ancestor < 1000 THEN 1 ELSE 2 END::BIGINT AS level, coalesce(sum(n), 0)::BIGINT AS total, CASE WHEN ancestor < 100 THEN 'high' WHEN ancestor < 1000 THEN 'mid' ELSE 'near_leaf' END AS tier FROM up LEFT JOIN o ON o.k = descendant GROUP BY ancestor",
    "fill_missing_vectors": r"SELECT doc_id, 64 AS dims, CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "forget_reset": f"WITH {MEM_SQL} SELECT lang AS user_id, memory_type, count(*) AS n FROM mem WHERE lang <> 'es' AND id % 7 <> 0 GROUP BY 1, 2",
}
