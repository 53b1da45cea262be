"""What the registered queries share: tables, the search pool over the given tables, and SQL for the oracle of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import index as I

#: The words of the fixed search query.
TERMS = ("the", "token", "clown", "mentir", "auch", "para")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def term_rows(spark: SparkSession, terms=TERMS) -> DataFrame:
    return spark.sql("SELECT explode(:terms) AS family", args={"terms": F.array(*map(F.lit, terms))})


def kind(label):
    """The memory type that stands for an embedding's label."""
    return F.element_at(F.array(*map(F.lit, ("episodic", "knowledge", "user", "decision"))), (label % 4 + 1).cast("int"))


def status(label):
    return F.element_at(F.array(*map(F.lit, ("active", "conditional", "superseded"))), (label % 3 + 1).cast("int"))


def memories(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vector, as memories: type, status and topic by label, language and source."""
    doc, e = table(spark, d, "documents"), table(spark, d, "embeddings")
    return doc.join(e, doc["doc_id"] == e["vec_id"]).select(
        F.col("doc_id").alias("id"), kind(F.col("label")).alias("memory_type"), F.col("text").alias("content"), status(F.col("label")).alias("status"),
        F.concat_ws(" > ", "lang", "source").alias("topic_id"), "embedding", "label", "lang", "source",
    )


def pool(spark: SparkSession, d: str) -> DataFrame:
    """entry_id, entry_key, memory_type, status, path, content, text, embedding."""
    m = memories(spark, d)
    paths = m.select("topic_id").distinct().select("topic_id", F.col("topic_id").alias("path"))
    return I.build_pool(m, paths).select(F.col("id").alias("entry_id"), "entry_key", "memory_type", "status", "path", "content", "text", "embedding", "label")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """The pool with bm25 of TERMS and cosine to the vector of embedding 0; rows without a term score 0."""
    p = pool(spark, d)
    toks = I.tokens(p)
    stats = I.doc_stats(toks)
    b = I.bm25(I.postings(toks), stats, I.corpus(stats, p), term_rows(spark))
    q = table(spark, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))
    v = p.select("entry_id", "memory_type", "status", "path", "content", "embedding").crossJoin(F.broadcast(q))  # one query row
    v = v.withColumn("cosine", F.round(X.dot(F.col("embedding"), F.col("q")), 9)).drop("embedding", "q")
    return v.join(b, "entry_id", "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 9))


_TERMS = ", ".join(f"('{t}')" for t in TERMS)
#: CTEs of the pool and of its scores; a query continues with its own SELECT.
MEM_SQL = """
mem AS (SELECT d.doc_id AS id, ['episodic','knowledge','user','decision'][e.label % 4 + 1] AS memory_type, d.text AS content, ['active','conditional','superseded'][e.label % 3 + 1] AS status,
  d.lang || ' > ' || d.source AS path, e.embedding, e.label, d.lang, d.source FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"""
POOL_SQL = MEM_SQL + """,
pool AS (SELECT id AS entry_id, 'mem:' || memory_type || ':' || id AS entry_key, memory_type, status, path, content, path || ' ' || content AS text, embedding, label
  FROM mem WHERE content IS NOT NULL AND content <> '' AND (memory_type <> 'decision' OR status IN ('active','conditional')))"""
BM25_SQL = """,
tok AS (SELECT entry_id, t FROM (SELECT entry_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM pool) WHERE t <> ''),
dl AS (SELECT entry_id, count(*) AS dl FROM tok GROUP BY 1),
corp AS (SELECT (SELECT count(*) FROM pool) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / greatest((SELECT count(*) FROM pool), 1) AS avg_dl),
post AS (SELECT t, entry_id, count(*) AS tf FROM tok GROUP BY 1, 2),
hit AS (SELECT p.*, count(*) OVER (PARTITION BY t) AS df FROM post p WHERE t IN (SELECT col0 FROM (VALUES """ + _TERMS + """))),
bm AS (SELECT h.entry_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))) AS bm25 FROM hit h JOIN dl USING (entry_id), corp GROUP BY 1)"""
SCORED_SQL = POOL_SQL + BM25_SQL + """,
scored AS (SELECT p.entry_id, p.memory_type, p.status, p.path, p.content, round(list_dot_product(p.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS cosine, round(coalesce(bm25, 0), 9) AS bm25
  FROM pool p LEFT JOIN bm USING (entry_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(cosine, 9) DESC, entry_id) AS rank_vec, row_number() OVER (ORDER BY round(bm25, 9) DESC, entry_id) AS rank_bm25 FROM scored),
fused AS (SELECT *, round(0.7::DOUBLE / (60 + rank_vec) + 0.3::DOUBLE / (60 + rank_bm25), 9) AS rrf FROM ranked)"""
TYPE_SQL = SCORED_SQL + """,
typed AS (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY rrf DESC, entry_id) AS type_rank FROM fused),
topk AS (SELECT * FROM typed WHERE type_rank <= CASE memory_type WHEN 'episodic' THEN 40 WHEN 'knowledge' THEN 40 WHEN 'user' THEN 30 WHEN 'decision' THEN 30 ELSE 0 END)"""
QUOTA_SQL = TYPE_SQL + """,
tiered AS (SELECT *, CASE WHEN memory_type = 'decision' AND type_rank <= 3 THEN 0 WHEN (CASE WHEN memory_type = 'decision' THEN type_rank - 3 ELSE type_rank END) <= (CASE memory_type WHEN 'user' THEN 8 ELSE 5 END) THEN 1 ELSE 2 END AS tier FROM topk),
placed AS (SELECT *, row_number() OVER (PARTITION BY tier > 0 ORDER BY tier, rrf DESC, entry_id) AS place FROM tiered),
hits AS (SELECT * FROM placed WHERE tier = 0 OR place <= 30)"""
EXPAND_SQL = QUOTA_SQL + """,
anchors AS (SELECT entry_id AS anchor_id, place AS anchor_rank, content FROM hits WHERE tier = 0),
aq AS (SELECT anchor_id, t, count(*) AS qn FROM (SELECT anchor_id, unnest(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+')) AS t FROM anchors) WHERE t <> '' GROUP BY 1, 2),
adf AS (SELECT t, count(*) AS df FROM post GROUP BY 1),
asc_ AS (SELECT anchor_id, p.entry_id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS bm25
  FROM aq JOIN post p USING (t) JOIN adf USING (t) JOIN dl USING (entry_id), corp GROUP BY 1, 2),
cand AS (SELECT a.*, f.rrf FROM asc_ a JOIN fused f USING (entry_id) WHERE f.memory_type IN ('knowledge','episodic') AND a.bm25 >= 0.5),
xr AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY round(bm25, 9) DESC, entry_id) AS x_rank FROM cand),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY rrf DESC, entry_id) AS kept FROM xr WHERE x_rank <= 20) WHERE kept <= 5)"""
