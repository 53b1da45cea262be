"""Index and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import index as I
from palimpsest.operators import retrieval as R

from .shared import EXPAND_SQL, POOL_SQL, QUOTA_SQL, SCORED_SQL, TERMS, TYPE_SQL, memories, pool, scored, table, term_rows

_TOK = "tok AS (SELECT doc_id, t FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS t FROM documents) WHERE t <> '')"
_LEMMA = """CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 5 AND t LIKE '%sses' THEN left(t, length(t) - 2)
  WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%ed' THEN left(t, length(t) - 2)
  WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"""
_LIST = "', '".join(TERMS)


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("entry_id"), "text")


def pool_build(spark, d):
    return pool(spark, d).select("entry_id", "entry_key", "memory_type", "path", F.length("text").cast("bigint").alias("text_length"))


def tokenize_stats(spark, d):
    return I.doc_stats(I.tokens(_docs(spark, d))).select(F.col("entry_id").alias("doc_id"), "dl")


def inverted_index(spark, d):
    return I.postings(I.tokens(_docs(spark, d))).groupBy("family").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("entry_id").alias("first_doc"))


def bm25_idf(spark, d):
    docs = _docs(spark, d)
    toks = I.tokens(docs)
    return I.terms(I.postings(toks), I.corpus(I.doc_stats(toks), docs)).select("family", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, d, fam=None, query=None):
    docs = _docs(spark, d)
    toks = I.tokens(docs)
    stats = I.doc_stats(toks)
    return I.bm25(I.postings(toks, fam), stats, I.corpus(stats, docs), query if query is not None else term_rows(spark))


def bm25_topk(spark, d):
    s = _bm25(spark, d).select(F.col("entry_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))
    return s.orderBy(F.desc("bm25"), "doc_id").limit(100)


def bm25_family_merge(spark, d):
    """Words count under their lemma, in documents and in the query."""
    toks = I.tokens(_docs(spark, d))
    fam = toks.select("token", F.col("lemma").alias("family")).distinct()
    q = term_rows(spark).select(X.lemma(F.col("family")).alias("family"))
    return _bm25(spark, d, fam, q).select(F.col("entry_id").alias("doc_id"), F.round("bm25", 6).alias("bm25"))


def word_families(spark, d):
    return I.families(I.tokens(_docs(spark, d))).groupBy("family").agg(F.count("*").alias("members"), F.max("token").alias("last_member"))


def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id = 0").select(X.unit(F.col("embedding")).alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", F.round(X.dot(X.unit(F.col("embedding")), F.col("q")), 6).alias("cosine"))
    return s.orderBy(F.desc("cosine"), "vec_id").limit(100)


def _fused(spark, d):
    return R.fuse(scored(spark, d), rows=table(spark, d, "documents").count())  # the pool has no more rows than documents


def hybrid_rrf(spark, d):
    return _fused(spark, d).select("entry_id", F.round("cosine", 6).alias("cosine"), F.round("bm25", 6).alias("bm25"), "rank_vec", "rank_bm25", "rrf")


def _topk(spark, d):
    return R.partitioned_topk(_fused(spark, d))


def partitioned_topk(spark, d):
    return _topk(spark, d).select("entry_id", "memory_type", "type_rank", "rrf")


def quota_selection(spark, d):
    return R.quotas(_topk(spark, d)).select("entry_id", "memory_type", F.col("tier").cast("bigint").alias("tier"), "place")


def rerank_order(spark, d):
    """Without a re-ranker the fused order stands."""
    return _topk(spark, d).select("entry_id", F.row_number().over(Window.orderBy(F.col("rrf").desc(), "entry_id")).cast("bigint").alias("place"))


def _anchor_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    """(anchor_id, entry_id, bm25, rrf) of knowledge and episodic entries, and the hits. Anchors are three at most."""
    fused = _fused(spark, d)
    hits = R.quotas(R.partitioned_topk(fused))
    anchors = hits.filter("tier = 0").select(F.col("entry_id").alias("anchor_id"), "content")
    p = pool(spark, d)
    toks = I.tokens(p)
    stats, post = I.doc_stats(toks), I.postings(toks)
    corp = I.corpus(stats, p)
    q = I.tokens(anchors.select("anchor_id", F.col("content").alias("text")), "anchor_id").groupBy("anchor_id", F.col("token").alias("family")).agg(F.count("*").alias("qn"))
    df = post.groupBy("family").agg(F.count("*").alias("df"))
    s = q.join(post, "family").join(df, "family").join(stats, "entry_id").crossJoin(F.broadcast(corp))
    part = F.col("qn") * I.idf(F.col("n"), F.col("df")) * (F.col("tf") * 2.5) / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("dl") / F.col("avg_dl")))
    s = s.groupBy("anchor_id", "entry_id").agg(F.round(F.sum(part), 6).alias("bm25"))
    return s.join(fused.filter("memory_type in ('knowledge', 'episodic')").select("entry_id", "rrf"), "entry_id"), hits


def anchor_expansion(spark, d):
    return R.keep_expansions(R.expansions(_anchor_scores(spark, d)[0])).select("anchor_id", "entry_id", "bm25", "x_rank", "kept")


def expansion_dedup(spark, d):
    scores, hits = _anchor_scores(spark, d)
    kept = R.keep_expansions(R.expansions(scores)).join(hits.filter("tier = 0").select(F.col("entry_id").alias("anchor_id"), F.col("place").alias("anchor_rank")), "anchor_id")
    return R.dedup_expansions(kept, hits).select("anchor_id", "entry_id")


def context_assembly(spark, d):
    hits = R.quotas(_topk(spark, d)).withColumn("day", F.lit("2024-01-01"))
    return R.assemble(R.context_items(hits)).select("section", "memory_type", "n_items", F.sha2("body", 256).alias("body_sha256"))


def retrieval_trace(spark, d):
    hits = R.quotas(_topk(spark, d))
    return hits.select(F.concat_ws(":", F.lit("mem"), "memory_type", F.col("entry_id").cast("string")).alias("entry_key"), F.col("path").alias("topic"), (F.col("tier") == 0).alias("is_anchor"))


def query_classify(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", X.classify_query(F.col("text")).alias("query_class"))


def ce_truncate(spark, d):
    doc = table(spark, d, "documents")
    t = R.truncated_pair(F.concat_ws(" > ", "lang", "source"), F.col("text"))
    return doc.select("doc_id", F.sha2(t, 256).alias("pair_sha256"), F.size(F.split(t, " ")).cast("bigint").alias("n_words"))


def incremental_index(spark, d):
    """An index of part of the documents, the others ingested after: term statistics as of a full rebuild."""
    docs = _docs(spark, d)
    old, new = docs.filter("entry_id % 3 <> 0"), docs.filter("entry_id % 3 = 0")
    toks = I.tokens(old)
    post, stats = I.ingest(I.postings(toks), I.doc_stats(toks), new)
    return I.terms(post, I.corpus(stats, docs)).select("family", "df", F.round("idf", 6).alias("idf"))


def inspect_memories(spark, d):
    m = memories(spark, d)
    topics = m.filter("lang <> 'de'").select("topic_id").distinct().select("topic_id", F.col("topic_id").alias("topic_name"))
    return m.join(topics, "topic_id", "left").select("id", "memory_type", F.coalesce("topic_name", F.lit("General")).alias("topic"), F.length("content").cast("bigint").alias("n_chars"))


def active_decisions(spark, d):
    return memories(spark, d).filter("memory_type = 'decision' and status in ('active', 'conditional')").groupBy("status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


QUERIES = {f.__name__: f for f in (
    pool_build, tokenize_stats, inverted_index, bm25_idf, bm25_topk, bm25_family_merge, word_families, cosine_topk, hybrid_rrf, partitioned_topk, quota_selection,
    rerank_order, anchor_expansion, expansion_dedup, context_assembly, retrieval_trace, query_classify, ce_truncate, incremental_index, inspect_memories, active_decisions,
)}

_DOC_BM = """dl AS (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1), corp AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / (SELECT count(*) FROM documents) AS avg_dl)"""
_SCORE = "round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6)"
_IDF = f"WITH {_TOK}, p AS (SELECT DISTINCT t, doc_id FROM tok) SELECT t AS family, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM p GROUP BY 1"
ORACLE_SQL = {
    "pool_build": f"WITH {POOL_SQL} SELECT entry_id, entry_key, memory_type, path, length(text) AS text_length FROM pool",
    "tokenize_stats": f"WITH {_TOK} SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1",
    "word_families": f"WITH RECURSIVE {_TOK}, p AS (SELECT DISTINCT t AS a, {_LEMMA} AS b FROM tok), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT a, a FROM p UNION SELECT b, b FROM p), r(n, m) AS (SELECT a, b FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m), f AS (SELECT n, min(m) AS family FROM r GROUP BY n) SELECT family, count(*) AS members, max(n) AS last_member FROM f GROUP BY family",
    "inverted_index": f"WITH {_TOK} SELECT t AS family, count(DISTINCT doc_id) AS df, count(*) AS cf, min(doc_id) AS first_doc FROM tok GROUP BY 1",
    "bm25_idf": _IDF,
    "incremental_index": _IDF,
    "bm25_topk": f"WITH {_TOK}, {_DOC_BM}, h AS (SELECT t, doc_id, count(*) AS tf, count(*) OVER (PARTITION BY t) AS df FROM tok WHERE t IN ('{_LIST}') GROUP BY 1, 2) SELECT doc_id, {_SCORE} AS bm25 FROM h JOIN dl USING (doc_id), corp GROUP BY 1 ORDER BY bm25 DESC, doc_id LIMIT 100",
    "bm25_family_merge": f"""WITH {_TOK}, {_DOC_BM}, l AS (SELECT doc_id, {_LEMMA} AS f FROM tok), q AS (SELECT {_LEMMA} AS f, count(*) AS qn FROM (SELECT unnest(['{_LIST}']) AS t) GROUP BY 1),
      h AS (SELECT f, doc_id, count(*) AS tf, count(*) OVER (PARTITION BY f) AS df FROM l WHERE f IN (SELECT f FROM q) GROUP BY 1, 2) SELECT doc_id, {_SCORE.replace("sum(ln", "sum(qn * ln")} AS bm25 FROM h JOIN q USING (f) JOIN dl USING (doc_id), corp GROUP BY 1""",
    "cosine_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q, q)), 6) AS cosine FROM embeddings, q ORDER BY cosine DESC, vec_id LIMIT 100",
    "hybrid_rrf": f"WITH {SCORED_SQL} SELECT entry_id, round(cosine, 6) AS cosine, round(bm25, 6) AS bm25, rank_vec, rank_bm25, rrf FROM fused",
    "partitioned_topk": f"WITH {TYPE_SQL} SELECT entry_id, memory_type, type_rank, rrf FROM topk",
    "quota_selection": f"WITH {QUOTA_SQL} SELECT entry_id, memory_type, tier::BIGINT AS tier, place FROM hits",
    "rerank_order": f"WITH {TYPE_SQL} SELECT entry_id, row_number() OVER (ORDER BY rrf DESC, entry_id) AS place FROM topk",
    "anchor_expansion": f"WITH {EXPAND_SQL} SELECT anchor_id, entry_id, bm25, x_rank, kept FROM kept",
    "expansion_dedup": f"WITH {EXPAND_SQL} SELECT anchor_id, entry_id FROM (SELECT k.anchor_id, k.entry_id, row_number() OVER (PARTITION BY k.entry_id ORDER BY anchor_rank) AS n FROM kept k JOIN anchors a USING (anchor_id) WHERE k.entry_id NOT IN (SELECT entry_id FROM hits)) WHERE n = 1",
    "context_assembly": f"WITH {QUOTA_SQL} SELECT list_position(['decision','user','knowledge','episodic'], memory_type)::BIGINT AS section, memory_type, count(*) AS n_items, sha256(string_agg('[id=' || entry_id || ' type=' || memory_type || ' date=2024-01-01] ' || regexp_replace(content, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) ORDER BY tier, place, entry_id)) AS body_sha256 FROM hits GROUP BY memory_type",
    "retrieval_trace": f"WITH {QUOTA_SQL} SELECT 'mem:' || memory_type || ':' || entry_id AS entry_key, path AS topic, tier = 0 AS is_anchor FROM hits",
    "query_classify": f"SELECT conv_id, turn, CASE WHEN len(list_filter({list(X.BROAD_PHRASES)}, lambda p: contains(lower(text), p))) > 0 THEN 'broad_overview' ELSE 'information_extraction' END AS query_class FROM conversations",
    "ce_truncate": "WITH t AS (SELECT doc_id, list_filter(string_split_regex(lang || ' > ' || source || ' : ' || text, '\\s+'), lambda x: x <> '')[1:200] AS w FROM documents) SELECT doc_id, sha256(array_to_string(w, ' ')) AS pair_sha256, len(w) AS n_words FROM t",
    "inspect_memories": f"WITH {POOL_SQL} SELECT id, memory_type, CASE WHEN lang <> 'de' THEN path ELSE 'General' END AS topic, length(content) AS n_chars FROM mem",
    "active_decisions": f"WITH {POOL_SQL} SELECT status, count(*) AS n, min(id) AS first_id FROM mem WHERE memory_type = 'decision' AND status IN ('active','conditional') GROUP BY 1",
}
