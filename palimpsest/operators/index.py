"""Lexical and vector index: pool, postings, word families, BM25 and vector scores.

Postings, terms and document statistics are ordinary tables; an incremental ingest appends postings and aggregates anew, so it
equals a full rebuild. Nothing here collects; the query's terms are the only broadcast and are bounded by the query's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X

K1, B = 1.5, 0.75
W_VEC, W_BM25, RRF_K = 0.7, 0.3, 60


def build_pool(memories: DataFrame, paths: DataFrame, include: Column | None = None) -> DataFrame:
    """Search entries of memories that have a topic and content; decisions only if active or conditional.

    memories: id, memory_type, content, topic_id, status, ts, embedding; paths: topic_id, path.
    """
    live = (F.col("memory_type") != "decision") | F.col("status").isin("active", "conditional")
    m = memories.filter(F.col("content").isNotNull() & (F.col("content") != "") & F.col("topic_id").isNotNull() & live)
    m = m if include is None else m.filter(include)
    m = m.join(paths, "topic_id", "left")
    return m.withColumn("entry_key", F.concat_ws(":", F.lit("mem"), "memory_type", "id")).withColumn("text", F.concat_ws(" ", "path", "content"))


def summary_entries(topics: DataFrame, paths: DataFrame) -> DataFrame:
    """Entries of topics with a description."""
    t = topics.filter(F.coalesce("description", F.lit("")) != "").join(paths, "topic_id", "left")
    return t.withColumn("entry_key", F.concat_ws(":", F.lit("node"), "topic_id")).withColumn("text", F.concat_ws(" ", "path", "description"))


def tokens(entries: DataFrame, key: str = "entry_id", text: str = "text") -> DataFrame:
    """(key, token, lemma) for each word."""
    t = entries.select(key, F.explode(X.words(F.col(text))).alias("token"))
    return t.withColumn("lemma", X.lemma(F.col("token")))


def families(toks: DataFrame, rounds: int = 100) -> DataFrame:
    """(token, family): components of words that share lemmas; a family is named by its smallest member.

    Labels pass along token-lemma edges until none changes. With suffix lemmas chains are short, so a few rounds do; where labels
    still change after `rounds`, it raises.
    """
    pairs = toks.select("token", "lemma").distinct()
    edges = pairs.unionByName(pairs.select(F.col("lemma").alias("token"), F.col("token").alias("lemma"))).unionByName(pairs.select("token", F.col("token").alias("lemma"))).unionByName(pairs.select(F.col("lemma").alias("token"), "lemma")).distinct()
    from palimpsest.sources.tables import checkpointed

    edges = checkpointed(edges.select(F.col("token").alias("a"), F.col("lemma").alias("b")))
    labels = checkpointed(edges.groupBy("a").agg(F.min("b").alias("family")).withColumnRenamed("a", "token"))
    for _ in range(rounds):
        new = edges.join(labels, edges["b"] == labels["token"]).groupBy("a").agg(F.min("family").alias("family")).withColumnRenamed("a", "token")
        new = checkpointed(new)
        changed = new.join(labels.withColumnRenamed("family", "old"), "token").filter("family <> old").limit(1).count()
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"families still change after {rounds} rounds")


def postings(toks: DataFrame, fam: DataFrame | None = None, key: str = "entry_id") -> DataFrame:
    """(family, key, tf); words are their own families where none are given."""
    t = toks.withColumn("family", F.col("token")) if fam is None else toks.join(fam, "token")
    return t.groupBy("family", key).agg(F.count("*").alias("tf"))


def doc_stats(toks: DataFrame, key: str = "entry_id") -> DataFrame:
    return toks.groupBy(key).agg(F.count("*").alias("dl"))


def corpus(stats: DataFrame, n_entries: DataFrame) -> DataFrame:
    """One row: n, avg_dl; entries without words count."""
    return n_entries.agg(F.count("*").alias("n")).crossJoin(stats.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avg_dl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def terms(post: DataFrame, corp: DataFrame) -> DataFrame:
    """(family, df, idf). The corpus row is a single row, broadcast."""
    return post.groupBy("family").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corp.select("n"))).select("family", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def weighted(post: DataFrame, stats: DataFrame, key: str = "entry_id") -> DataFrame:
    """Postings with their family's df and their entry's dl: what a stored index is searched by without a join."""
    df = post.groupBy("family").agg(F.count("*").alias("df"))
    return post.join(df, "family").join(stats.select(key, "dl"), key).select("family", key, "tf", "df", "dl")


def _weighed(hits: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """hits with df and dl, where they lack them. hits: all postings of the families in it; these are as few as a query's words."""
    if "df" not in hits.columns:
        hits = hits.join(F.broadcast(hits.groupBy("family").agg(F.count("*").alias("df"))), "family")
    return hits if "dl" in hits.columns else hits.join(stats, key)


def _part() -> Column:
    """What a query word that occurs qn times adds to an entry's score."""
    return F.col("qn") * idf(F.col("n"), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avg_dl")))


def _times(query: DataFrame) -> Column:
    return (F.sum("qn") if "qn" in query.columns else F.count("*")).alias("qn")


def bm25(post: DataFrame, stats: DataFrame, corp: DataFrame, query: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, bm25) of entries with a query term. query: one row for each query word (family), or for several with their number qn; repeated words add again."""
    hits = post.join(F.broadcast(query.groupBy("family").agg(_times(query))), "family")
    return _weighed(hits, stats, key).crossJoin(F.broadcast(corp)).groupBy(key).agg(F.sum(_part()).alias("bm25"))


def bm25_each(post: DataFrame, stats: DataFrame, corp: DataFrame, queries: DataFrame, qid: str, key: str = "entry_id") -> DataFrame:
    """(qid, key, bm25) for several queries at once: queries has a row (qid, family) for each word, or for several with their number qn."""
    asked = queries.groupBy(qid, "family").agg(_times(queries))
    hits = post if "df" in post.columns else post.join(F.broadcast(asked.select("family").distinct()), "family")
    return _weighed(hits, stats, key).join(F.broadcast(asked), "family").crossJoin(F.broadcast(corp)).groupBy(qid, key).agg(F.sum(_part()).alias("bm25"))


def query_families(words: DataFrame, fam: DataFrame, qid: str) -> DataFrame:
    """(qid, family) of query tokens (qid, token, lemma): the family of the word, else of its lemma, else the word itself.

    Only the words of queries and their families travel; fam stays where it is.
    """
    asked = words.select("token").union(words.select("lemma")).distinct()
    few = fam.join(F.broadcast(asked), "token").select("token", "family")
    own, by_lemma = few.withColumnRenamed("family", "_f"), few.select(F.col("token").alias("lemma"), F.col("family").alias("_g"))
    return words.join(F.broadcast(own), "token", "left").join(F.broadcast(by_lemma), "lemma", "left").select(qid, F.coalesce("_f", "_g", "token").alias("family"))


def ingest(post: DataFrame, stats: DataFrame, new_entries: DataFrame, key: str = "entry_id") -> tuple[DataFrame, DataFrame]:
    """Postings and statistics with the new entries' appended; entries already present are left out."""
    fresh = tokens(new_entries.join(stats.select(key), key, "left_anti"), key)
    return post.unionByName(postings(fresh, key=key)), stats.unionByName(doc_stats(fresh, key))
