"""Hybrid retrieval: fused ranks, quotas, anchor expansion, deduplication and context assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.sources.tables import checkpointed

from .index import RRF_K, W_BM25, W_VEC

#: Entries of each type that enter the merge, and the fixed tier of each type.
TOP_K = {"episodic": 40, "knowledge": 40, "user": 30, "decision": 30, "node": 10}
FIXED_TIER = {"episodic": 5, "knowledge": 5, "decision": 5, "user": 8, "node": 5}
ANCHORS, EXPAND_TOP, EXPAND_MIN, EXPAND_KEEP, SUMMARY_CAP, CORPUS_K = 3, 20, 0.5, 5, 3, 30
#: Entries whose (key, score) pairs one task ranks; more are ranked in ranges.
RANK_ROWS = 2_000_000
SECTIONS = ("decision", "user", "knowledge", "episodic")


def rank(score: Column, *ties: str, by: tuple[str, ...] = ()) -> Column:
    """1, 2, ... by falling score rounded to nine digits; ties by the columns named."""
    w = Window.partitionBy(*by) if by else Window.partitionBy()
    return F.row_number().over(w.orderBy(F.round(score, 9).desc(), *ties)).cast("bigint")


def ordered_ranks(scored: DataFrame, score: str, key: str, parts: int) -> DataFrame:
    """(key, rank) of all rows by falling score, ties by key, without a task that holds them all.

    Ranges of (score, key) are sorted each on its own; a row's rank is its place in its range and the sizes of the ranges before.
    The ranges are written, so their bounds are fixed; `parts` sizes are all that the driver sees.
    """
    order = F.round(F.col(score), 9).desc(), F.col(key)
    cut = scored.select(key, F.col(score)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cut = checkpointed(cut.select(key, F.monotonically_increasing_id().alias("_at")))  # range number << 33 | place
    sizes = cut.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    starts, total = {}, 0
    for r in sizes:
        starts[r["_part"]], total = total, total + r["n"]
    before = F.create_map(*[F.lit(x) for p, n in starts.items() for x in (p, n)]) if starts else F.create_map(F.lit(0), F.lit(0))
    return cut.select(key, (before[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("bigint").alias("rank"))


def fuse(scored: DataFrame, key: str = "entry_id", by: tuple[str, ...] = (), rows: int | None = None, narrow: bool = False) -> DataFrame:
    """Adds rank_vec, rank_bm25 and rrf. `by`: the query or user column when several are ranked at once.

    A global rank needs the (key, score) pairs in one order; where nothing parts them, only these are ranked and joined back.
    rows: how many there are, where known; over RANK_ROWS they are ranked in ranges instead of one task. narrow: scored holds
    keys and scores only, so up to RANK_ROWS it is ranked as it is.
    """
    fused = F.round(F.lit(W_VEC) / (RRF_K + F.col("rank_vec")) + F.lit(W_BM25) / (RRF_K + F.col("rank_bm25")), 9)
    if not by and (rows or 0) > RANK_ROWS:
        scored = checkpointed(scored)
        for score, name in (("cosine", "rank_vec"), ("bm25", "rank_bm25")):
            ranks = ordered_ranks(scored.select(key, "cosine", "bm25"), score, key, -(-rows // RANK_ROWS) + 1)
            scored = scored.join(ranks.withColumnRenamed("rank", name), key)
        return scored.withColumn("rrf", fused)
    if not by and not narrow:
        ranks = scored.select(key, rank(F.col("cosine"), key).alias("rank_vec"), rank(F.col("bm25"), key).alias("rank_bm25"))
        return scored.join(ranks, key).withColumn("rrf", fused)
    d = scored.withColumn("rank_vec", rank(F.col("cosine"), key, by=by)).withColumn("rank_bm25", rank(F.col("bm25"), key, by=by))
    return d.withColumn("rrf", fused)


def _per_type(values: dict[str, int]) -> Column:
    x = F.lit(0)
    for k, n in values.items():
        x = F.when(F.col("memory_type") == k, n).otherwise(x)
    return x


def partitioned_topk(fused: DataFrame, key: str = "entry_id", broad: bool = False) -> DataFrame:
    """The best entries of each type, with their rank in it; summaries only for broad queries."""
    w = Window.partitionBy("memory_type").orderBy(F.col("rrf").desc(), key)
    limits = TOP_K if broad else {k: n for k, n in TOP_K.items() if k != "node"}
    return fused.withColumn("type_rank", F.row_number().over(w).cast("bigint")).filter(F.col("type_rank") <= _per_type(limits))


def quotas(candidates: DataFrame, key: str = "entry_id", top_k: int = CORPUS_K) -> DataFrame:
    """Anchors (tier 0), then the fixed tier of each type (1), then the rest by rank (2), cut at top_k without anchors."""
    w = Window.partitionBy("memory_type").orderBy(F.col("rrf").desc(), key)
    d = candidates.withColumn("r", F.row_number().over(w).cast("bigint"))
    anchor = (F.col("memory_type") == "decision") & (F.col("r") <= ANCHORS)
    at = F.when(F.col("memory_type") == "decision", F.col("r") - ANCHORS).otherwise(F.col("r"))
    d = d.withColumn("tier", F.when(anchor, 0).when(at <= _per_type(FIXED_TIER), 1).otherwise(2))
    d = d.filter(~((F.col("memory_type") == "node") & (F.col("r") > SUMMARY_CAP)))
    order = F.row_number().over(Window.partitionBy(F.col("tier") > 0).orderBy("tier", F.col("rrf").desc(), key)).cast("bigint")
    return d.withColumn("place", order).filter((F.col("tier") == 0) | (F.col("place") <= top_k)).drop("r")


def expansions(scores: DataFrame, key: str = "entry_id", top: int = EXPAND_TOP) -> DataFrame:
    """The best entries for each anchor by BM25 of its content. scores: anchor_id, key, bm25, rrf."""
    w = Window.partitionBy("anchor_id").orderBy(F.round("bm25", 9).desc(), key)
    return scores.filter(F.col("bm25") >= EXPAND_MIN).withColumn("x_rank", F.row_number().over(w).cast("bigint")).filter(F.col("x_rank") <= top)


def keep_expansions(expanded: DataFrame, key: str = "entry_id") -> DataFrame:
    w = Window.partitionBy("anchor_id").orderBy(F.col("rrf").desc(), key)
    return expanded.withColumn("kept", F.row_number().over(w).cast("bigint")).filter(F.col("kept") <= EXPAND_KEEP)


def dedup_expansions(kept: DataFrame, claimed: DataFrame, key: str = "entry_id") -> DataFrame:
    """Drops what the corpus or an earlier anchor has already claimed. kept: anchor_rank, key."""
    w = Window.partitionBy(key).orderBy("anchor_rank")
    return kept.join(claimed.select(key), key, "left_anti").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def context_items(hits: DataFrame) -> DataFrame:
    """Section, place in it and the tagged line of each hit. hits: memory_type, entry_id, content, day, tier, place."""
    section = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("memory_type")).cast("bigint")
    line = F.concat(F.lit("[id="), F.col("entry_id").cast("string"), F.lit(" type="), "memory_type", F.lit(" date="), "day", F.lit("] "), F.regexp_replace("content", r"\n{3,}", "\n\n"))
    return hits.select(section.alias("section"), "memory_type", "tier", "place", "entry_id", line.alias("line"))


def assemble(items: DataFrame) -> DataFrame:
    """The text of each section, its items in order. A context is bounded by the quotas, so sections are small."""
    return items.groupBy("section", "memory_type").agg(F.expr("listagg(line, '\\n') within group (order by tier, place, entry_id)").alias("body"), F.count("*").alias("n_items"))


def content_only(text: Column, path: Column) -> Column:
    return F.when(text.startswith(path), F.trim(F.substring(text, F.length(path) + 1, F.length(text)))).otherwise(text)


def truncated_pair(path: Column, content: Column, n: int = 200) -> Column:
    """Re-ranker input: `path : content` up to n words."""
    return X.truncate_words(F.concat_ws(" : ", path, content), n)
