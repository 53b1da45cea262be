"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, SentencePiece encoding.

Each stage gets all documents that the one before kept and returns the columns of documents; the last returns token ids. Every
stage's result is written as Parquet in the shared folder and read back, so a lost executor costs at most one stage's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, decontamination, jaccard_join, line_dedup, sentencepiece_codec, toxicity

#: Ids broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def _without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """docs less the documents of `lost` (doc_id)."""
    name = common.free_name(docs.columns, "lost")
    lost = common.written(lost.select(F.col("doc_id").alias(name)).distinct())
    few = lost.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(lost) if few else lost, docs["doc_id"] == lost[name], "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier predicts toxic go. Null and empty texts stay; repeated rows share a fate."""
    learn = docs.select("doc_id", "text").filter(common.bucket_of(F.col("doc_id"), 5) != 0)
    return toxicity.accepted(docs, toxicity.fit(learn, common.table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; the documents stay."""
    out = line_dedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, all its rows where several have it."""
    return _without(docs, jaccard_join.near_duplicates(docs).filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, all rows of their doc_id; null and empty texts stay."""
    return _without(docs, decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row with their digests; null and empty texts have none."""
    return sentencepiece_codec.encode(docs, keep_decoded=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: No stage but line dedup can be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.written(docs)
    return docs
