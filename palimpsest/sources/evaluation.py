"""Readers and writers of evaluation data, conversations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, turn, role, text) of JSON files that hold {id, messages: [{role, content}]}."""
    d = spark.read.schema("id bigint, messages array<struct<role:string,content:string>>").option("multiLine", True).json(path)
    return d.select(F.col("id").alias("conv_id"), F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def read_answers(spark: SparkSession, path: str, conv: int | None = None) -> DataFrame:
    """(conv_id, answer_id, answer_text) of a baseline's answers: {conversation_id, evaluations: [{question, answer}]}."""
    d = spark.read.schema("conversation_id bigint, evaluations array<struct<question:string,answer:string>>").option("multiLine", True).json(path)
    d = d if conv is None else d.filter(F.col("conversation_id") == conv)
    return d.select(F.col("conversation_id").alias("conv_id"), F.posexplode("evaluations").alias("answer_id", "e")).select("conv_id", F.col("answer_id").cast("bigint").alias("answer_id"), F.col("e.question").alias("question_text"), F.col("e.answer").alias("answer_text"))


def write_json(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Rows as JSON lines; with a partition column only the partitions written are replaced."""
    w = df.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    w.json(path)


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
