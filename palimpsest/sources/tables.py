"""Versioned Parquet tables: the warehouse behind the engine. A table that is being read is never overwritten; missing tables read as
empty ones with their schema.
"""

from __future__ import annotations

import urllib.parse
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "processing_queue": "id bigint, user_id string, ts timestamp_ntz, raw_prompt string, status string, retry_count int, embedding array<array<float>>",
    "topics": "topic_id bigint, user_id string, name string, level int, summary string, description string, ts timestamp_ntz, parent_id bigint, embedding array<float>",
    "messages": "id bigint, user_id string, ts timestamp_ntz, raw_msg string",
    "memories": "id bigint, user_id string, memory_type string, content string, ts timestamp_ntz, embedding array<float>, topic_id bigint, message_id bigint, status string, context string, last_validated_at timestamp_ntz",
    "postings": "entry_key string, token string, lemma string, tf bigint",
    "doc_stats": "entry_key string, sig bigint, dl bigint",
    "leaf_summary_items": "topic_id bigint, kind string, minute string, mem_id bigint, text string",
    "leaf_state": "topic_id bigint, desc_dirty boolean, desc_update_count int",
    "source_map": "parent_id bigint, child_id bigint, text string, state string",
}


def shared_path(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset, below /tmp/checkpoints on one machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, for every executor."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Warehouse:
    """Tables below a path that every executor can reach.

    Each user's rows of a table are a folder of their own, with versions v1, v2, ... in it; a version is a folder of parts. A write
    makes a new version of one user's rows, an append adds a part to the latest, and a part counts once Spark has marked it whole.
    So neither touches another user's rows, and appends of several writers stand side by side. Numbers of versions are claimed by
    creating a file, so two writers never share one; of two that rewrite the same user's rows at once the later version counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _folder(self, name: str, user: str | None) -> str:
        return f"{self.path}/{name}/" + ("all" if user is None else "u-" + urllib.parse.quote(user, safe="").replace("%", "+"))

    def _parts(self, version: str) -> list[str]:
        fs, _ = self._fs(version)
        return [f"{version}/{x}" for x in self._names(version) if fs.exists(self._fs(f"{version}/{x}/_SUCCESS")[1])]

    def _versions(self, folder: str) -> list[int]:
        """Versions whose first part is whole."""
        found = sorted(int(x[1:]) for x in self._names(folder) if x[0] == "v")
        return [v for v in found if f"{folder}/v{v}/base" in self._parts(f"{folder}/v{v}")]

    def _shaped(self, name: str, df: DataFrame) -> DataFrame:
        fields = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))

    def read(self, name: str, user: str | None = None) -> DataFrame:
        """The rows of one user, or of all."""
        folders = [self._folder(name, user)] if user is not None else [f"{self.path}/{name}/{x}" for x in self._names(f"{self.path}/{name}")]
        parts = [p for f in folders if (v := self._versions(f)) for p in self._parts(f"{f}/v{v[-1]}")]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, df: DataFrame, user: str | None = None) -> None:
        """A new version of the user's rows (of rows without a user, where none is named); the one before the last is removed."""
        folder = self._folder(name, user)
        versions = self._versions(folder)
        n = (versions or [0])[-1] + 1
        fs, _ = self._fs(folder)
        while not fs.createNewFile(self._fs(f"{folder}/c{n}")[1]):
            n += 1
        self._shaped(name, df).write.parquet(f"{folder}/v{n}/base")
        for v in versions[:-1]:
            fs.delete(self._fs(f"{folder}/v{v}")[1], True)

    def append(self, name: str, df: DataFrame, user: str | None = None) -> None:
        """New rows of the user as a part of the latest version; nothing is rewritten."""
        folder = self._folder(name, user)
        versions = self._versions(folder)
        if versions:
            self._shaped(name, df).write.parquet(f"{folder}/v{versions[-1]}/a{uuid.uuid4().hex}")
        else:
            self.write(name, df, user)

    def remove(self, name: str, user: str) -> None:
        """Takes away all of a user's rows."""
        fs, p = self._fs(self._folder(name, user))
        fs.delete(p, True)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of an external database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def vector_from_blob(column):
    """array<float> from little-endian 32-bit floats in a binary column, without Python: four bytes at a time."""
    n = F.length(column) / 4
    word = lambda i: F.conv(F.concat(*(F.hex(F.substring(column, i * 4 + k, F.lit(1))) for k in (4, 3, 2, 1))), 16, 10).cast("bigint")

    def real(w):
        sign = F.when(F.shiftright(w, 31) == 1, -1.0).otherwise(1.0)
        exp, frac = F.shiftright(w, 23).bitwiseAND(F.lit(255)), w.bitwiseAND(F.lit(0x7FFFFF))
        return (sign * F.when(exp == 0, frac * F.pow(F.lit(2.0), F.lit(-149))).otherwise((1 + frac / float(1 << 23)) * F.pow(F.lit(2.0), exp - 127))).cast("float")

    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: real(word(i)))).otherwise(F.array().cast("array<float>"))


def next_ids(df: DataFrame, existing: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """Numbers new rows after the largest id of `existing`, in the given order."""
    from pyspark.sql import Window

    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(id_column, F.col("_top") + F.row_number().over(Window.orderBy(*order))).drop("_top")
