"""Shared pieces of the training-data operators: table access, Arrow slicing, vectorised byte hashing."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step works on. A single longer document is a step of its own.
STEP_BYTES = 1 << 20


#: Rows of an Arrow batch at most; texts of some kilobytes then take a few megabytes on either side.
BATCH_ROWS = 2_000
#: Bytes of an Arrow batch, about, where a single row is not larger.
BATCH_BYTES = 8 << 20


def _bytes(said: str) -> int:
    """Bytes of a Spark setting such as 64m, or 67108864b."""
    said = said.lower().removesuffix("b")
    return int(said[:-1]) << 10 * (" kmgtp".index(said[-1])) if said[-1:].isalpha() else int(said)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder. Also bounds Arrow batches of the session, in rows where they are at Spark's default, and in bytes."""
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def bucket_of(doc_id, mod: int):
    """crc32 of the decimal doc_id modulo `mod`: the fold of a document; -1, so no fold, without doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    spark.checkpoint.dir names that folder. Where it is unset and all runs on one machine, a folder below /tmp/checkpoints is used;
    on a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back. An empty table comes back empty, with its schema.

    options: of the writer, beside its compression.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A join key is hot where it holds over one row in so many; there are at most as many such keys, whatever the size of the table.
HOT_SHARE = 1_000


def spread_join(left: DataFrame, right: DataFrame, key: list[str], counted: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key at most; the rows of a hot key are dealt to several tasks.

    counted: the key and n, the rows that left has of it (at most; a key that is not there counts as rare). It is read twice. by: columns
    of left by whose hash a hot key's rows are dealt, the same at every try. Rows of right are repeated for hot keys, at most
    2 * HOT_SHARE of them, and so bounded is what is broadcast. Null keys of left meet nothing, as in any join.
    """
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    taken = [*left.columns, *right.columns]
    salt, parts = (free_name(taken, x) for x in ("salt", "parts"))
    named = [free_name([*taken, salt, parts], f"hot_{k}") for k in key]
    hot = counted.filter(F.col("n") * HOT_SHARE > F.lit(total)).select(*(F.col(k).alias(x) for k, x in zip(key, named, strict=True)), F.ceil(F.col("n") * HOT_SHARE / F.lit(max(1, total))).cast("long").alias(parts))
    hot = F.broadcast(hot)
    own, other = (d.join(hot, [d[k] == hot[x] for k, x in zip(key, named, strict=True)], "left").drop(*named).withColumn(parts, F.coalesce(parts, F.lit(1))) for d in (left, right))
    own = own.withColumn(salt, F.pmod(F.xxhash64(*by), F.col(parts))).drop(parts)
    other = other.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))).drop(parts)
    return own.join(other, [*key, salt], how).drop(salt)


def task(run):
    """`run` of a mapInArrow whose worker gives memory back when its task ends: workers outlive tasks, and stages add up."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return tidy


def partitions(spark: SparkSession, n_bytes: int, per_bytes: int) -> int:
    """Partitions for n_bytes of data, never below the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(n_bytes) // per_bytes))


def free_name(taken: list[str], name: str) -> str:
    """`name` with as many underscores in front as it takes to differ from all columns, in any case of letters."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def slices(batch: pa.RecordBatch, text: str = "text", step: int = STEP_BYTES):
    """Cuts a batch into runs of whole rows holding about `step` bytes of text each."""
    offsets = buffers(batch.column(batch.schema.get_field_index(text)))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i)
        i = j


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets into them. Null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def texts(col) -> list[str]:
    return [x or "" for x in col.to_pylist()]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, STEP_BYTES + 1)
        for k, r in enumerate((_R, _RINV)):
            x = np.full(size, r, np.uint64)
            x[0] = 1
            _POW[k] = np.multiply.accumulate(x)
    return _POW


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of a 64-bit hash over all bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with span hash of data[a:b] = (c[b] - c[a]) * r**-a modulo 2**64."""
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(_BYTE[data] * _powers(len(data) + 1)[0][: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [a, b) by the prefix hashes of their text; equal bytes, equal hash, wherever they stand."""
    return mix((c[b] - c[a]) * _powers(len(c))[1][a])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of each document, and the n + 1 offsets of documents into them."""
    ink = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:n]
    a = np.flatnonzero(start)
    return a, np.flatnonzero(end) + 1, np.searchsorted(a, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all else untouched."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each lower-cased word, and the offsets of documents into them."""
    a, b, at = word_spans(data, offsets)
    return span_hash(prefix_hash(lower(data)), a, b), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sha_hex(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()
