"""Queue and ingestion: turn formatting, greedy consolidation, job states, turn pairs, chunks, deduplication, routing texts.

The greedy folds depend on order within a user, so they run as `aggregate` over the user's sorted jobs (JVM side, one array per
user; a user's pending queue is bounded by the poll); greedy batches of any items are a sorted stream. Everything else is joins, windows and aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as X

#: Limits in characters (tokens times four), queue poll and retries.
SOFT, HARD, POLL, MAX_RETRY, CHUNK, MIN_TAIL, BUDGET = 4000 * 4, 7000 * 4, 30, 5, 4000, 400, 8000


def format_turns(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """One prompt per conversation: `Role: content` lines in turn order."""
    line = F.concat(F.initcap("role"), F.lit(": "), F.trim(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(by).agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("raw_prompt"))


def to_time(value: Column) -> Column:
    """Time from ISO text, a few written forms, or seconds since 1970; null otherwise."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MMMM-dd-yyyy", "MMM-dd-yyyy", "yyyy-MM-dd")
    tries = [F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in forms]
    seconds = F.when(value.rlike(r"^\d{9,11}$"), F.timestamp_seconds(value.try_cast("bigint")).cast("timestamp_ntz"))
    return F.coalesce(*tries, seconds)


_FOLD = "array<struct<id:bigint,day:date,size:bigint>>"


def batches(jobs: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """user_id, id, batch (first id of its batch). jobs: user_id, id, day, size.

    A batch ends before a job that would pass `hard` or falls on another day, and after the job that reaches `soft`.
    """
    sorted_jobs = F.array_sort(F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "day", F.col("size").cast("bigint").alias("size"))))
    zero = F.expr("named_struct('first', cast(null as bigint), 'day', cast(null as date), 'size', cast(0 as bigint), 'out', cast(array() as array<struct<id:bigint,batch:bigint>>))")

    def step(acc, job):
        fresh = acc["first"].isNull() | (acc["size"] + job["size"] > hard) | (acc["day"] != job["day"])
        first = F.when(fresh, job["id"]).otherwise(acc["first"])
        size = F.when(fresh, job["size"]).otherwise(acc["size"] + job["size"])
        closed = size >= soft
        return F.struct(
            F.when(closed, F.lit(None).cast("bigint")).otherwise(first).alias("first"), F.when(closed, F.lit(None).cast("date")).otherwise(job["day"]).alias("day"),
            F.when(closed, F.lit(0).cast("bigint")).otherwise(size).alias("size"), F.concat(acc["out"], F.array(F.struct(job["id"].alias("id"), first.alias("batch")))).alias("out"),
        )

    folded = jobs.groupBy("user_id").agg(sorted_jobs.alias("jobs")).select("user_id", F.aggregate("jobs", zero, step, lambda acc: acc["out"]).alias("out"))
    return folded.select("user_id", F.explode("out").alias("x")).select("user_id", "x.id", "x.batch")


def fold_batches(jobs: DataFrame, dealt: DataFrame, hard: int = HARD) -> DataFrame:
    """Adjacent batches of one day whose sizes together keep within `hard` become one: user_id, id, batch."""
    sized = dealt.join(jobs.select("user_id", "id", "day", "size"), ["user_id", "id"])
    units = sized.groupBy("user_id", "batch").agg(F.sum("size").alias("size"), F.max(F.struct("id", "day"))["day"].alias("day"))
    merged = batches(units.select("user_id", F.col("batch").alias("id"), "day", "size"), soft=1 << 62, hard=hard)
    return dealt.join(merged.select("user_id", F.col("id").alias("batch"), F.col("batch").alias("merged")), ["user_id", "batch"]).select("user_id", "id", F.col("merged").alias("batch"))


def consolidate(queue: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """The queue after consolidation: a row per batch with the first id, the last job's time and the prompts joined."""
    jobs = queue.select("user_id", "id", F.to_date("ts").alias("day"), F.length("raw_prompt").cast("bigint").alias("size"))
    dealt = fold_batches(jobs, batches(jobs, soft, hard), hard)
    parts = F.array_sort(F.collect_list(F.struct("id", "raw_prompt")))
    both = queue.join(dealt, ["user_id", "id"])
    return both.groupBy("user_id", "batch").agg(F.array_join(F.transform(parts, lambda x: x["raw_prompt"]), "\n\n").alias("raw_prompt"), F.max(F.struct("id", "ts"))["ts"].alias("ts"), F.count("*").alias("jobs")).withColumnRenamed("batch", "id")


def pick_jobs(queue: DataFrame, limit: int = POLL) -> DataFrame:
    """The next jobs of one poll, oldest first."""
    return queue.filter(F.col("status").isin("processing", "pending", "failed") & (F.col("retry_count") < MAX_RETRY)).orderBy("id").limit(limit)


def mark(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Queue after outcomes (id, new_status): done jobs go, failed ones count a retry."""
    both = queue.join(outcomes.select("id", "new_status"), "id", "left")
    failed = F.coalesce(F.col("new_status") == "failed", F.lit(False))
    both = both.filter(F.coalesce(F.col("new_status") != "done", F.lit(True)))
    return both.withColumn("retry_count", F.col("retry_count") + failed.cast("int")).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def parse_turns(prompts: DataFrame, key: str = "id", text: str = "raw_prompt") -> DataFrame:
    """(key, n, role, content): turns of a prompt; lines without a header go on with the turn above, a preamble is dropped."""
    lines = prompts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    role = F.regexp_extract("line", r"^(User|Assistant):\s?", 1)
    w = Window.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("role", role).withColumn("n", F.sum((F.col("role") != "").cast("bigint")).over(w)).filter("n > 0")
    body = F.regexp_replace("line", r"^(User|Assistant):\s?", "")
    parts = F.array_sort(F.collect_list(F.struct("pos", body.alias("body"))))
    return lines.groupBy(key, "n").agg(F.max("role").alias("role"), F.array_join(F.transform(parts, lambda x: x["body"]), "\n").alias("content"))


def pair_turns(turns: DataFrame, key: str = "id", order: str = "n", role: str = "role", content: str = "content") -> DataFrame:
    """(key, pair, text): a User turn with the Assistant turn that follows; other turns stand alone."""
    w = Window.partitionBy(key).orderBy(order)
    is_user = F.lower(role) == "user"
    answers = (F.lower(role) == "assistant") & (F.lower(F.lag(role).over(w)) == "user")
    t = turns.withColumn("_head", ~F.coalesce(answers, F.lit(False)) | is_user).withColumn("pair", F.sum(F.col("_head").cast("bigint")).over(w))
    parts = F.array_sort(F.collect_list(F.struct(order, F.concat(F.initcap(role), F.lit(": "), F.col(content)).alias("t"))))
    return t.groupBy(key, "pair").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def chunk_pairs(pairs: DataFrame, key: str = "id", size: int = CHUNK, tail: int = MIN_TAIL) -> DataFrame:
    """(key, pair, chunk): chunks close at `size` characters; a last chunk under `tail` joins the one before."""
    items = F.array_sort(F.collect_list(F.struct("pair", F.length("text").cast("bigint").alias("n"))))
    zero = F.expr("named_struct('c', cast(1 as bigint), 'size', cast(0 as bigint), 'out', cast(array() as array<struct<pair:bigint,chunk:bigint,n:bigint>>))")

    def step(acc, x):
        total = acc["size"] + x["n"]
        full = total >= size
        return F.struct((acc["c"] + F.when(full, 1).otherwise(0)).alias("c"), F.when(full, F.lit(0).cast("bigint")).otherwise(total).alias("size"), F.concat(acc["out"], F.array(F.struct(x["pair"].alias("pair"), acc["c"].alias("chunk"), x["n"].alias("n")))).alias("out"))

    out = pairs.groupBy(key).agg(items.alias("items")).select(key, F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("x")).select(key, "x.*")
    w = Window.partitionBy(key)
    out = out.withColumn("last", F.max("chunk").over(w)).withColumn("chars", F.sum("n").over(Window.partitionBy(key, "chunk")))
    short = (F.col("chunk") == F.col("last")) & (F.col("chars") < tail) & (F.col("last") > 1)
    return out.select(key, "pair", F.when(short, F.col("chunk") - 1).otherwise(F.col("chunk")).alias("chunk"))


def flatten_extraction(extracted: DataFrame, key: str = "job_id") -> DataFrame:
    """(key, memory_type, content, chain) of validated extraction documents in column `doc`; empty ones give no rows."""
    m = extracted.filter(F.size("doc.memory") > 0).select(key, F.coalesce("doc.topics_root", F.array().cast("array<string>")).alias("root"), F.posexplode("doc.memory").alias("bucket", "m"))
    chain = F.concat("root", F.coalesce("m.topics_branch", F.array().cast("array<string>")))
    m = m.withColumn("chain", F.when(F.size(chain) > 0, chain).otherwise(F.array(F.lit("General"))))
    kinds = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"m.{c}").alias("items")) for t, c in (("user", "user"), ("knowledge", "fact"), ("episodic", "epis"), ("decision", "decision"))))
    return m.select(key, "bucket", "chain", F.explode(kinds).alias("k")).select(key, "bucket", "chain", F.col("k.t").alias("memory_type"), F.posexplode("k.items").alias("pos", "content"))


def dedup_memories(new: DataFrame, stored: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """New memories less those whose hash is stored for the user and type, or stands earlier in the batch."""
    h = X.content_hash(F.col("content"))
    keys = ["user_id", "memory_type", "_hash"]
    new = new.withColumn("_hash", h)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.withColumn("_n", first).filter("_n = 1").join(stored.select("user_id", "memory_type", h.alias("_hash")).distinct(), keys, "left_anti").drop("_n", "_hash")


def budgeted(items: DataFrame, by: str, order: list[Column], size: Column, budget: int = BUDGET) -> DataFrame:
    """Items in order while what stands before is under the budget; the one that crosses it stays."""
    w = Window.partitionBy(by).orderBy(*order)
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("_before", before).filter(F.col("_before") < budget).drop("_before")


def greedy_batches(items: DataFrame, by: str, order: str, size: str, limit: int = BUDGET) -> DataFrame:
    """(by, order, batch): a batch ends before the item that would pass the limit; an oversize item is alone.

    Batches follow from one another, so a group is one sorted stream in one task, of which no more than an Arrow batch is held.
    After a null size a batch never ends, as no sum with it passes the limit.
    """

    def run(batches):
        key, b, total, fresh = None, 0, 0, True
        for batch in batches:
            group = batch.column(0)
            runs = pc.run_end_encode(group)
            ends = runs.run_ends.to_pylist()
            out, lo, sizes = np.empty(batch.num_rows, np.int64), 0, batch.column(2)
            for name, hi in zip(runs.values.to_pylist(), ends, strict=True):
                if fresh or name != key:
                    key, b, total, fresh = name, 0, 0, False
                own = sizes.slice(lo, hi - lo)
                nulls = np.flatnonzero(own.is_null().to_numpy(zero_copy_only=False))
                known = int(nulls[0]) if len(nulls) else hi - lo
                open_end = total is None
                ahead = np.concatenate(([0], np.cumsum(own.slice(0, known).to_numpy(), dtype=np.int64)))
                i = 0
                while i < known and not open_end:  # one step a batch, not an item
                    if b == 0:
                        b, j = 1, i + 1
                        total = int(ahead[j] - ahead[i])
                    else:
                        j = max(i, int(np.searchsorted(ahead, ahead[i] + limit - total, side="right")) - 1)
                        total += int(ahead[j] - ahead[i])
                    out[lo + i : lo + j] = b
                    i = j
                    if i < known and total + int(ahead[i + 1] - ahead[i]) > limit:
                        b, total = b + 1, int(ahead[i + 1] - ahead[i])
                        out[lo + i] = b
                        i += 1
                if i < hi - lo:
                    b, total = max(b, 1), None
                    out[lo + i : hi] = b
                lo = hi
            yield pa.RecordBatch.from_arrays([group, batch.column(1), pa.array(out)], names=["by", "order", "batch"])

    kind = items.schema[by].dataType.simpleString()
    rows = items.select(F.col(by).alias("by"), F.col(order).cast("bigint").alias("order"), F.col(size).cast("bigint").alias("size"))
    dealt = rows.repartition("by").sortWithinPartitions("by", "order", "size")
    return dealt.mapInArrow(run, f"by {kind}, order bigint, batch bigint").select(F.col("by").alias(by), F.col("order").alias(order), "batch")
