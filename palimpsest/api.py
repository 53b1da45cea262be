"""The engine: add, process, search, inspect, forget, reset over a warehouse of Parquet tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
from collections import Counter, OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import models
from palimpsest.errors import InvalidRequest, RetrievalError
from palimpsest.functions import text as X
from palimpsest.operators import decisions as D
from palimpsest.operators import denoise, index, queue, retrieval, summaries, tree
from palimpsest.operators.cluster import decision_clusters
from palimpsest.sources.tables import SCHEMAS, Warehouse, checkpointed, next_ids

MEMORY_TYPES = ("episodic", "knowledge", "user", "decision")
DIMS, INDEXES, ROUTES = 64, 16, 200
HINT = "Answer from the context; prefer decisions that are active, and say so where the context does not tell."
_DOC = "topics_root array<string>, memory array<struct<topics_branch:array<string>,user:array<string>,fact:array<string>,epis:array<string>,decision:array<string>>>"


@dataclasses.dataclass
class RetrievalResult:
    context: str
    trace: dict
    system_hint: str
    query_type: str


class Engine:
    """One warehouse. Models are injected; the defaults are deterministic and offline."""

    def __init__(self, spark: SparkSession, path: str, extractor: models.Extractor = models.rule_extractor, embedder: models.Embedder = models.hashed_embeddings, reranker: models.Reranker = models.keep_order, judge: models.DecisionJudge = models.newest_is_active, summarizer: models.Summarizer = models.first_sentences, planner: models.TreePlanner = models.no_changes):
        self.spark, self.store = spark, Warehouse(spark, path)
        self.extractor, self.embedder, self.reranker, self.judge, self.summarizer, self.planner = extractor, embedder, reranker, judge, summarizer, planner
        self._indexes: OrderedDict[str, tuple[DataFrame, ...]] = OrderedDict()
        self._sizes: dict[str, int] = {}  # entries of each pool

    def add(self, messages: list[dict], user_id: str = "default", timestamp=None) -> int:
        """Queues a conversation; returns the job's id."""
        if not messages:
            raise InvalidRequest("no messages")
        if isinstance(timestamp, (int, float)):
            timestamp = dt.datetime.fromtimestamp(timestamp, dt.UTC).replace(tzinfo=None)
        elif isinstance(timestamp, str):
            said, timestamp = timestamp, self.spark.createDataFrame([(timestamp,)], "t string").select(queue.to_time(F.col("t"))).first()[0]
            if timestamp is None:
                raise InvalidRequest(f"no time: {said}")
        prompt = "\n".join(f"{str(m.get('role', 'user')).capitalize()}: {str(m.get('content', '')).strip()}" for m in messages)
        old = self.store.read("processing_queue")
        new = self.spark.createDataFrame([(user_id, timestamp or dt.datetime.now(dt.UTC).replace(tzinfo=None), prompt, "pending", 0)], "user_id string, ts timestamp_ntz, raw_prompt string, status string, retry_count int")
        new = checkpointed(next_ids(new, old, ["ts"]))
        self.store.append("processing_queue", new, user_id)
        return new.first()["id"]

    def process(self, user_id: str = "default") -> dict:
        """One turn of the user's queue: {success, failed}.

        Fresh jobs are consolidated; failed ones are tried again as they are, up to MAX_RETRY times. What they hold is stored, then
        decisions are judged, detached memories repaired, the tree reorganised where REORG messages have gathered, leaves and their
        parents described and topics embedded. One process at a time a user; other users and add() may run beside it, but what is
        added between the reading of the queue and its new version is to be added again.
        """
        mine = checkpointed(self.store.read("processing_queue", user_id))
        if mine.isEmpty():
            return {"success": 0, "failed": 0}
        fresh = (F.col("status") == "pending") & (F.col("retry_count") == 0)
        merged = queue.consolidate(mine.filter(fresh)).drop("jobs").withColumn("status", F.lit("pending")).withColumn("retry_count", F.lit(0))
        jobs = checkpointed(merged.unionByName(mine.filter(~fresh), allowMissingColumns=True))
        todo = queue.pick_jobs(jobs).collect()  # one poll
        if not todo:
            return {"success": 0, "failed": 0}
        known = checkpointed(self._topics(user_id))
        paths = tree.paths(known).select("topic_id", "path")
        before = self.store.read("messages", user_id).count()
        done, failed = [], []
        for job in todo:
            try:
                prompt = self.spark.createDataFrame([(job.raw_prompt,)], "t string").select(X.clean_prompt(F.col("t"))).first()[0]
                done.append((job.id, job.ts, job.raw_prompt, json.dumps(self.extractor(prompt, self._routes(prompt, known, paths)))))
            except Exception:
                failed.append(job.id)
        outcome = self.spark.createDataFrame([(d[0], "done") for d in done] + [(i, "failed") for i in failed], "id bigint, new_status string")
        if done:
            self._save(user_id, done)
        self.store.write("processing_queue", queue.mark(jobs, outcome), user_id)
        if done:
            self._judge(user_id)
            self.embed_topics(user_id)
            self.repair(user_id)
            if self.spark.range(1).select(tree.reorg_due(F.lit(before), F.lit(before + len(done)))).first()[0]:
                self.reorganize_tree(user_id)
            self.summarize(user_id)
            self.embed_topics(user_id)
        self._refresh(user_id)
        return {"success": len(done), "failed": len(failed)}

    def _routes(self, prompt: str, topics: DataFrame, paths: DataFrame) -> list[str]:
        """Paths of the leaves nearest to the prompt, ROUTES at most; those without a vector come last, by name."""
        q = self._embed(self.spark.createDataFrame([(0, prompt)], "qid int, text string"), "qid", "text").select(X.unit(F.col("embedding")).alias("_q"))
        sim = F.coalesce(F.round(X.dot(X.unit(F.col("embedding")), F.col("_q")), 9), F.lit(-1.0))
        near = tree.leaves(topics).join(paths, "topic_id").crossJoin(F.broadcast(q)).select("path", sim.alias("sim"))  # one query row
        return [r.path for r in near.orderBy(F.desc("sim"), "path").limit(ROUTES).collect()]

    def _embed(self, texts: DataFrame, key: str, text: str) -> DataFrame:
        return self.embedder(texts, key, text, DIMS)

    def embed_topics(self, user_id: str = "default") -> int:
        """Fills the vectors of topics that have none, from path and description; returns how many."""
        topics = checkpointed(self._topics(user_id))
        bare = topics.filter("embedding is null")
        n = bare.count()
        if n:
            said = bare.join(tree.paths(topics).select("topic_id", "path"), "topic_id", "left").select("topic_id", F.concat_ws(" ", "path", "description").alias("text"))
            vectors = self._embed(said, "topic_id", "text").withColumnRenamed("embedding", "_v")
            self.store.write("topics", topics.join(vectors, "topic_id", "left").withColumn("embedding", F.coalesce("embedding", "_v")), user_id)
        return n

    process_queue = process

    def _topics(self, user_id: str) -> DataFrame:
        return self.store.read("topics", user_id)

    def _memories(self, user_id: str) -> DataFrame:
        return self.store.read("memories", user_id)

    def _save(self, user_id: str, done: list[tuple]) -> None:
        raw = self.spark.createDataFrame(done, "job_id bigint, ts timestamp_ntz, raw_msg string, doc string")
        old_msgs = self.store.read("messages")
        msgs = checkpointed(next_ids(raw.withColumn("user_id", F.lit(user_id)), old_msgs, ["job_id"], "id"))
        self.store.append("messages", msgs.select("id", "user_id", "ts", "raw_msg"), user_id)
        flat = queue.flatten_extraction(msgs.select("job_id", F.from_json("doc", _DOC).alias("doc")))
        flat = flat.withColumn("user_id", F.lit(user_id)).filter(F.trim("content") != "")
        new = checkpointed(queue.dedup_memories(flat, self._memories(user_id), ("job_id", "bucket", "pos")))
        if new.isEmpty():
            return
        chains = checkpointed(new.select("chain").distinct().withColumn("chain_id", F.xxhash64("chain")))
        top = self.store.read("topics").agg(F.coalesce(F.max("topic_id"), F.lit(0))).first()[0]
        to, grown = tree.resolve(checkpointed(self._topics(user_id).select("topic_id", "parent_id", "name")), chains, top + 1)
        grown = checkpointed(grown)
        known = self._topics(user_id).drop("parent_id", "name")
        touched = to.select("topic_id", F.lit(True).alias("_touched")).distinct()
        merged = grown.join(known, "topic_id", "left").join(touched, "topic_id", "left").withColumn("user_id", F.lit(user_id))
        merged = merged.withColumn("embedding", F.when(F.col("_touched").isNull(), F.col("embedding")))  # a touched leaf is embedded anew
        self.store.write("topics", merged, user_id)
        rows = new.join(chains, "chain").join(to, "chain_id").join(msgs.select("job_id", "ts", F.col("id").alias("message_id")), "job_id")
        rows = rows.withColumn("status", F.when(F.col("memory_type") == "decision", "active"))
        rows = checkpointed(next_ids(rows, self.store.read("memories"), ["job_id", "bucket", "memory_type", "pos"]))
        vectors = self._embed(rows.select("id", "content"), "id", "content")
        self.store.append("memories", rows.join(vectors, "id", "left").select("id", "user_id", "memory_type", "content", "ts", "embedding", "topic_id", "message_id", "status"), user_id)

    def _judge(self, user_id: str) -> None:
        mine = self._memories(user_id).filter("memory_type = 'decision'")
        live = D.live(mine).filter("embedding is not null")
        if live.isEmpty():
            return
        due = D.to_analyse(live.join(decision_clusters(live), ["user_id", "id"]))
        verdicts = checkpointed(self.judge(due))
        if verdicts.isEmpty():
            return
        every = self._memories(user_id)
        now = F.when(F.col("new_status").isNotNull(), F.current_timestamp().cast("timestamp_ntz")).otherwise(F.col("last_validated_at"))
        changed = every.join(verdicts, "id", "left").withColumn("last_validated_at", now).withColumn("context", F.when(F.col("new_status").isNotNull(), F.coalesce("context", F.lit("judged by recency"))).otherwise(F.col("context"))).withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
        self.store.write("memories", changed, user_id)

    def reorganize_tree(self, user_id: str = "default", dry_run: bool = False) -> dict:
        """Planner's changes, root and sibling merges, chain collapse and pruning, in one pass; memories follow redirects."""
        topics = checkpointed(self._topics(user_id).select("topic_id", "parent_id", "name"))
        counts = checkpointed(tree.memory_counts(self._memories(user_id)))
        text = "\n".join(r.tree for r in tree.render(topics, counts).orderBy("root").collect())
        changed, redirects = tree.apply_changes(topics, tree.parse_changes(self.planner(text)))
        moves = [redirects]
        for survivors in (lambda t: tree.root_survivors(t), lambda t: tree.sibling_survivors(t, counts)):
            t = checkpointed(changed)
            go = checkpointed(survivors(t).filter("topic_id <> survivor").select("topic_id", F.col("survivor").alias("kept")))
            moves.append(go)
            t = t.join(go.select("topic_id"), "topic_id", "left_anti").join(go.select(F.col("topic_id").alias("parent_id"), F.col("kept").alias("_k")), "parent_id", "left")
            changed = t.select("topic_id", F.coalesce("_k", "parent_id").alias("parent_id"), "name")
        changed, folded = tree.collapse_chains(checkpointed(changed))
        moves.append(folded)
        memories = self._memories(user_id)
        for go in moves:
            go = checkpointed(go)
            memories = memories.join(go, "topic_id", "left").withColumn("topic_id", F.coalesce("kept", "topic_id")).drop("kept")
        memories = checkpointed(memories)
        kept = checkpointed(tree.prune_empty(checkpointed(changed), tree.memory_counts(memories)))
        report = {"topics_before": topics.count(), "topics_after": kept.count()}
        if not dry_run:
            rest = self._topics(user_id).drop("parent_id", "name")
            self.store.write("topics", kept.join(rest, "topic_id", "left").withColumn("user_id", F.lit(user_id)), user_id)
            self.store.write("memories", memories, user_id)
            now = self._topics(user_id)
            self.store.write("source_map", tree.purge_source_map(self.store.read("source_map", user_id), now), user_id)
            self._refresh(user_id)
        return report

    def summarize(self, user_id: str = "default") -> int:
        """Descriptions of leaves over the gate, then of their parents level by level; returns how many were written.

        A leaf is created, updated from what its stored summary lacks, or rebuilt after REBUILD_AFTER updates. A parent is patched
        with its children that changed since; one with a single child takes that child's description.
        """
        items = checkpointed(summaries.leaf_items(self._memories(user_id)))
        sizes = items.groupBy("topic_id").agg(F.count("*").alias("n"))
        if sizes.filter(F.col("n") > summaries.GATE).isEmpty():
            return 0
        topics = checkpointed(self._topics(user_id))
        stored, state = self.store.read("leaf_summary_items", user_id), self.store.read("leaf_state", user_id)
        delta = checkpointed(summaries.leaf_delta(items, stored))
        d = topics.select("topic_id", "description").join(sizes, "topic_id").join(state, "topic_id", "left").join(delta.select("topic_id", F.lit(True).alias("_c")).distinct(), "topic_id", "left")
        updates = F.coalesce("desc_update_count", F.lit(0))
        mode = summaries.route_leaf(F.col("n"), F.coalesce(F.trim("description"), F.lit("")) != "", F.coalesce("desc_dirty", F.lit(False)), updates, F.coalesce("_c", F.lit(False)))
        d = checkpointed(d.select("topic_id", "description", updates.alias("updates"), mode.alias("mode")))
        work = d.filter("mode <> 'none'")
        whole = summaries.format_leaf(items.join(work.filter("mode <> 'update'").select("topic_id"), "topic_id", "left_semi"))
        added = summaries.format_leaf(delta.join(work.filter("mode = 'update'").select("topic_id"), "topic_id", "left_semi"))
        asked = work.join(whole.unionByName(added), "topic_id").select("topic_id", "mode", F.when(F.col("mode") == "update", F.concat_ws("\n", "description", "text")).otherwise(F.col("text")).alias("text"))
        said = [(r.topic_id, self.summarizer(r.text.split("\n"), 2_000), r.mode) for r in asked.toLocalIterator()]  # a model's answers, one by one
        answers = checkpointed(self.spark.createDataFrame(said, "topic_id bigint, new string, mode string"))
        after = checkpointed(summaries.write_back(d.select("topic_id", "description", "updates"), answers))
        told = answers.filter(F.trim("new") != "").select("topic_id")
        self.store.write("leaf_summary_items", checkpointed(stored.join(told, "topic_id", "left_anti").unionByName(items.join(told, "topic_id", "left_semi"))), user_id)
        self.store.write("leaf_state", after.select("topic_id", F.lit(False).alias("desc_dirty"), F.col("updates").alias("desc_update_count")), user_id)
        now = F.current_timestamp().cast("timestamp_ntz")
        new = after.join(told, "topic_id", "left_semi").select("topic_id", F.col("description").alias("_new"))
        topics = checkpointed(topics.join(new, "topic_id", "left").withColumn("ts", F.when(F.col("_new").isNotNull(), now).otherwise(F.col("ts"))).withColumn("embedding", F.when(F.col("_new").isNull(), F.col("embedding"))).withColumn("description", F.coalesce("_new", "description")).drop("_new"))
        topics, n = self._describe_parents(user_id, topics)
        self.store.write("topics", topics, user_id)
        self._refresh(user_id)
        return len(said) + n

    def _describe_parents(self, user_id: str, topics: DataFrame) -> tuple[DataFrame, int]:
        """Topics with their parents described from the deepest level up, and how many were."""
        levels = checkpointed(tree.paths(topics).select("topic_id", "level"))
        deepest, written = levels.agg(F.coalesce(F.max("level"), F.lit(0))).first()[0], 0
        source_map = checkpointed(self.store.read("source_map", user_id))
        for level in range(int(deepest) - 1, -1, -1):
            here = levels.filter(F.col("level") == level).select("topic_id")
            children = topics.filter("parent_id is not null").select("parent_id", F.col("topic_id").alias("child_id"), "description", "ts").join(here.withColumnRenamed("topic_id", "parent_id"), "parent_id", "left_semi")
            parents = topics.join(here, "topic_id", "left_semi").select(F.col("topic_id").alias("parent_id"), F.when(F.col("description").isNotNull(), F.col("ts")).alias("ts"))
            changed = checkpointed(summaries.child_delta(children, source_map, parents))
            if changed.isEmpty():
                continue
            said = [(r.parent_id, r.child_id, "modify", self.summarizer([r.text], 500)) for r in changed.toLocalIterator()]
            patch = self.spark.createDataFrame(said, "parent_id bigint, child_id bigint, action string, new_text string")
            source_map = checkpointed(summaries.patch_source_map(source_map, patch, changed))
            touched = changed.select("parent_id").distinct()
            single = summaries.inherit_single(children).withColumnRenamed("description", "_one")
            new = touched.join(summaries.describe(source_map), "parent_id", "left").join(single, "parent_id", "left").select(F.col("parent_id").alias("topic_id"), F.coalesce("_one", "description").alias("_new"))
            fresh = F.col("_new").isNotNull()
            topics = topics.join(new, "topic_id", "left").withColumn("ts", F.when(fresh, F.current_timestamp().cast("timestamp_ntz")).otherwise(F.col("ts"))).withColumn("embedding", F.when(~fresh, F.col("embedding")))
            topics = checkpointed(topics.withColumn("description", F.coalesce("_new", "description")).drop("_new"))
            written += touched.count()
        self.store.write("source_map", source_map, user_id)
        return topics, written

    def _refresh(self, user_id: str) -> None:
        """Forgets what is cached of the user's index."""
        for frame in self._indexes.pop(user_id, ()):
            frame.unpersist()

    refresh_tree_cache = _refresh

    def _index(self, user_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """Pool, postings by family, statistics, corpus row and families of a user, cached.

        Postings and statistics are stored tables. Entries that they lack are appended; only where some have gone or changed are
        they written anew, so a new process starts from what is stored.
        """
        if user_id not in self._indexes:
            topics = checkpointed(self._topics(user_id))
            paths = tree.paths(topics.select("topic_id", "parent_id", "name")).select("topic_id", "path")
            mem = index.build_pool(self._memories(user_id), paths).select("entry_key", "id", "memory_type", "status", "path", "content", "text", "ts", "embedding")
            nodes = index.summary_entries(topics, paths).select("entry_key", F.col("topic_id").alias("id"), F.lit("node").alias("memory_type"), F.lit(None).cast("string").alias("status"), "path", F.col("description").alias("content"), "text", "ts", "embedding")
            pool = mem.unionByName(nodes).persist()
            own = pool.select("entry_key", F.xxhash64("text").alias("sig"))
            post, stats = self.store.read("postings", user_id), self.store.read("doc_stats", user_id)
            fresh = checkpointed(own.join(stats.select("entry_key", "sig"), ["entry_key", "sig"], "left_anti"))
            toks = index.tokens(pool.join(fresh, "entry_key", "left_semi"), "entry_key")
            more = toks.groupBy("entry_key", "token", "lemma").agg(F.count("*").alias("tf"))
            sized = fresh.join(index.doc_stats(toks, "entry_key"), "entry_key", "left").withColumn("dl", F.coalesce("dl", F.lit(0)))
            gone = not stats.join(own, ["entry_key", "sig"], "left_anti").isEmpty()
            if gone:
                kept = checkpointed(stats.join(own, ["entry_key", "sig"], "left_semi"))
                self.store.write("postings", checkpointed(post.join(kept, "entry_key", "left_semi").unionByName(more)), user_id)
                self.store.write("doc_stats", kept.unionByName(sized), user_id)
            elif not fresh.isEmpty():
                self.store.append("postings", more, user_id)
                self.store.append("doc_stats", sized, user_id)
            post = self.store.read("postings", user_id)
            stats = self.store.read("doc_stats", user_id).filter("dl > 0").select("entry_key", "dl").persist()
            fam = index.families(post).persist()
            by_family = index.weighted(post.join(fam, "token").groupBy("family", "entry_key").agg(F.sum("tf").alias("tf")), stats, "entry_key").persist()
            n, avg_dl = index.corpus(stats, pool).first()
            self._sizes[user_id] = n
            corp = self.spark.sql("SELECT CAST(:n AS BIGINT) AS n, CAST(:avg_dl AS DOUBLE) AS avg_dl", args={"n": n, "avg_dl": avg_dl})
            self._indexes[user_id] = (pool, by_family, stats, corp, fam)
            while len(self._indexes) > INDEXES:
                for frame in self._indexes.popitem(last=False)[1]:
                    frame.unpersist()
        self._indexes.move_to_end(user_id)
        return self._indexes[user_id]

    def search(self, query: str, user_id: str = "default", top_k_corpus: int = retrieval.CORPUS_K, use_reranker: bool = False) -> RetrievalResult:
        """Fused lexical and vector search, quotas by type, decision anchors, and the assembled context."""
        if not query or not query.strip():
            raise InvalidRequest("empty query")
        try:
            return self._search(query, user_id, top_k_corpus, use_reranker)
        except InvalidRequest:
            raise
        except Exception as e:
            raise RetrievalError(f"search failed: {e}") from e

    def _search(self, query: str, user_id: str, top_k: int, rerank: bool) -> RetrievalResult:
        said = self.denoise(query) if "\n" in query else query
        q = self.spark.sql("SELECT 0 AS qid, :said AS text", args={"said": said})
        kind = q.select(X.classify_query(F.col("text"))).first()[0]
        pool, post, stats, corp, fam = self._index(user_id)
        if not self._sizes[user_id]:
            return RetrievalResult("", {"entries": []}, HINT, kind)
        lexical = index.bm25(post, stats, corp, self._asked(index.tokens(q, "qid"), fam, "qid"), "entry_key")
        vector = self._embed(q, "qid", "text").first()["embedding"]
        cosine = X.dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))
        scored = pool.select("entry_key", "memory_type", "id", F.round(F.coalesce(cosine, F.lit(0.0)), 9).alias("cosine")).join(lexical, "entry_key", "left").withColumn("bm25", F.round(F.coalesce("bm25", F.lit(0.0)), 9))
        fused = retrieval.fuse(scored, "entry_key", rows=self._sizes[user_id], narrow=True).persist()  # keys and scores only; texts join what is left of them
        try:
            best = retrieval.partitioned_topk(fused, "entry_key", kind == "broad_overview")
            if rerank:
                best = self.reranker(query, best.join(pool.select("entry_key", "path", "content"), "entry_key")).withColumn("rrf", F.col("score"))
            hits = [r.asDict() for r in retrieval.quotas(best, "entry_key", top_k).select("entry_key", "memory_type", "tier", "place", "rrf").collect()]  # bounded by the quotas
            near = self._expand(hits, fused, pool, post, stats, corp, fam)
        finally:
            fused.unpersist()
        chosen = self.spark.createDataFrame(pa.table({"entry_key": pa.array([h["entry_key"] for h in hits + near], pa.string()), "tier": pa.array([h["tier"] for h in hits + near], pa.int32()), "place": pa.array([h["place"] for h in hits + near], pa.int64())}))
        full = pool.join(F.broadcast(chosen), "entry_key").withColumn("entry_id", F.col("id")).withColumn("day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("")))
        rows = retrieval.context_items(full).select("section", "memory_type", "tier", "place", "entry_id", "line").collect()
        rows.sort(key=lambda r: (r.section or 9, r.tier, r.place, r.entry_id))
        parts: dict[str, list[str]] = {}
        for r in rows:
            parts.setdefault(r.memory_type.upper() if r.memory_type != "node" else "SUMMARY", []).append(r.line)
        context = "\n\n".join(f"== {k} ==\n" + "\n".join(v) for k, v in parts.items())
        trace = {"entries": [f"{r.memory_type}:{r.entry_id}" for r in rows], "anchors": [r.entry_id for r in rows if r.tier == 0], "expansions": {h["anchor_id"]: [x["entry_key"] for x in near if x["anchor_id"] == h["anchor_id"]] for h in near}}
        return RetrievalResult(context, trace, HINT, kind)

    def _asked(self, words: DataFrame, fam: DataFrame, qid: str) -> DataFrame:
        """(qid, family, qn) of words (qid, token, lemma), as a local frame: those of a query, or of a few anchors, whose texts the context holds anyway."""
        said = words.groupBy(qid, "token", "lemma").agg(F.count("*").alias("n")).collect()
        asked = self.spark.createDataFrame(pa.table({"token": pa.array(sorted({x for r in said for x in (r.token, r.lemma)}), pa.string())}))
        names = {r.token: r.family for r in fam.join(F.broadcast(asked), "token").select("token", "family").collect()}
        n: Counter = Counter()
        for r in said:
            n[r[qid], names.get(r.token, names.get(r.lemma, r.token))] += r.n
        kind = pa.int32() if words.schema[qid].dataType.typeName() == "integer" else pa.string()
        return self.spark.createDataFrame(pa.table({qid: pa.array([k[0] for k in n], kind), "family": pa.array([k[1] for k in n], pa.string()), "qn": pa.array(list(n.values()), pa.int64())}))

    def _expand(self, hits: list[dict], fused: DataFrame, pool: DataFrame, post: DataFrame, stats: DataFrame, corp: DataFrame, fam: DataFrame) -> list[dict]:
        """Knowledge and episodes near each decision anchor that neither the hits nor an earlier anchor has; tier 3, by anchor."""
        anchors = sorted((h for h in hits if h["tier"] == 0), key=lambda h: h["place"])
        if not anchors:
            return []
        ranks = self.spark.createDataFrame(pa.table({"anchor_id": [h["entry_key"] for h in anchors], "anchor_rank": pa.array([h["place"] for h in anchors], pa.int64())}))
        said = pool.join(F.broadcast(ranks), F.col("entry_key") == F.col("anchor_id")).select("anchor_id", "content")
        words = self._asked(index.tokens(said, "anchor_id", "content"), fam, "anchor_id")
        others = fused.filter(F.col("memory_type").isin("knowledge", "episodic")).select("entry_key", "rrf")
        scores = index.bm25_each(post, stats, corp, words, "anchor_id", "entry_key").join(others, "entry_key")
        kept = retrieval.keep_expansions(retrieval.expansions(scores, "entry_key"), "entry_key").join(F.broadcast(ranks), "anchor_id")
        claimed = self.spark.createDataFrame(pa.table({"entry_key": [h["entry_key"] for h in hits]}))
        out = retrieval.dedup_expansions(kept, claimed, "entry_key").select("anchor_id", "anchor_rank", "entry_key", "kept").collect()  # five an anchor at most
        return [{"entry_key": r.entry_key, "anchor_id": r.anchor_id, "tier": 3, "place": r.anchor_rank * 100 + r.kept} for r in out]

    def inspect(self, user_id: str = "default", view: str = "memories", memory_type: str | None = None):
        """Memories with their topic (or General) as a DataFrame, the topic tree as nested dicts, or both by name (view all)."""
        if view not in ("memories", "tree", "all"):
            raise InvalidRequest("view is memories, tree or all")
        if memory_type is not None and memory_type not in MEMORY_TYPES:
            raise InvalidRequest(f"memory_type is one of {', '.join(MEMORY_TYPES)}")
        if view == "tree":
            return self.tree(user_id)
        if view == "all":
            return {"memories": self.inspect(user_id, memory_type=memory_type), "tree": self.tree(user_id)}
        m = self._memories(user_id).join(self._topics(user_id).select("topic_id", F.col("name").alias("topic")), "topic_id", "left")
        m = m if memory_type is None else m.filter(F.col("memory_type") == memory_type)
        return m.select("id", "memory_type", "content", F.coalesce("topic", F.lit("General")).alias("topic"), "status", "ts")

    def tree(self, user_id: str = "default") -> list[dict]:
        """Nested {id, name, children} of a tree of at most TREE_ROWS topics."""
        rows = self._topics(user_id).select("topic_id", "parent_id", "name").limit(tree.TREE_ROWS).collect()
        nodes = {r.topic_id: {"id": r.topic_id, "name": r.name, "children": []} for r in rows}
        for r in sorted(rows, key=lambda r: r.topic_id):
            if r.parent_id in nodes:
                nodes[r.parent_id]["children"].append(nodes[r.topic_id])
        return [nodes[r.topic_id] for r in sorted(rows, key=lambda r: r.topic_id) if r.parent_id is None]

    def forget(self, memory_id: int, user_id: str = "default") -> bool:
        mine, every = F.col("id") == memory_id, self._memories(user_id)
        if every.filter(mine).isEmpty():
            return False
        self.store.write("memories", every.filter(~mine), user_id)
        self._refresh(user_id)
        return True

    delete = forget

    def reset(self, user_id: str) -> None:
        """Removes all of a user's rows, messages included."""
        self._refresh(user_id)
        for name in SCHEMAS:
            self.store.remove(name, user_id)

    def repair(self, user_id: str = "default") -> int:
        """Gives detached memories a topic; returns how many."""
        mine = self._memories(user_id)
        found = checkpointed(D.repair(mine, self._topics(user_id).select("topic_id", "embedding")).select("id", F.col("topic_id").alias("_t")))
        n = found.count()
        if n:
            self.store.write("memories", mine.join(found, "id", "left").withColumn("topic_id", F.coalesce("topic_id", "_t")).drop("_t"), user_id)
            self._refresh(user_id)
        return n

    def denoise(self, text: str) -> str:
        q = self.spark.createDataFrame([(0, text)], "doc_id bigint, text string")
        return denoise.compressed(q).first()["compressed"]
