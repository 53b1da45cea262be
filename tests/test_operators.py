from __future__ import annotations

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from palimpsest.operators import cluster, decisions, denoise, evaluate, index, queue, retrieval, summaries, tree
from palimpsest.sources.tables import Warehouse, checkpointed, next_ids, vector_from_blob

TINY = [(1, None, "Computer Science"), (2, 1, "Python"), (3, 1, "Algorithms"), (4, None, "Health"), (5, 4, "Sleep")]


@pytest.fixture(scope="module")
def tiny(spark):
    return checkpointed(spark.createDataFrame(TINY, "topic_id bigint, parent_id bigint, name string"))


def test_paths_closure_leaves(tiny):
    assert {r.topic_id: (r.path, r.level) for r in tree.paths(tiny).collect()}[2] == ("Computer Science > Python", 1)
    assert {(r.ancestor, r.descendant) for r in tree.closure(tiny).collect()} >= {(1, 3), (4, 5), (5, 5)}
    assert rows(tree.leaves(tiny).select("topic_id")) == [(2,), (3,), (5,)]


def test_render(spark, tiny):
    counts = spark.createDataFrame([(2, 3)], "topic_id bigint, n bigint")
    got = {r.root: r.tree for r in tree.render(tiny, counts).collect()}
    assert got[1] == "Computer Science [children:2]\n\tPython [memories:3]\n\tAlgorithms [memories:0]"


def test_resolve_reuses_and_creates(spark, tiny):
    chains = checkpointed(spark.createDataFrame([(1, ["computer science", "Pythons"]), (2, ["Health", "Diet"]), (3, ["Health"])], "chain_id bigint, chain array<string>"))
    to, out = tree.resolve(tiny, chains, 100)
    got = {r.chain_id: r.topic_id for r in to.collect()}
    names = {r.topic_id: r.name for r in out.collect()}
    assert got[1] == 2 and names[got[2]] == "Diet" and names[got[3]] == "General Health"


def test_enforce_leaves(spark, tiny):
    counts = spark.createDataFrame([(1, 2), (2, 1)], "topic_id bigint, n bigint")
    out, redirect = tree.enforce_leaves(tiny, counts, 50)
    assert [(r.topic_id, r.leaf) for r in redirect.collect()] == [(1, 50)]
    assert {r.name for r in out.filter("parent_id = 1").collect()} == {"Python", "Algorithms", "General Computer Science"}


def test_changes_rename_merge_move_new_cycle():
    f = tree.Forest(TINY)
    f.apply([{"id": 2, "name": "Py"}, {"id": 3, "merged_into_id": 2}, {"id": 5, "parent_id": "NEW_bodyCare"}, {"id": 1, "parent_id": 2}, {"id": 77, "name": "x"}])
    got = {i: (p, n) for i, p, n in f.rows()}
    assert got[2] == (1, "Py") and 3 not in got and f.at(3) == 2
    assert got[got[5][0]][1] == "Body Care" and got[1][0] is None


def test_merge_into_own_descendant():
    f = tree.Forest([(1, None, "a"), (2, 1, "b"), (3, 2, "c")]).apply([{"id": 1, "merged_into_id": 2}])
    assert f.rows() == [(2, None, "b"), (3, 2, "c")]


def test_truncated_changes():
    assert tree.parse_changes('```json\n{"modified_nodes_only": [{"id": 1, "name": "a"}, {"id": 2, "na') == [{"id": 1, "name": "a"}]
    assert tree.parse_changes("no json") == []


def test_collapse_deep_chain(spark):
    t = checkpointed(spark.createDataFrame([(1, None, "Data"), (2, 1, "General Data"), (3, 2, "Big Data"), (4, 3, "Spark")], "topic_id bigint, parent_id bigint, name string"))
    out, redirect = tree.collapse_chains(t)
    assert [(r.topic_id, r.parent_id) for r in out.collect()] == [(1, None)]
    assert {r.kept for r in redirect.collect()} == {1} and redirect.count() == 3


def test_collapse_chains_deeper_than_recursion_goes(spark):
    n = 150
    rows_ = [(1, None, "top"), (2, 1, "a"), (3, 1, "b")] + [(i, i - 1 if i > 4 else 2, f"n{i}") for i in range(4, n)]
    out, redirect = tree.collapse_chains(checkpointed(spark.createDataFrame(rows_, "topic_id bigint, parent_id bigint, name string")))
    assert [(r.topic_id, r.parent_id) for r in out.orderBy("topic_id").collect()] == [(1, None), (2, 1), (3, 1)]
    assert redirect.count() == n - 4 and {r.kept for r in redirect.collect()} == {2}
    with pytest.raises(ValueError, match="cycle"):
        tree.collapse_chains(checkpointed(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "topic_id bigint, parent_id bigint, name string")))


def test_greedy_batches_of_a_large_group(spark):
    rng = np.random.default_rng(10)
    data = [(g, i, int(n)) for g in ("a", None) for i, n in enumerate(rng.choice((0, 1, 3, 40, 90, 120), 60_000 if g else 500))] + [("b", 1, None), ("b", 2, 500), ("c", 1, 10), ("c", 2, None), ("c", 3, 200), ("d", 1, 500), ("d", 2, 0)]
    want, last, b, total = [], 0, 0, 0
    for g, i, n in data:
        if g != last:
            last, b, total = g, 0, 0
        if b == 0 or (None not in (total, n) and total + n > 100):
            b, total = b + 1, n
        else:
            total = None if None in (total, n) else total + n
        want.append((b, i, g))
    began = time.perf_counter()
    got = queue.greedy_batches(spark.createDataFrame(data, "g string, i bigint, n bigint"), "g", "i", "n", 100)
    assert rows(got) == sorted(((b, g, i) for b, i, g in want), key=repr)
    assert time.perf_counter() - began < 60


def test_prune_and_survivors(spark, tiny):
    counts = spark.createDataFrame([(2, 1)], "topic_id bigint, n bigint")
    assert rows(tree.prune_empty(tiny, counts).select("topic_id")) == [(1,), (2,)]
    dup = spark.createDataFrame([(1, None, "Python"), (2, None, "pythons")], "topic_id bigint, parent_id bigint, name string")
    got = tree.sibling_survivors(dup, spark.createDataFrame([(2, 5)], "topic_id bigint, n bigint")).collect()
    assert {r.survivor for r in got} == {2}


def jobs(spark, data):
    return spark.createDataFrame([("u", i, day, size) for i, (day, size) in enumerate(data, 1)], "user_id string, id bigint, day date, size bigint")


def test_batches_break_rules(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    d = queue.batches(jobs(spark, [(a, 4), (a, 4), (a, 4), (b, 1), (b, 30), (b, 1)]), soft=10, hard=20)
    assert [r.batch for r in d.orderBy("id").collect()] == [1, 1, 1, 4, 5, 6]


def test_fold_joins_small_neighbours(spark):
    a = dt.date(2024, 1, 1)
    j = jobs(spark, [(a, 6), (a, 6), (a, 1)])
    d = queue.batches(j, soft=10, hard=13)
    assert [r.batch for r in d.orderBy("id").collect()] == [1, 1, 3]
    assert [r.batch for r in queue.fold_batches(j, d, 13).orderBy("id").collect()] == [1, 1, 1]


def test_consolidate_two_jobs(spark):
    ts = dt.datetime(2024, 1, 1)
    q = spark.createDataFrame([("alice", 1, ts, "one"), ("alice", 2, ts, "two"), ("bob", 3, ts, "x")], "user_id string, id bigint, ts timestamp_ntz, raw_prompt string")
    got = {r.id: (r.raw_prompt, r.jobs) for r in queue.consolidate(q).collect()}
    assert got == {1: ("one\n\ntwo", 2), 3: ("x", 1)}


def test_retries(spark):
    q = spark.createDataFrame([(1, "failed", 4), (2, "failed", 5), (3, "done", 0)], "id bigint, status string, retry_count int")
    assert [r.id for r in queue.pick_jobs(q).collect()] == [1]
    out = queue.mark(q, spark.createDataFrame([(1, "failed"), (3, "done")], "id bigint, new_status string"))
    assert {(r.id, r.retry_count) for r in out.collect()} == {(1, 5), (2, 5)}


def test_turns_pairs_chunks(spark):
    p = spark.createDataFrame([(1, "preamble\nUser: a\nmore\nAssistant: b\nAssistant: c\nUser: d")], "id bigint, raw_prompt string")
    t = queue.parse_turns(p)
    assert [(r.role, r.content) for r in t.orderBy("n").collect()] == [("User", "a\nmore"), ("Assistant", "b"), ("Assistant", "c"), ("User", "d")]
    pairs = queue.pair_turns(t)
    assert [r.text for r in pairs.orderBy("pair").collect()] == ["User: a\nmore\nAssistant: b", "Assistant: c", "User: d"]
    c = queue.chunk_pairs(pairs, size=10, tail=100)
    assert {r.chunk for r in c.collect()} == {1, 2} or {r.chunk for r in c.collect()} == {1}


def test_extraction_and_dedup(spark):
    kind = "topics_root array<string>, memory array<struct<topics_branch:array<string>,user:array<string>,fact:array<string>,epis:array<string>,decision:array<string>>>"
    raw = ['{"topics_root":["A"],"memory":[{"topics_branch":["B"],"user":["x"],"fact":["x","X "],"epis":[],"decision":["go"]},{"topics_branch":[],"user":["x"],"fact":[],"epis":[],"decision":[]}]}', '{"topics_root":[],"memory":[]}', "broken"]
    d = spark.createDataFrame(list(enumerate(raw)), "job_id bigint, raw string").select("job_id", F.from_json("raw", kind).alias("doc"))
    flat = queue.flatten_extraction(d).withColumn("user_id", F.lit("u"))
    assert flat.count() == 5
    stored = spark.createDataFrame([("u", "decision", "GO")], "user_id string, memory_type string, content string")
    got = queue.dedup_memories(flat, stored, ("job_id", "bucket", "pos"))
    assert rows(got.select("memory_type", "content")) == [("x", "knowledge"), ("x", "user")] or got.count() == 2


def test_bm25_repeated_and_missing_terms(spark):
    e = spark.createDataFrame([(0, "tracking tracking x"), (1, "track y z")], "entry_id bigint, text string")
    toks = index.tokens(e)
    fam = index.families(toks)
    names = {r.token: r.family for r in fam.collect()}
    assert names["tracking"] == names["track"]
    post = index.postings(toks, fam)
    stats = index.doc_stats(toks)
    q = spark.createDataFrame([(names["track"],)], "family string")
    s = {r.entry_id: r.bm25 for r in index.bm25(post, stats, index.corpus(stats, e), q).collect()}
    assert s[0] > s[1] > 0
    assert index.bm25(post, stats, index.corpus(stats, e), spark.createDataFrame([("none",)], "family string")).count() == 0


def test_incremental_equals_rebuild(spark):
    e = spark.createDataFrame([(i, f"a b{i % 3} c{i}") for i in range(20)], "entry_id bigint, text string")
    toks = index.tokens(e.filter("entry_id < 10"))
    post, stats = index.ingest(index.postings(toks), index.doc_stats(toks), e)
    full = index.tokens(e)
    assert rows(post) == rows(index.postings(full)) and rows(stats) == rows(index.doc_stats(full))


def test_quota_tiers(spark):
    data = [(i, t, round(1 - i / 100, 9)) for i, t in enumerate(["decision"] * 6 + ["user"] * 12 + ["episodic"] * 12 + ["knowledge"] * 12)]
    c = spark.createDataFrame(data, "entry_id bigint, memory_type string, rrf double")
    got = retrieval.quotas(c, top_k=30).collect()
    assert sum(r.tier == 0 for r in got) == 3
    assert sum(r.memory_type == "user" and r.tier == 1 for r in got) == 8
    assert sum(r.tier > 0 for r in got) == 30


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {(r.vec_id, r.other) for r in cluster.knn(d, 5, block=16).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    assert got == {(i, int(j)) for i in range(60) for j in np.argsort(-s[i])[:5]}


def test_clustering_invariants():
    x = np.random.default_rng(2).standard_normal((300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = cluster.sized_communities(x, target=40, largest=80), cluster.sized_communities(x, target=40, largest=80)
    assert (a == b).all() and len(a) == 300 and np.bincount(a).max() <= 160
    lab = cluster.complete_linkage(np.array([[1, 0], [1, 0.01], [0, 1.0]]) / np.array([[1], [1.00005], [1]]), 0.25)
    assert lab.tolist() == [0, 0, 1]
    packs = cluster.pack_batches(np.eye(4), np.array([5, 5, 5, 5]), 10)
    assert sorted(c for p in packs for c in p) == [0, 1, 2, 3] and all(len(p) <= 2 for p in packs)


def test_repair_prefers_siblings(spark):
    m = spark.createDataFrame([(1, 9, 7, [1.0, 0.0]), (2, 9, None, [1.0, 0.1]), (3, None, None, [0.0, 1.0]), (4, None, None, None)], "id bigint, message_id bigint, topic_id bigint, embedding array<double>")
    t = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0])], "topic_id bigint, embedding array<double>")
    assert {(r.id, r.topic_id, r.how) for r in decisions.repair(m, t).collect()} == {(2, 7, "sibling"), (3, 8, "topic")}


def test_denoise_blocks_and_logs(spark):
    log = "\n".join(f"2024-01-01 10:00:0{i} INFO from 10.0.0.{i} ok" for i in range(4))
    code = "import os\n\n@wrap\ndef f(a,\n      b):\n    x = 1\n    return x"
    d = spark.createDataFrame([(1, "Just a chat."), (2, log), (3, code), (4, ""), (5, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.compressed for r in denoise.compressed(d).collect()}
    assert got[1] == "Just a chat." and "(repeated 3 times)" in got[2] and got[2].startswith(denoise.LOG_TITLE)
    assert "def f(a," in got[3] and "x = 1" not in got[3] and got[4] == "" and got[5] is None


def test_fuzzy_mask_order(spark):
    from palimpsest.functions import text as X

    d = spark.createDataFrame([("INFO user42 at 10.1.2.3 said 'hi' [x] 0xff 77",)], "t string")
    assert d.select(X.fuzzy_mask(F.col("t"), denoise.HEADER)).first()[0] == "user42 at <IP> said <STR> <META> <MEM> 77".replace("user42", "<ID>").replace(" 77", " <ID>")


def test_summaries(spark):
    ts = dt.datetime(2024, 1, 1, 10)
    kind = "id bigint, topic_id bigint, memory_type string, content string, ts timestamp_ntz, status string, context string, last_validated_at timestamp_ntz"
    m = spark.createDataFrame([(1, 1, "user", "a", ts, None, None, None), (2, 1, "decision", "b", ts, "active", "c", ts), (3, None, "user", "lost", ts, None, None, None)], kind)
    items = summaries.leaf_items(m)
    assert items.count() == 2
    stored = items.withColumn("text", F.when(F.col("kind") == "decision", "old").otherwise(F.col("text")))
    assert [r.mem_id for r in summaries.leaf_delta(items, stored).collect()] == [2]
    assert summaries.leaf_delta(items, stored.filter("mem_id = 2")).count() == 2  # late items count


def test_evaluation_parsing(spark):
    d = spark.createDataFrame([('```json\n{"winner":"Ours","scores":[1,0]}\n```',), ("oops",), (None,)], "raw string").select(evaluate.parse_verdict(F.col("raw")).alias("v"))
    got = d.select("v.winner", evaluate.rubric_score(F.col("v.scores")).alias("s")).collect()
    assert [(r.winner, r.s) for r in got] == [("ours", 0.5), ("error", None), ("error", None)]


def test_warehouse_versions(spark, tmp_path):
    w = Warehouse(spark, f"file://{tmp_path}/wh")
    assert w.read("messages").count() == 0
    ts = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([("u", ts, "a")], "user_id string, ts timestamp_ntz, raw_msg string")
    w.append("messages", next_ids(one, w.read("messages"), ["ts"]))
    w.append("messages", next_ids(one, w.read("messages"), ["ts"]))
    w.write("messages", w.read("messages").filter("id > 1"))
    assert [r.id for r in w.read("messages").collect()] == [2]


def test_vector_from_blob(spark):
    v = np.array([0.5, -2.0, 3.25e-3, 0.0], np.float32)
    d = spark.createDataFrame([(bytearray(v.tobytes()),), (bytearray(),), (None,)], "b binary").select(vector_from_blob(F.col("b")).alias("v")).collect()
    assert np.allclose(d[0].v, v) and d[1].v == []


def test_merge_into_a_deeper_descendant_lifts_the_bridge():
    f = tree.Forest([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, "d")]).apply([{"id": 1, "merged_into_id": 3}])
    assert f.rows() == [(2, None, "b"), (3, 2, "c"), (4, 3, "d")]


def test_no_community_is_over_the_largest():
    x = np.random.default_rng(3).standard_normal((300, 8))
    x[:120] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.bincount(cluster.sized_communities(x, target=40, largest=60)).max() <= 60


def test_skeleton_keeps_comments_and_heads():
    code = "/* one\n   two */\nint main() {\n  int x = compute();\n  return x;\n}\ngetSize() {\n  y = 1;\n  if (y) {\n  }\n}\ndef f(a,\n      b):\n    '''doc\n    more'''\n    z = 1\n    return z\nLIMIT = 3\nother = 4"
    got = denoise.skeleton(code).split("\n")
    for line in ("/* one", "   two */", "int main() {", "  return x;", "getSize() {", "def f(a,", "      b):", "    more'''", "    return z", "LIMIT = 3"):
        assert line in got
    assert not {"  y = 1;", "    z = 1", "other = 4", "  if (y) {"} & set(got)


def test_writers_stand_side_by_side(spark, tmp_path):
    a, b = Warehouse(spark, f"file://{tmp_path}/wh"), Warehouse(spark, f"file://{tmp_path}/wh")
    row = lambda i, u: spark.createDataFrame([(i, u)], "id bigint, user_id string")
    a.append("messages", row(1, "x/y"), "x/y")
    b.append("messages", row(2, "x/y"), "x/y")
    a.append("messages", row(3, "z"), "z")
    assert {r.id for r in b.read("messages", "x/y").collect()} == {1, 2} and a.read("messages").count() == 3
    a.write("messages", row(9, "z"), "z")
    assert {r.id for r in b.read("messages").collect()} == {1, 2, 9}
    a.remove("messages", "x/y")
    assert b.read("messages").count() == 1


def _plain_linkage(x, limit):
    """Clusters by the definition: the pair whose farthest members are nearest is joined while those are under the limit."""
    parts = [[i] for i in range(len(x))]
    while True:
        best = min(((max(1 - x[i] @ x[j] for i in a for j in b), p, q) for p, a in enumerate(parts) for q, b in enumerate(parts) if p < q), default=None)
        if best is None or best[0] >= limit:
            return sorted(sorted(p) for p in parts)
        parts[best[1]] += parts.pop(best[2])


def test_linkage_against_its_definition(spark):
    rng = np.random.default_rng(5)
    for n, limit in ((1, 0.5), (12, 0.4), (40, 0.7), (40, 2.1)):
        x = cluster.matrix(list(rng.standard_normal((n, 6))))
        label = cluster.complete_linkage(x, limit)
        assert sorted(np.flatnonzero(label == c).tolist() for c in set(label)) == _plain_linkage(x, limit)


def test_linkage_of_many_vectors_ends():
    rng = np.random.default_rng(8)
    for x in (rng.standard_normal((3000, 64)), rng.standard_normal((1500, 64)) * 0.3 + 1):  # few near pairs, and nearly all
        x = cluster.matrix(list(np.concatenate((x, x[:200], np.zeros((3, 64))))))
        began = time.perf_counter()
        label = cluster.complete_linkage(x, 0.7)
        assert time.perf_counter() - began < 30
        assert (label[:200] == label[-203:-3]).all() and len(set(label[-3:])) == 3
        s = x @ x.T
        assert all(s[np.ix_(own, own)].min() > 0.3 for c in range(label.max() + 1) if len(own := np.flatnonzero(label == c)) > 1)


@pytest.mark.parametrize("limit", (0.05, 0.4, 0.9, 1.5))
def test_both_ways_of_linkage_agree(limit):
    rng = np.random.default_rng(9)
    x = cluster.matrix(list(np.round(rng.standard_normal((60, 3)), 1)))
    d = 1 - x @ x.T
    i, j = np.nonzero(np.triu(d < limit, 1))
    assert cluster._merge_pairs(60, i, j, d[i, j]).tolist() == cluster._merge_matrix(d, limit).tolist()


def test_decision_clusters_stay_within_a_user(spark):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], i, rng.standard_normal(4).tolist()) for i in range(30)]
    got = cluster.decision_clusters(spark.createDataFrame(rows, "user_id string, id bigint, embedding array<double>"), similarity=0.3).collect()
    assert sorted(r.id for r in got) == list(range(30))
    for u in "ab":
        ids = [r[1] for r in rows if r[0] == u]
        parts = {}
        for r in got:
            if r.user_id == u:
                parts.setdefault(r.cluster, []).append(ids.index(r.id))
        assert sorted(map(sorted, parts.values())) == _plain_linkage(cluster.matrix([rows[i][2] for i in ids]), 0.7)


def test_batches_are_whole_and_within_budget():
    rng = np.random.default_rng(7)
    for n, budget in ((1, 3), (9, 12), (25, 30)):
        x, tokens = cluster.matrix(list(rng.standard_normal((n, 5)))), rng.integers(1, 20, n)
        packs = cluster.pack_batches(x, tokens, budget)
        assert sorted(c for p in packs for c in p) == list(range(n))
        assert all(tokens[p].sum() <= budget or len(p) == 1 for p in packs)
        left, s = set(range(n)), x @ x.T
        for p in packs:  # every step by the definition
            pairs = [(s[i, j], i, j) for i in left for j in left if i < j]
            if pairs:
                _, i, j = max(pairs)
                assert p[0] in (i, j) and tokens[p[0]] == max(tokens[i], tokens[j])
            for k in range(1, len(p)):
                rest = left - set(p[:k])
                assert np.isclose(s[p[k], p[:k]].mean(), max(s[c, p[:k]].mean() for c in rest))
            left -= set(p)


def test_split_overloaded_against_its_definition(spark):
    rng = np.random.default_rng(8)
    home = rng.standard_normal((3, 6)) * 4
    rows = [(t, t * 1000 + i, (home[i % 3] + rng.standard_normal(6)).tolist()) for t, n in ((1, 120), (2, 100), (3, 7)) for i in range(n)]
    got = cluster.split_overloaded(spark.createDataFrame(rows, "topic bigint, vec_id bigint, embedding array<double>")).collect()
    assert sorted(r.vec_id for r in got) == [r[1] for r in rows if r[0] == 1]  # only the leaf over 100 is split
    x = cluster.matrix([r[2] for r in rows if r[0] == 1])
    label = np.array([r.cluster for r in sorted(got, key=lambda r: r.vec_id)])
    stands = np.array([r.representative for r in sorted(got, key=lambda r: r.vec_id)])
    assert 2 <= len(set(label)) <= 5
    centre = np.stack([x[label == c].mean(axis=0) for c in range(label.max() + 1)])
    d = ((x[:, None] - centre) ** 2).sum(axis=2)
    assert (d.argmin(axis=1) == label).all()
    for c in set(label):
        own, far = d[label == c, c], stands[label == c]
        assert far.sum() == min(8, len(own)) and own[far].max() <= own[~far].min(initial=np.inf)


def test_ranks_in_ranges_equal_a_plain_sort(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = [(i, "ab"[i % 2], round(float(rng.integers(0, 9)) / 7, 9), 0.0 if i % 3 else float(rng.integers(0, 4))) for i in range(500)]
    d = spark.createDataFrame(data, "entry_id bigint, memory_type string, cosine double, bm25 double").repartition(6)
    want = {x[0]: n + 1 for n, x in enumerate(sorted(data, key=lambda x: (-x[2], x[0])))}
    assert {r.entry_id: r["rank"] for r in retrieval.ordered_ranks(d, "cosine", "entry_id", 7).collect()} == want
    assert retrieval.ordered_ranks(d.limit(0), "cosine", "entry_id", 7).count() == 0
    plain = rows(retrieval.fuse(d).select("entry_id", "rank_vec", "rank_bm25", "rrf"))
    assert rows(retrieval.fuse(d, narrow=True).select("entry_id", "rank_vec", "rank_bm25", "rrf")) == plain
    monkeypatch.setattr(retrieval, "RANK_ROWS", 60)
    assert rows(retrieval.fuse(d, rows=500).select("entry_id", "rank_vec", "rank_bm25", "rrf")) == plain
