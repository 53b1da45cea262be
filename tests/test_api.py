from __future__ import annotations

import pytest

from palimpsest.api import Engine
from palimpsest.errors import InvalidRequest


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine(spark, f"file://{tmp_path_factory.mktemp('engine')}")


def test_life_of_a_memory(engine):
    job = engine.add([{"role": "user", "content": "I prefer tea over coffee."}, {"role": "assistant", "content": "Noted."}], "alice", "2024-01-02T10:00:00")
    engine.add([{"role": "user", "content": "We decided to ship on Friday."}, {"role": "assistant", "content": "Fine."}], "alice", "2024-01-02T11:00:00")
    engine.add([{"role": "user", "content": "My cat sleeps."}], "bob")
    assert job == 1
    assert engine.process("alice") == {"success": 1, "failed": 0}  # both jobs became one
    assert engine.process("alice") == {"success": 0, "failed": 0}
    m = engine.inspect("alice").collect()
    assert {r.memory_type for r in m} == {"user", "decision"}
    assert engine.inspect("alice", memory_type="decision").count() == 1
    assert engine.inspect("bob").count() == 0
    hit = engine.search("which tea", "alice")
    assert "tea over coffee" in hit.context and hit.query_type == "information_extraction"
    assert engine.search("tell me about everything", "nobody").context == ""
    assert [n["name"] for n in engine.inspect("alice", "tree")] == ["General"]
    assert not engine.forget(10_000, "alice") and engine.forget(m[0].id, "alice")
    assert engine.inspect("alice").count() == len(m) - 1
    assert engine.reorganize_tree("alice", dry_run=True)["topics_before"] >= 1
    engine.reset("alice")
    assert engine.inspect("alice").count() == 0 and engine.store.read("processing_queue").count() == 1


def test_errors(engine):
    with pytest.raises(InvalidRequest):
        engine.add([])
    with pytest.raises(InvalidRequest):
        engine.inspect("u", "else")
    with pytest.raises(InvalidRequest):
        engine.inspect("u", memory_type="else")
    with pytest.raises(InvalidRequest):
        engine.search(" ")


def test_failing_extractor_counts_retries(spark, tmp_path):
    def broken(prompt, paths):
        raise RuntimeError("down")

    e = Engine(spark, f"file://{tmp_path}/wh", extractor=broken)
    e.add([{"role": "user", "content": "x"}], "u")
    assert e.process("u") == {"success": 0, "failed": 1}
    q = e.store.read("processing_queue").first()
    assert (q.status, q.retry_count) == ("failed", 1)


def test_a_failing_job_is_given_up_and_fresh_ones_go_on(spark, tmp_path):
    down = [True]

    def broken(prompt, paths):
        if down[0] and "poison" in prompt:
            raise RuntimeError("down")
        return {"topics_root": ["Notes"], "memory": [{"topics_branch": [], "user": [], "fact": [prompt], "epis": [], "decision": []}]}

    e = Engine(spark, f"file://{tmp_path}/wh", extractor=broken)
    e.add([{"role": "user", "content": "poison"}], "u")
    for n in range(1, 6):
        assert e.process("u") == {"success": 0, "failed": 1}
        assert e.store.read("processing_queue", "u").first().retry_count == n
    assert e.process("u") == {"success": 0, "failed": 0}
    e.add([{"role": "user", "content": "well"}], "u", "March-01-2024")
    assert e.process("u") == {"success": 1, "failed": 0}
    assert e.store.read("processing_queue", "u").count() == 1 and e.inspect("u", "all")["memories"].count() == 1


def test_index_is_stored_and_grows(spark, tmp_path):
    where = f"file://{tmp_path}/wh"
    e = Engine(spark, where)
    e.add([{"role": "user", "content": "We decided to ship the heavy crates on Friday."}], "u")
    e.process("u")
    assert "crates" in e.search("ship crates", "u").context
    first = e.store.read("doc_stats", "u").count()
    e.add([{"role": "user", "content": "I prefer tea over coffee."}], "u")
    e.process("u")
    again = Engine(spark, where)  # another process
    assert "tea over coffee" in again.search("which tea", "u").context
    stats = again.store.read("doc_stats", "u").collect()
    assert len(stats) > first and len({r.entry_key for r in stats}) == len(stats)
    assert again.forget(again.inspect("u", memory_type="user").first().id, "u")
    assert "tea over coffee" not in again.search("which tea", "u").context


def test_summaries_go_up_the_tree(spark, tmp_path):
    def many(prompt, paths):
        return {"topics_root": ["Work"], "memory": [{"topics_branch": ["Ships"], "user": [], "fact": [f"fact {i} about ships. More." for i in range(52)], "epis": [], "decision": []}]}

    e = Engine(spark, f"file://{tmp_path}/wh", extractor=many)
    e.add([{"role": "user", "content": "x"}], "u")
    e.process("u")
    t = {r.name: r for r in e._topics("u").collect()}
    assert t["Ships"].description and t["Work"].description == t["Ships"].description and t["Work"].embedding
    assert e.store.read("leaf_summary_items", "u").count() == 52 and e.summarize("u") == 0
    assert e.store.read("source_map", "u").first().state == "source"
