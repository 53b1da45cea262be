from __future__ import annotations

import pytest

from palimpsest import models, pretty, tools
from palimpsest.functions import answers


def test_six_tools():
    assert set(tools.TOOLS) == {"add", "process", "search", "inspect", "forget", "reset"}


def test_calls_delegate(spark, tmp_path):
    from palimpsest.api import Engine

    e = Engine(spark, f"file://{tmp_path}/wh")
    assert tools.call(e, "add", {"messages": [{"role": "user", "content": "I like figs."}], "user_id": "a"}) == {"ok": True, "result": 1}
    assert tools.call(e, "process", {"user_id": "a"})["result"] == {"success": 1, "failed": 0}
    assert tools.call(e, "inspect", {"user_id": "b"})["result"] == []
    assert "figs" in tools.call(e, "search", {"query": "figs", "user_id": "a"})["result"]["context"]
    assert not tools.call(e, "search", {"query": " "})["ok"] and not tools.call(e, "nothing", {})["ok"] and not tools.call(e, "add", {"x": 1})["ok"]
    assert "figs" in pretty.memories(e.inspect("a")) and "General" in pretty.tree(e.tree("a")) and pretty.tree([]) == "(empty tree)"


def test_response_text():
    assert answers.response_text({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "ab"
    assert answers.response_text({"choices": [{"message": {"content": "c"}}]}) == "c"
    assert answers.response_text({}) == answers.response_text(None) == ""


def test_inlined_schema():
    s = {"$defs": {"P": {"type": "object", "title": "P", "properties": {"x": {"type": "integer"}}}}, "properties": {"p": {"$ref": "#/$defs/P"}, "l": {"items": {"$ref": "#/$defs/P"}}}, "title": "T"}
    got = answers.inlined(s)
    assert got["properties"]["p"] == {"type": "object", "properties": {"x": {"type": "integer"}}} == got["properties"]["l"]["items"] and "title" not in got


def test_call_retries_and_turns_keys():
    seen, slept = [], []

    def send(prompt, key):
        seen.append(key)
        if len(seen) < 3:
            raise OSError("busy")
        return prompt + "!"

    assert answers.call(send, "hi", ["k1", "k2"], sleep=slept.append) == "hi!" and seen == ["k1", "k2", "k1"] and slept == [1.0, 2.0]
    with pytest.raises(OSError):
        answers.call(lambda p, k: (_ for _ in ()).throw(OSError()), "x", tries=1)


def test_default_models(spark):
    d = models.rule_extractor("User: I decided to go.\nUser: I prefer tea.\nAssistant: ok", ["A > B"])
    assert d["topics_root"] == ["A", "B"] and d["memory"][0]["user"] == ["I prefer tea."]
    assert models.rule_extractor("nothing", []) == {"topics_root": [], "memory": []}
    assert models.first_sentences(["One. Two.", "Three."], 100) == "One.\nThree."
    v = {r.id: r.embedding for r in models.hashed_embeddings(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id bigint, text string"), "id", dims=16).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-6 and set(v[2]) == {0.0} == set(v[3])


def test_evaluation_stages(spark):
    from palimpsest.operators import evaluate, summaries

    q = spark.createDataFrame([(1, "two"), (2, "boom")], "question_id bigint, question_text string")
    a = evaluate.answered(q, lambda t: t.upper())
    e = spark.createDataFrame([(1, "TWO"), (2, "x")], "question_id bigint, expected string")

    def judge(answer, expected):
        if answer == "BOOM":
            raise ValueError("no")
        return '{"winner":"Ours","overall":1,"scores":[1]}'

    assert {r.question_id: r.verdict.winner for r in evaluate.judged(a, e, judge).collect()} == {1: "ours", 2: "error"}
    items = spark.createDataFrame([(1, 2, "[User] b"), (1, 1, "[Decision:active] a")], "topic_id bigint, mem_id bigint, text string")
    assert summaries.search_text(items).first()["text"] == "a b"
