import json

from pyspark.sql import functions as F

from tracelake.llm import chat

TOOLS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("ping", None, None, None)]


def linked(spark, rows, tools=TOOLS):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return chat.link_tools(df, spark.createDataFrame(tools, chat.SCHEMA)).orderBy("conv_id", "order_turn", "order_phase", "order_no").collect()


def call(ident, name, arguments):
    return {"id": ident, "name": name, "arguments": arguments}


def said(calls, **more):
    return json.dumps({"tool_calls": calls, **more})


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "assistant", said([call("c1", "add", {"b": 1.5, "a": 1}), call("c2", "add", '{"a": "x", "z": null}')], content="ok")),
        (1, 2, "tool", json.dumps({"tool_call_id": "c2", "content": {"z": 1, "a": [2]}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})),
        (1, 5, "assistant", said([call("c1", "add", {}), call("c3", "other", {}), call(None, "ping", {}), call("c4", "ping", 7)])),
        (2, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "early"})),
        (2, 1, "assistant", said([{"id": "c1", "function": {"name": "ping", "arguments": "{}"}}])),
        (2, 2, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})),
    ]
    got = linked(spark, rows)
    by = {(r["conv_id"], r["turn"], r["kind"], r["order_no"] if r["kind"] == "call" else 0): r for r in got}
    data = lambda *k: json.loads(by[k]["json"])
    assert data(1, 0, "message", 0) == {"content": 'say "hi"\n', "role": "user"}
    assert data(1, 1, "message", 0) == {"content": "ok", "role": "assistant"}
    assert by[1, 1, "call", 1]["json"] == '{"arguments":"{\\"a\\":1,\\"b\\":1.5}","id":"c1","name":"add","result_turn":3,"valid":true}'
    assert data(1, 1, "call", 2)["errors"] == ["missing b", "not integer a", "unknown z"]
    assert [by[1, 1, "call", k]["status"] for k in (1, 2)] == ["linked", "linked"]
    assert [by[1, t, "result", 0]["status"] for t in (2, 3, 4)] == ["linked", "linked", "duplicate"]
    assert data(1, 2, "result", 0)["content"] == '{"a":[2],"z":1}'
    assert [by[1, 5, "call", k]["status"] for k in (1, 2, 3, 4)] == ["duplicate", "pending", "unnamed", "pending"]
    assert "valid" not in data(1, 5, "call", 2) and data(1, 5, "call", 4)["errors"] == ["arguments are no object"]
    assert by[2, 2, "result", 0]["status"] == "orphan"
    order = [(r["turn"], r["kind"]) for r in got if r["conv_id"] == 2 and r["call_id"] == "c1"]
    assert order == [(1, "call"), (0, "result")]  # a result never comes before its call


def test_plain_and_broken_texts(spark):
    rows = [(1, 0, "assistant", "{broken"), (1, 1, "tool", "no json"), (1, 2, "assistant", "{}"), (1, 3, None, None), (None, None, "user", ""), (1, 0, "assistant", "{broken"), (1, 4, "user", said([call("c", "add", {})]))]
    got = linked(spark, rows)
    assert [r["kind"] for r in got] == ["message"] * 7
    assert sorted(r["json"] for r in got)[-1] == "{}"
    assert linked(spark, rows[:0]) == []


def test_hot_identifier(spark):
    rows = [(1, k, "assistant", said([call("same", "ping", {})])) for k in range(300)] + [(1, 1000 + k, "tool", json.dumps({"tool_call_id": "same", "content": str(k)})) for k in range(300)]
    got = linked(spark, rows)
    assert len(got) == 900
    assert sum(r["status"] == "linked" for r in got) == 2


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.link_tools(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and F is not None


def test_repeated_rows(spark):
    rows = [(1, 0, "assistant", said([call("c", "ping", {})]))] * 2 + [(1, 1, "tool", json.dumps({"tool_call_id": "c", "content": "x"}))] * 3
    got = linked(spark, rows)
    assert sorted((r["kind"], r["status"]) for r in got if r["kind"] != "message") == [("call", "duplicate"), ("call", "linked"), ("result", "duplicate"), ("result", "duplicate"), ("result", "linked")]


def test_lookups_do_all_kinds_of_work(spark):
    from tracelake.llm.queries import QUERIES

    got = QUERIES["op8_chat"](spark, "/root/testdata/sf0.01").collect()
    kinds = {(r["kind"], r["status"]) for r in got}
    assert {("call", "linked"), ("call", "pending"), ("result", "linked"), ("message", "message")} <= kinds
    assert any(r["order_phase"] for r in got) and {json.loads(r["json"])["valid"] for r in got if r["kind"] == "call"} == {True, False}
