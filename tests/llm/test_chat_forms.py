"""Chat messages in all their forms: nothing is lost, schemas come from the conversation, and DuckDB says the same."""

import json
import random

from twinfold.llm import chat, queries

CONV = "conv_id long, turn long, role string, text string"
DUMP = dict(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def formatted(spark, rows):
    return {(r.conv_id, r.turn): r for r in chat.format(spark.createDataFrame(rows, CONV)).collect()}


def message(r):
    return json.loads(r.message)


def test_what_is_no_single_object_stays_as_it_is(spark):
    call = '{"content":"c","tool_calls":[{"id":"a","name":"f"}]}'
    texts = [call + " trailing words", call + call, call + "] [", call + "} {", call + ',{"x":1}', f"[{call}]", '{"a":1,"a":2,"tool_calls":[{"id":"a"}]}', '{"tool_calls":["x"]}', '{"tool_calls":{"id":"a"}}', '{"role":"user","tool_calls":[{"id":"a"}]}', '{"tool_calls":[]}', '{"content":"only"}']
    got = formatted(spark, [(1, k, "assistant", t) for k, t in enumerate(texts)])
    for k, t in enumerate(texts):
        assert message(got[1, k]) == {"content": t, "role": "assistant"} and got[1, k].n_calls == 0
    assert message(formatted(spark, [(1, 0, "assistant", f" {call}\n")])[1, 0])["tool_calls"] == [{"arguments": "{}", "id": "a", "name": "f"}]


def test_members_that_are_not_known_stay(spark):
    text = json.dumps({"reasoning": "keep me", "content": [{"type": "text", "text": "hi"}], "z": None, "tool_calls": [{"id": "a", "name": "f", "arguments": {"b": 1, "a": [2, {"y": 1, "x": 0}]}, "index": 0, "extra": {"q": 1, "p": "é"}}]})
    got = formatted(spark, [(1, 0, "assistant", text), (1, 1, "tool", '{"tool_call_id":"a","content":"r","is_error":true}')])
    assert got[1, 0].message == '{"content":[{"text":"hi","type":"text"}],"reasoning":"keep me","role":"assistant","tool_calls":[{"arguments":"{\\"a\\":[2,{\\"x\\":0,\\"y\\":1}],\\"b\\":1}","extra":{"p":"é","q":1},"id":"a","index":0,"name":"f"}],"z":null}'
    assert got[1, 1].message == '{"content":"r","is_error":true,"role":"tool","tool_call_id":"a"}' and got[1, 1].n_linked == 1


def test_the_nested_form_of_a_call(spark):
    text = json.dumps({"content": None, "tool_calls": [{"id": "a", "type": "function", "function": {"name": "f", "arguments": '{"q": 1}'}}, {"id": "b", "function": {"name": "g", "arguments": {}, "strict": True}}, {"id": "c", "name": "h", "function": {"name": "other"}}]})
    r = formatted(spark, [(1, 0, "assistant", text)])[1, 0]
    assert message(r)["tool_calls"] == [
        {"arguments": '{"q":1}', "id": "a", "name": "f", "type": "function"}, {"arguments": "{}", "function": {"strict": True}, "id": "b", "name": "g"}, {"arguments": "{}", "function": {"name": "other"}, "id": "c", "name": "h"},
    ]


def tool(name, properties, required=(), nested=False):
    t = {"name": name, "parameters": {"type": "object", "properties": {k: {"type": v} if v else {} for k, v in properties.items()}, "required": list(required)}}
    return {"type": "function", "function": t} if nested else t


def test_schemas_come_from_the_conversation(spark):
    one = json.dumps({"tools": [tool("find", {"q": "string", "n": "integer"}, ["q"]), tool("stop", {}, nested=True)]})
    call = lambda name, **args: json.dumps({"tool_calls": [{"name": name, "arguments": args}]})
    rows = [(1, 0, "system", one), (1, 1, "assistant", call("find", q="x", n=1)), (1, 2, "assistant", call("find", n=1)), (1, 3, "assistant", call("find", q=1)), (1, 4, "assistant", call("find", q="x", more=1)), (1, 5, "assistant", call("stop")), (1, 6, "assistant", call("stop", a=1)), (1, 7, "assistant", call("none"))]
    rows += [(2, 1, "assistant", call("find", q="x")), (None, 0, "system", one), (None, 1, "assistant", call("find", q="x"))]
    got = formatted(spark, rows)
    assert [got[1, k].n_invalid for k in range(1, 8)] == [0, 1, 1, 1, 0, 1, 1] and got[2, 1].n_invalid == 1 and got[None, 1].n_invalid == 0
    assert message(got[1, 0]) == {"content": one, "role": "system"}
    general = spark.createDataFrame([("find", "q", "integer", True)], chat.TOOLS)
    both = {(r.conv_id, r.turn): r.n_invalid for r in chat.format(spark.createDataFrame(rows, CONV), general).collect()}
    assert both[1, 3] == 1 and both[1, 1] == 0 and both[2, 1] == 1


def planted(rng, n=250):
    """Conversations of every form, some with schemas, malformed texts, late and repeated results."""
    kinds, rows = ["string", "integer", "number", "boolean", "array", "object", "null", None], []
    values = ["x", 'é"\n', 3, -7, 2.5, True, [1, "a"], {"k": 1}, None]
    for conv in [*range(n), None]:
        if rng.random() < 0.7:
            tools = [tool(rng.choice(["find", "stop", "go/~"]), {rng.choice("abc/"): rng.choice(kinds) for _ in range(rng.randrange(4))}, rng.sample("ab", rng.randrange(3)), rng.random() < 0.5) for _ in range(rng.randrange(3))]
            rows.append((conv, 0, "system", json.dumps({"tools": tools}) + rng.choice(["", "", " x"])))
        for turn in range(1, rng.randrange(2, 9), 2):
            ids = [rng.choice(["a", "b", 7, None]) for _ in range(rng.randrange(4))]
            calls = []
            for i in ids:
                c = {"name": rng.choice(["find", "stop", "go/~"]), "arguments": rng.choice([{rng.choice("abc/"): rng.choice(values) for _ in range(rng.randrange(3))}, '{"a":1}', "plain", None])}
                c = {"function": c | ({"strict": True} if rng.random() < 0.3 else {}), "type": "function"} if rng.random() < 0.4 else c
                calls.append(c | ({"id": i} if i is not None else {}) | ({"index": rng.randrange(3)} if rng.random() < 0.3 else {}))
            whole = {"content": rng.choice(["ok", None, "", [1, "x"], 5]), "tool_calls": calls} | rng.choice([{}, {"why": "é", "z": {"a": 1}}, {"role": "assistant"}, {"role": "user"}])
            rows.append((conv, turn, "assistant", json.dumps(whole, ensure_ascii=rng.random() < 0.5) + rng.choice(["", "", "", " and more", "]", "{}"])))
            for i in ids:
                if i is not None and rng.random() < 0.8:
                    rows.append((conv, rng.choice([turn + 1, 0, None]), "tool", json.dumps({"tool_call_id": i, "content": rng.choice(["r", None, {"a": [1]}])} | rng.choice([{}, {"is_error": False}]))))
        if rng.random() < 0.3:
            rows += rows[-2:]
    return rows


def test_planted_forms_equal_the_sql(spark, tmp_path):
    import duckdb

    rows = planted(random.Random(5))
    spark.createDataFrame(rows, CONV).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op7_chat(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.sql(queries.OP7_SQL)
    order = [want.columns.index(c) for c in got.columns]
    found = sorted(map(str, (tuple(r) for r in got.collect())))
    assert found == sorted(map(str, (tuple(r[k] for k in order) for r in want.fetchall())))
    invalid = {r.n_invalid for r in got.collect()}
    assert {0, 1} < invalid and sum(r.n_calls > r.n_invalid for r in got.collect()) > 9
