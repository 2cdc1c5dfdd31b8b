import json

from driftline.llm import tool_calls

CALLS = "conv_id long, nth long, call_id string, after string, name string, arguments string, content string"
RESULTS = "call_id string, nth long, content string, conv_id long"
TOOLS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False,
                 "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "string", "maxLength": 3}},
                                "c": {"enum": ["x", 1]}}}}


def run(spark, calls, results):
    made = tool_calls.format_calls(spark.createDataFrame([(*c, "clash") for c in calls], CALLS),
                                   spark.createDataFrame([(*r, 1) for r in results], RESULTS), TOOLS)
    return {(r.conv_id, r.nth): r for r in made.collect()}


def test_linking_order_and_json(spark):
    got = run(spark, [(1, 0, "a", None, "add", '{"c": "x", "a": 2.0}'), (1, 2, "b", "a", "add", '{"a": 1, "b": ["ü\\n"]}'), (1, 4, "c", "b", "add", '{"a":1}')],
              [("a", 3, "later"), ("a", 1, "first"), ("b", 3, None), ("z", 1, "nobody's")])
    assert [got[1, n].depth for n in (0, 2, 4)] == [0, 1, 2]
    assert [got[1, n].linked for n in (0, 2, 4)] == [True, True, False]
    assert got[1, 2].json == '{"after":"a","arguments":{"a":1,"b":["ü\\n"]},"id":"b","name":"add","result":null,"type":"tool_call"}'
    assert got[1, 0].valid is False and got[1, 0].problems == "$.a: not integer"  # a float is no integer here
    assert json.loads(got[1, 0].json)["result"] == "first" and '"a":2,' in got[1, 0].json
    assert got[1, 4].problems == "no result"


def test_problems(spark):
    got = run(spark, [(1, 0, "x", "y", "add", '{"a":1}'), (1, 1, "y", "x", "add", '{"a":-1}'), (1, 2, "w", "x", "add", '{"a":1,"q":2}'),
                      (2, 0, None, None, "add", "{}"), (2, 1, "s", "gone", "sub", "[1"), (2, 2, "s", None, "add", None), (2, 3, "t", "s", "add", '{"a":NaN}'),
                      (None, None, "u", None, None, '{"a":1}'), (3, 0, "v", None, "add", '{"a":true,"b":["abcd"],"c":2}')],
              [(i, 1, "r") for i in "xywstuv"] + [(None, 1, "r")])
    assert got[1, 0].problems == got[1, 0].problems and got[1, 0].depth is None and got[1, 0].problems == "cycle"
    assert got[1, 1].problems == "$.a: out of bounds; cycle"
    assert got[1, 2].problems == "$.q: unknown; cycle"
    assert got[2, 0].problems == "$.a: missing; no identifier; no result"
    assert got[2, 1].problems == "unknown tool; no JSON; shared identifier"
    assert got[2, 2].problems == "no JSON; shared identifier"
    assert got[2, 3].problems == "no JSON" and got[2, 3].depth == 1
    assert got[None, None].problems == "unknown tool"
    assert got[3, 0].problems == "$.a: not integer; $.b[0]: bad length; $.c: not one of the values"


def test_a_long_chain_and_empty_tables(spark):
    chain = [(1, n, f"c{n}", f"c{n - 1}", "add", '{"a":1}') for n in range(70)]
    got = run(spark, chain, [(f"c{n}", n, "r") for n in range(70)])
    assert [got[1, n].depth for n in range(70)] == list(range(70)) and all(r.valid for r in got.values())
    assert run(spark, [], []) == {}


def test_rows_that_a_parser_or_writer_chokes_on(spark):
    """All legal JSON text that a model can write: each gets a problem and a defined JSON, and no job ends."""
    deep, deeper = "[" * 90 + "]" * 90, "[" * 3000 + "]" * 3000
    bad = ['{"a":1e999}', '{"a":1,"b":["\\ud800"]}', '{"a":1,"c":' + deep + "}", '{"a":1,"b":' + "[" * 200 + "]" * 200 + "}",
           deeper, "[" * 100_000, '{"a":' + "9" * 5000 + "}", '{"a":' + "9" * 9_000 + "}", '{"\\udfff":1,"a":1}', "", "null", "-1e400", '{"a":-1e400}']
    got = run(spark, [(1, n, f"c{n}", None, "add", text) for n, text in enumerate(bad)], [(f"c{n}", 1, "r") for n in range(len(bad))])
    assert len(got) == len(bad)
    said = [got[1, n].problems for n in range(len(bad))]
    assert said[0] == "number out of range; $.a: not integer" and '"arguments":{"a":null}' in got[1, 0].json
    assert "not Unicode" in said[1] and '"b":["\\ud800"]' in got[1, 1].json
    assert "not one of the values" in said[2] and deep in got[1, 2].json
    assert said[3] == "nested too deep" and "[" * 200 in got[1, 3].json
    assert said[4] == "nested too deep" and said[5] in ("nested too deep", "no JSON")
    assert "$.?: unknown" in said[8] and '"\\udfff":1' in got[1, 8].json
    assert said[9] == "no JSON" and said[10] == "$: not object" and said[11] == "number out of range; $: not object"
    for row in got.values():
        json.loads(row.json) if row.nth not in (4, 6, 7) else None
        row.json.encode()


def test_schemas_with_several_types():
    schema = {"type": ["integer", "null"], "minimum": 2}
    told = [list(tool_calls.violations(v, schema)) for v in (3, None, 1, "x", True, 2.5)]
    assert told == [[], [], ["$: out of bounds"], *[["$: not integer or null"]] * 3]
    assert list(tool_calls.violations("x", {"type": []})) == []


def test_canonical():
    assert tool_calls.canonical({"b": [1.0, 1.5, None, True], "a": "\u00e9\"\n\u2028", "": {}}) == '{"":{},"a":"é\\"\\n\u2028","b":[1,1.5,null,true]}'


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = tool_calls.query(spark, folder).collect()
    chats = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = {(c, t): (role, body) for c, t, role, body in chats}
    assert len(rows) == sum(role == "assistant" for role, _ in text.values())
    for row in rows:
        made, (_, body) = json.loads(row.json), text[row.conv_id, row.nth]
        after = text.get((row.conv_id, row.nth + 1))
        assert made["result"] == (after[1] if after and after[0] != "assistant" else None)
        assert "\n".join(made["arguments"].get("lines", [made["arguments"].get("text")])) == body
        depth, at = 0, row.nth
        while text.get((row.conv_id, at - 2), ("",))[0] == "assistant":
            depth, at = depth + 1, at - 2
        assert row.depth == depth
