import json
import random

from pyspark.sql import functions as F

from scoreloom.llm.tool_calls import check, depths, tool_calls

CALLS = "conv_id long, call_id string, turn long, name string, arguments map<string,string>, status string"
RESULTS = "conv_id long, call_id string, turn long, content string, extra int"
TOOLS = [("add", "x", "integer", True), ("add", "y", "number", False), ("say", "text", "string", True), ("say", "loud", "boolean", False)]


def run(spark, calls, results, uses):
    return tool_calls(
        spark.createDataFrame([(*c, "s") for c in calls], CALLS),
        spark.createDataFrame([(*r, 1) for r in results], RESULTS),
        spark.createDataFrame(TOOLS, "name string, arg string, type string, required boolean"),
        spark.createDataFrame(uses, "conv_id long, call_id string, needs string"),
    )


def test_links_checks_and_json(spark):
    calls = [
        (1, "a", 0, "add", {"y": "2.5", "x": "7"}),
        (1, "b", 2, "say", {"text": 'q"uote\n', "loud": "yes"}),
        (1, "c", 4, "say", None),
        (1, "d", 5, "nope", {"k": None}),
        (1, "a", 9, "add", {"x": "1"}),
        (2, "a", 3, "add", {"x": "01", "z": "1"}),
        (None, "a", 0, "add", {"x": "1"}),
        (3, None, 0, "add", {"x": "-3"}),
        (4, "r", 0, "say", {"text": ""}),
        (4, "r", 0, "say", {"text": ""}),
    ]
    results = [(1, "a", 1, "seven"), (1, "a", 3, "later"), (1, "b", 1, "too early"), (1, "zz", 5, "of nothing"), (2, "a", 4, None), (None, "a", 1, "x"), (4, "r", 1, "ok")]
    uses = [(1, "b", "a"), (1, "c", "b"), (1, "d", "d"), (1, "d", "unknown"), (4, "r", "r")]
    got = {}
    for r in run(spark, calls, results, uses).collect():
        got.setdefault((r.conv_id, r.call_id, r.turn), []).append(r)
    assert sum(map(len, got.values())) == len(calls)
    a = got[1, "a", 0][0]
    assert (a.status, a.result_turn, a.n_results, a.depth, a.problems) == ("linked", 1, 2, 0, [])
    assert a.json == '{"arguments":{"x":7,"y":2.5},"id":"a","name":"add","result":"seven"}'
    b = got[1, "b", 2][0]
    assert (b.status, b.depth, b.problems) == ("early", 1, ["type: loud"])
    assert json.loads(b.json)["arguments"] == {"loud": "yes", "text": 'q"uote\n'}
    c = got[1, "c", 4][0]
    assert (c.status, c.depth, c.problems) == ("unanswered", 2, ["missing: text"])
    assert json.loads(c.json) == {"arguments": {}, "id": "c", "name": "say", "result": None}
    d = got[1, "d", 5][0]
    assert (d.depth, d.problems, json.loads(d.json)["arguments"]) == (0, ["unknown tool"], {"k": None})
    assert got[1, "a", 9][0].status == "repeated"
    assert got[2, "a", 3][0].problems == ["type: x", "unknown: z"]
    assert got[None, "a", 0][0].status == got[3, None, 0][0].status == "unnamed"
    assert got[None, "a", 0][0].depth is None
    assert [r.status for r in got[4, "r", 0]] == ["linked", "linked"]


def test_depths_of_chains_diamonds_and_cycles(spark):
    chain = [(1, f"k{i}", f"k{i - 1}") for i in range(1, 6)]
    diamond = [(2, "b", "a"), (2, "c", "a"), (2, "c", "b"), (2, "d", "c"), (2, "d", "a")]
    cycle = [(3, "x", "y"), (3, "y", "x"), (3, "z", "x")]
    edges = chain + diamond + cycle
    ids = sorted({(c, v) for c, a, b in edges for v in (a, b)} | {(3, "free")})
    got = depths(spark.createDataFrame(ids, "conv_id long, call_id string"), spark.createDataFrame(edges, "conv_id long, call_id string, needs string"))
    d = {(r.conv_id, r.call_id): r.depth for r in got.collect()}
    assert [d[1, f"k{i}"] for i in range(6)] == list(range(6))
    assert [d[2, x] for x in "abcd"] == [0, 1, 2, 3]
    assert [d[3, x] for x in ("x", "y", "z", "free")] == [-1, -1, -1, 0]


def test_depths_of_random_graphs_and_a_long_chain_in_a_hot_conversation(spark):
    rng = random.Random(4)
    edges = [(7, f"n{i}", f"n{i - 1}") for i in range(1, 500)]  # a third of all rows
    for c in range(20, 60):
        n = rng.randrange(2, 14)
        for i in range(n):
            for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
                # Mostly backwards; now and then forwards, which may close a cycle.
                j = rng.randrange(i) if i and rng.random() < 0.93 else rng.randrange(n)
                edges.append((c, f"n{i}", f"n{j}"))
    edges += edges[600:620] + [(30, "n0", "unknown"), (31, None, "n1"), (31, "n1", None), (None, "n1", "n2")]
    ids = sorted({(c, v) for c, a, b in edges for v in (a, b) if c and v and v != "unknown"})
    got = depths(spark.createDataFrame(ids + ids[:5], "conv_id long, call_id string"), spark.createDataFrame(edges, "conv_id long, call_id string, needs string")).collect()
    needs = {k: {(c, b) for c, a, b in edges if (c, a) == k and b != a and (c, b) in set(ids)} for k in ids}
    want = {}
    while True:
        ready = {k: max((want[n] + 1 for n in needs[k]), default=0) for k in ids if k not in want and needs[k] <= want.keys()}
        if not ready:
            break
        want.update(ready)
    assert len(got) == len(ids) and want[7, "n499"] == 499
    assert {(r.conv_id, r.call_id): r.depth for r in got} == {k: want.get(k, -1) for k in ids}
    assert any(k not in want for k in ids)


def test_canonical_values(spark):
    cases = [("number", "1.50", "1.5"), ("number", "1e5", "100000"), ("number", "-0", "0"), ("number", "1.5E-9", "1.5e-9"), ("number", "1e999", '"1e999"'), ("integer", "-0", "0"), ("integer", "12345678901234567890", "12345678901234567890"),
             ("object", '{"b": [1, 2], "a": {"d": null, "c": "x"}}', '{"a":{"c":"x","d":null},"b":[1,2]}'), ("array", "[ 1 , {} ]", "[1,{}]"), ("object", "[1]", '"[1]"'), ("array", "nope", '"nope"'), ("boolean", "true", "true"), ("string", "é", '"é"')]
    tools = [(f"t{i}", "x", kind, True, ["1e5", "true"] if kind in ("number", "boolean") else None) for i, (kind, _, _) in enumerate(cases)]
    calls = spark.createDataFrame([(1, f"c{i}", i, f"t{i}", {"x": v}) for i, (_, v, _) in enumerate(cases)], "conv_id long, call_id string, turn long, name string, arguments map<string,string>")
    got = {r.turn: r for r in check(calls, spark.createDataFrame(tools, "name string, arg string, type string, required boolean, allowed array<string>")).collect()}
    for i, (kind, v, want) in enumerate(cases):
        assert got[i].args_json == '{"x":' + want + "}", (kind, v, got[i].args_json)
        wrong = want.startswith('"') and kind != "string"
        barred = not wrong and kind in ("number", "boolean") and v not in ("1e5", "true")
        assert got[i].problems == (["type: x"] if wrong else ["value: x"] if barred else [])


def test_empty(spark):
    assert run(spark, [], [], []).where(F.col("json").isNotNull()).count() == 0


def test_equal_rows_of_a_call_share_its_status(spark):
    from scoreloom.llm.tool_calls import link

    calls = spark.createDataFrame([(1, "a", 0, "f", "{}"), (1, "a", 0, "f", "{}"), (1, "a", 2, "f", "{}")], "conv_id int, call_id string, turn int, name string, args_text string")
    results = spark.createDataFrame([(1, "a", 1, "r")], "conv_id int, call_id string, turn int, content string")
    assert sorted((r.turn, r.status) for r in link(calls, results).collect()) == [(0, "linked"), (0, "linked"), (2, "repeated")]
