"""Rounds of a model and a table, and embedding by a service that fails."""

import json
import threading
import time

from pyspark.sql import functions as F

from quiverlake.operators import embedding as B
from quiverlake.operators import rounds as O

CALLS = "array<struct<name: string, uri: string>>"


def _say(calls, content):
    return F.struct(F.from_json(F.lit(json.dumps(calls)), CALLS).alias("calls"), F.lit(content).alias("content"))


def test_calls_of_all_sessions_are_answered(spark):
    files = spark.createDataFrame([("ctx://a/x.md", "X"), ("ctx://a/y.md", "Y"), ("ctx://b/z.md", None)], "uri string, content string")
    sessions = spark.createDataFrame([(k, [("user", f"s{k}")]) for k in range(1, 5)], "session int, messages array<struct<role: string, content: string>>")
    talk = lambda m: F.get(m, F.lit(0)).content
    calls = [{"name": "read", "uri": "ctx://a/y.md"}, {"name": "ls", "uri": "ctx://a"}, {"name": "read", "uri": "ctx://none"}, {"name": "ls", "uri": "ctx://no"}, {"name": "search", "uri": None}, {"name": "fly", "uri": "u"}]

    def model(m, r):
        seen = F.to_json(F.struct(F.transform(m, lambda x: x.content).alias("seen")))
        ask = F.when(talk(m) == "s1", _say(calls, "looking")).when(talk(m) == "s2", _say([], "not json")).when(talk(m) == "s3", _say(calls[:1], ""))
        final = F.struct(F.lit(None).cast(CALLS).alias("calls"), seen.alias("content"))
        return ask.otherwise(final) if r == 0 else F.when(talk(m) == "s3", _say(calls[:1], "again")).otherwise(final)

    got = {r.session: r.answer and json.loads(r.answer)["seen"] for r in O.converse(sessions, files, model).collect()}
    results = ["[tool_result:read] Y", '[tool_result:ls] ["x.md","y.md"]', "[tool_result:read] error: no such file", "[tool_result:ls] error: no such directory", "[tool_result:search] search not available in this context", "[tool_result:fly] unknown tool: fly"]
    assert got == {1: ["s1", "looking", *results], 2: ["s2"], 3: None, 4: ["s4"]}


def test_answers_become_operations(spark):
    files = spark.createDataFrame([], "uri string, content string")
    sessions = spark.createDataFrame([(1, [("user", "s")]), (2, [])], "session int, messages array<struct<role: string, content: string>>")
    answer = json.dumps({"write_ops": [{"uri": "u", "content": "c"}], "delete_uris": ["d"]})
    ops = O.extract(sessions, files, lambda m, r: F.when(F.size(m) > 0, _say([], answer)).otherwise(_say([], "[1, 2]"))).collect()
    assert {(o.batch, o.phase, o.uri, o.content) for o in ops} == {(1, "write", "u", "c"), (1, "delete", "d", None)}
    assert O.converse(sessions.limit(0), files, lambda m, r: _say([], answer)).collect() == []


def test_bad_rows_are_found_by_halving():
    asked = []

    def service(texts):
        asked.append(len(texts))
        if "bad" in texts:
            raise ValueError("400")
        return [[float(len(t))] for t in texts]

    texts = ["a"] * 20 + ["bad"] + ["ccc"] * 11
    out = B.ask(service, texts, B.Limits(base=0))
    assert [o[0] for o in out] == [[1.0]] * 20 + [None] + [[3.0]] * 11 and out[20][1:] == ("ValueError: 400", "permanent")
    assert len(asked) < 12


def test_transient_errors_are_tried_again():
    tried = []

    def service(texts):
        tried.append(1)
        if len(tried) < 3:
            raise TimeoutError("timeout")
        return [[1.0]] * len(texts)

    assert B.ask(service, ["a", "b"], B.Limits(base=0))[1] == ([1.0], None, None) and len(tried) == 3
    unknown = lambda texts: (_ for _ in ()).throw(RuntimeError("odd"))
    assert B.ask(unknown, ["a"], B.Limits(base=0)) == [(None, "RuntimeError: odd", "unknown")]
    assert B.ask(lambda t: [], ["a"], B.Limits(base=0))[0][1] == "ValueError: 0 vectors for 1 texts"


def test_every_row_comes_back(spark):
    def service(texts):
        if any(t.endswith("7") for t in texts):
            raise ValueError("Forbidden")
        return [[float(t[1:])] for t in texts]

    rows = spark.range(500).selectExpr("id", "CASE WHEN id % 50 = 3 THEN NULL ELSE concat('t', id) END AS t", "'own' AS error", "id AS vector")
    done, dead = B.embedded_and_dead(rows, service, "t", B.Limits(batch=16, base=0))
    assert {r.id: r.vector for r in done.collect()} == {k: [float(k)] for k in range(500) if k % 10 != 7 and k % 50 != 3}
    assert {(r.id, r.error_class) for r in dead.collect()} == {(k, "permanent") for k in range(500) if k % 10 == 7 or k % 50 == 3}


def test_requests_in_flight_are_bounded(spark, tmp_path):
    def service(texts):
        state = service.__dict__.setdefault("s", {"now": 0, "most": 0, "lock": threading.Lock()})
        with state["lock"]:
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
        time.sleep(0.02)
        with state["lock"]:
            state["now"] -= 1
        return [[float(state["most"])]] * len(texts)

    rows = spark.range(0, 200, 1, 1).selectExpr("id", "'x' AS t")
    most = B.embed(rows, service, "t", B.Limits(batch=5, in_flight=3)).selectExpr("max(vector[0])").first()[0]
    assert 2 <= most <= 3
