"""Edits of a model on files, and replayed logs of file operations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quiverlake.operators import edits as X
from quiverlake.operators import replay as R

PROFILE = {"profile": {"content": ("string", "patch"), "name": ("string", "immutable"), "visits": ("int64", "sum"), "active": ("bool", "patch")}}
OPS = "batch long, phase string, seq long, uri string, memory_type string, content string, fields string"


def _apply(spark, files, ops, **kw):
    given = spark.createDataFrame(files, "uri string, content string")
    asked = spark.createDataFrame([(b, p, s, u, m, c, json.dumps(f) if isinstance(f, dict) else f) for b, p, s, u, m, c, f in ops], OPS)
    out = X.apply_operations(given, asked, PROFILE, **kw)
    return {r.uri: r.content for r in X.files_of(out).collect()}, out


def test_write_then_edit_merges_fields(spark):
    files, out = _apply(spark, [], [
        (1, "write", 0, "p/jane.md", "profile", "Jane is a designer", {"name": "Jane", "visits": 3, "unknown": 1}),
        (2, "edit", 0, "p/jane.md", "profile", None, {"name": "Jane Smith", "visits": 2, "content": "Jane is a senior designer", "active": True}),
    ])
    fields, body = X.split_file(files["p/jane.md"])
    assert fields == {"name": "Jane", "visits": 5, "active": True} and body == "Jane is a senior designer"
    assert files["p/jane.md"] == '<!-- MEMORY_FIELDS {"active":true,"name":"Jane","visits":5} -->\nJane is a senior designer'
    assert sorted(map(tuple, X.batch_report(out).collect())) == [(1, 1, 0, 0, 0, True), (2, 0, 1, 0, 0, True)]


def test_phases_of_a_batch_come_in_order(spark):
    """Deletions last and writes first, whatever the order of rows."""
    files, out = _apply(spark, [("a", "old"), ("b", "kept")], [
        (1, "delete", 0, "a", None, None, None),
        (1, "overview", 0, "a", None, None, {"overview": {"blocks": [{"search": "one", "replace": "1"}, {"search": "", "replace": "end"}]}}),
        (1, "write", 0, "a", None, "one two", None),
        (2, "edit", 0, "a", "", "new", {"mood": "fine"}),
    ])
    assert files == {"a": '<!-- MEMORY_FIELDS {"mood":"fine"} -->\nnew', "b": "kept"}
    rows = out.where("phase <> 'file'").orderBy("batch").collect()
    assert [r.outcome for r in rows] == ["written", "edited", "deleted", "edited"]


def test_a_bad_operation_leaves_the_rest(spark):
    files, out = _apply(spark, [("a", "text"), ("c", "mine")], [
        (1, "write", 0, "a", "profile", "x", "{broken"),
        (1, "edit", 1, "a", "profile", None, "[1]"),
        (1, "delete", 0, "nothing", None, None, None),
        (1, "rename", 0, "a", None, None, None),
        (1, "edit", 2, "a", "unknown type", None, {"content": "changed", "name": "n"}),
        (1, "write", 3, "c", None, "theirs", None),
        (None, "overview", 0, "o", None, None, {}),
        (1, "overview", 0, "o", None, None, {"overview": "about"}),
    ], allowed=F.col("uri") != "c")
    assert files == {"a": "changed", "c": "mine", "o": "about"}
    failed = {(r.uri, r.phase, r.message) for r in out.where("outcome = 'failed'").collect()}
    assert failed == {("a", "write", "fields are no JSON object"), ("a", "edit", "fields are no JSON object"), ("nothing", "delete", "no such file"), ("a", "rename", "unknown phase"), ("c", "write", "permission denied")}


def test_merge_values():
    m = X.merge_value
    assert m("patch", "string", "a b a", {"blocks": [{"search": "a", "replace": "c"}, {"search": "zz", "replace": "y"}]}) == "c b a"
    assert m("patch", "string", "a", "") == "a" and m("patch", "string", "a", None) == "a" and m("patch", "string", None, 5) == "5"
    assert m("patch", "int64", 1, 7) == 7 and m("immutable", "string", "", "x") == "x" and m("immutable", "string", "y", "x") == "y"
    assert m("sum", "int64", None, 2) == 2 and m("sum", "float32", 1.5, 2) == 3.5 and m("sum", "int64", 3, "") == 3 and m("sum", "int64", 3, "many") == 3


def test_head_cannot_be_closed_by_a_value():
    text = X.join_file({"note": "a --> b <c> & d"}, "body\n")
    assert X.split_file(text) == ({"note": "a --> b <c> & d"}, "body\n")
    assert X.split_file("<!-- MEMORY_FIELDS {") == ({}, "<!-- MEMORY_FIELDS {")


def test_no_operations_and_repeated_rows(spark):
    files, out = _apply(spark, [("a", "x"), ("a", "y"), (None, "z"), ("n", None)], [])
    assert files == {"a": "y", None: "z"}
    same = (1, "edit", 0, "a", "profile", None, {"visits": 1})
    files, _ = _apply(spark, [("a", "x")], [same, same])
    assert X.split_file(files["a"])[0] == {"visits": 2}


def test_operations_of_answers(spark):
    answers = spark.createDataFrame([
        (1, json.dumps({"reasoning": "r", "write_ops": [{"uri": "a", "content": "x", "fields": {"k": 1}}], "edit_ops": [{"uri": "b", "memory_type": "profile", "fields": {"content": "t"}}], "delete_uris": ["c", "d"]})),
        (2, "no json"), (3, "{}"),
    ], "batch int, answer string")
    rows = [tuple(r) for r in X.operations_of(answers).orderBy("phase", "seq").collect()]
    assert rows == [(1, "delete", 0, "c", None, None, None), (1, "delete", 1, "d", None, None, None), (1, "edit", 0, "b", "profile", None, '{"content":"t"}'), (1, "write", 0, "a", None, "x", '{"k":1}')]


@pytest.mark.parametrize("n", [3000])
def test_one_hot_file_streams(spark, n):
    ops = spark.range(n).selectExpr("id AS batch", "'edit' AS phase", "0L AS seq", "'hot' AS uri", "'profile' AS memory_type", "CAST(NULL AS STRING) AS content", "'{\"visits\": 1}' AS fields")
    out = X.apply_operations(spark.createDataFrame([("hot", "t")], "uri string, content string"), ops, PROFILE)
    assert X.split_file(X.files_of(out).first().content)[0] == {"visits": n}


# -- replay ----------------------------------------------------------------------


def _plain_replay(log, files=()):
    """The same on one machine, step by step."""
    texts, dirs = dict(files), set()

    def above(path, whole=False):
        parts = path.split("/")
        dirs.update("/".join(parts[:k]) for k in range(1, len(parts) + whole))

    for path in texts:
        above(path)
    under = lambda p, d: p == d or p.startswith(d + "/")
    for _, op, path, target, content in sorted(log, key=lambda r: r[0]):
        if op in ("write", "append"):
            above(path)
            texts[path] = content if op == "write" else texts.get(path, "") + content
        elif op == "mkdir":
            above(path, True)
        elif op == "rm" or op == "mv" and path != target:
            moved = {p: t for p, t in texts.items() if under(p, path)} if op == "mv" else {}
            moved_dirs = {d for d in dirs if under(d, path)} if op == "mv" else set()
            off = lambda p: under(p, path) or op == "mv" and under(p, target)  # noqa: B023, E731
            texts = {p: t for p, t in texts.items() if not off(p)} | {target + p[len(path) :]: t for p, t in moved.items()}
            dirs = {d for d in dirs if not off(d)} | {target + d[len(path) :] for d in moved_dirs}
            if op == "mv":
                above(target)
    return sorted([(p, "file", t) for p, t in texts.items()] + [(d, "directory", None) for d in dirs])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_equals_plain_steps(spark, seed):
    rng = random.Random(seed)
    name = lambda: "/".join(rng.choice("abc") + str(rng.randrange(2)) for _ in range(rng.randrange(1, 4)))
    log = []
    for seq in range(160):
        op = rng.choice(["write", "append", "write", "append", "mkdir", "rm", "mv", "mv"])
        log.append((seq, op, name() + "/f" if op in ("write", "append") else name(), name() if op == "mv" else None, f"{seq};"))
    files = [("a0/f", "old;"), ("b1/c0/f", "old;")]
    got = R.replay(spark.createDataFrame(log, "seq int, op string, path string, target string, content string"), spark.createDataFrame(files, "path string, content string"))
    assert sorted(map(tuple, got.collect())) == _plain_replay(log, files)


def test_replay_of_odd_logs(spark):
    schema = "seq int, op string, path string, target string, content string"
    assert R.replay(spark.createDataFrame([], schema)).collect() == []
    log = [(1, "write", "/a//b.md/", None, None), (2, "touch", "x", None, "t"), (3, "write", None, None, "t"), (4, "mv", "a", "a", None), (5, "mv", "a", "", None), (6, "append", "a/b.md", None, "x"), (7, "mv", "a", "c/d", None), (8, "mv", "c", "a", None)]
    got = R.replay(spark.createDataFrame(log, schema))
    assert sorted(map(tuple, got.collect())) == [("a", "directory", None), ("a/d", "directory", None), ("a/d/b.md", "file", "x")]


def test_one_hot_directory_is_dealt_by_time(spark):
    """Every operation names one directory; rules and questions are parts of it, not one group."""
    log = spark.range(4000).selectExpr("id AS seq", "CASE WHEN id % 4 = 3 THEN 'rm' ELSE 'write' END AS op", "CASE WHEN id % 4 = 3 THEN 'hot' ELSE concat('hot/f', id % 50) END AS path", "CAST(NULL AS STRING) AS target", "concat('t', id) AS content")
    got = sorted(map(tuple, R.replay(log.limit(3999)).where("kind = 'file'").collect()))
    assert got == [(f"hot/f{k % 50}", "file", f"t{k}") for k in (3996, 3997, 3998)]
    rules = R.rules_of(log.withColumn("target", F.lit("")))
    known = [r.rule.seq for r in rules.select("rule").collect()]
    asked = log.select(F.struct("seq").alias("key"), F.lit("hot").alias("at"), F.col("seq").alias("time"))
    for bounds in ([], [500, 1000, 3000]):
        found = {r.key.seq: r.rule.seq for r in R.next_rules(asked, rules, bounds).collect()}
        assert found == {t: next(s for s in sorted(known) if s > t) for t in range(3999)}


def test_changed_contexts(spark):
    files = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    rows, gone = R.changed_contexts(files(("a", "1"), ("b", "2"), ("c", "3")), files(("a", "1"), ("b", "new"), ("d/e", "4"), ("f", " ")), "ctx://base/")
    assert {(r.uri, r.source) for r in rows.collect()} == {("ctx://base/b", "changed"), ("ctx://base/d/e", "added")}
    assert [r.uri for r in gone.collect()] == ["ctx://base/c"]
