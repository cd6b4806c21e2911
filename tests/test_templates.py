"""Prompt templates as column expressions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quiverlake.functions import templates as TP


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [(1, "Ann", 0, True, ["a", "b"], None), (2, "", 3, False, [], "x"), (3, None, -1, None, None, "{{.name}}")],
        "id int, name string, n int, flag boolean, tags array<string>, other string",
    )


def _shown(rows, text, **kw):
    return [r[0] for r in rows.orderBy("id").select(TP.Template(text).render(TP.values_of(rows), **kw)).collect()]


CASES = [
    ("Hi {{.name}}!", ["Hi Ann!", "Hi !", "Hi <no value>!"]),
    ("{{ .gone }}|{{.n}}|{{.flag}}|{{.tags}}", ["<no value>|0|true|[a b]", "<no value>|3|false|[]", "<no value>|-1|<no value>|<no value>"]),
    ("{{if .name}}A{{else if .n}}B{{else}}C{{end}}", ["A", "B", "B"]),
    ("{{if .gone}}A{{end}}", ["", "", ""]),
    ("{{if .tags}}{{if .flag}}both{{else}}tags{{end}}{{else}}none{{end}}", ["both", "none", "none"]),
    ('{{if eq .name "Ann" "Bob"}}1{{end}}{{if ne .n 3}}2{{end}}', ["12", "", "2"]),
    ("{{if and .name .flag}}1{{end}}{{if or .n .flag}}2{{end}}{{if not (and .name .n)}}3{{end}}", ["123", "23", "23"]),
    ("{{or .name \"nobody\"}} {{and .n 5}}", ["Ann 0", "nobody 5", "nobody 5"]),
    ("a  {{- .n -}}  b\n{{- /* no */ -}}\n c", ["a0bc", "a3bc", "a-1bc"]),
    ("{{.other}}", ["<no value>", "x", "{{.name}}"]),  # values aren't looked into
    ("plain { } text", ["plain { } text"] * 3),
    ("", [""] * 3),
]


@pytest.mark.parametrize("text,want", CASES)
def test_render(rows, text, want):
    assert _shown(rows, text) == want


def test_missing_may_be_empty(rows):
    assert _shown(rows, "<{{.gone}}{{.name}}>", missing="") == ["<Ann>", "<>", "<>"]


@pytest.mark.parametrize("text", ["{{if .a}}", "{{end}}", "{{else}}", "{{if .a}}{{else}}{{else}}{{end}}", "{{foo .a}}", "{{if}}x{{end}}", "{{.a .b}}", "{{if (eq .a 1}}x{{end}}", "{{eq .a}}", "{{if .a}}x{{else what}}{{end}}"])
def test_broken_templates_are_refused(text):
    with pytest.raises(ValueError):
        TP.Template(text)


def test_names():
    assert TP.Template("{{if and .a (not .b)}}{{.c}}{{else}}{{.d}}{{end}}").names() == {"a", "b", "c", "d"}


DEFINITION = """
metadata: {id: compression.facts, category: compression, version: "1"}
variables:
  - {name: messages, required: true, max_length: 5}
  - {name: tongue, default: auto}
llm_config: {temperature: 0.0}
template: "{{.messages}} in {{.tongue}}{{if .summary}} after {{.summary}}{{end}}"
"""


def test_registry(spark, rows):
    p = TP.Prompts()
    files = [("base/compression/facts.yaml", DEFINITION), ("base/chat/plain.yaml", "template: 'Say {{.name}}'"), ("base/chat/broken.yaml", "a: [1"), ("base/chat/note.txt", "template: x"), ("top.yaml", "template: x")]
    p.load(spark.createDataFrame(files, "path string, content string"))
    assert p.names() == ["chat.plain", "compression.facts"] and p.names("compression") == ["compression.facts"]
    assert p.definitions["compression.facts"].settings == {"temperature": 0.0}
    values = {"messages": TP.Value(F.col("other"), StringType()), "name": TP.Value(F.col("name"))}
    text, error = p.render("compression.facts", values)
    got = [tuple(r) for r in rows.orderBy("id").select(text, error).collect()]
    assert got == [(None, "required variable 'messages' not provided"), ("x in auto", None), ("{{.na in auto", None)]
    with pytest.raises(ValueError, match="messages"):
        p.render("compression.facts", {})
    with pytest.raises(KeyError):
        p.render("none", {})
    # an override by file, then one by a raw text, which has neither defaults nor rules
    p.load(spark.createDataFrame([("over/chat/plain.yaml", "template: 'Tell {{.name}}'")], "path string, content string"))
    assert rows.where("id = 1").select(p.render("chat.plain", values)[0]).first()[0] == "Tell Ann"
    p.register("compression.facts", "raw {{.tongue}}")
    assert rows.where("id = 1").select(p.render("compression.facts", {})[0]).first()[0] == "raw <no value>"
