"""Queries of source files, which are written around the texts of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.operators import skeletons as K
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T

#: A file of each language; $t, $m and $x are a type, a function and the document's words, which stand in
#: comments and strings next to what looks like declarations there.
_SOURCES = {
    ".py": '"""$x\nclass Fake:\n"""\nimport os\nfrom lib.$m import a\n# def no(): $x\nclass $t(Base):\n    def $m(self, x: int = 1) -> str:\n        def inner(): pass\n        return "def no(): $x"\n    async def later(self): pass\nclass Other:\n    def $m(self): pass\ndef top(a,\n        b):\n    pass\n',
    ".ts": "import { a } from './$m';\n// function no() { $x\n/* class Fake {\n$x */\nexport class $t extends Base {\n  async $m(x: string): Promise<void> {\n    if (x) { go(`function no() { $x`) }\n  }\n}\nexport const arrow = (a, b) => a\nfunction top(a) { function inner() {} }\n",
    ".java": 'package p.$m;\nimport java.util.List;\n/* class Fake { $x */\n@Note("class No { $x")\npublic class $t extends Base implements A, B {\n  public int $m(String x) { if (x == null) { return go("int no() {"); } return 1; }\n}\n',
    ".rs": 'use std::$m;\n// fn no() { $x\npub struct $t { a: i32 }\npub trait Shape { fn area(&self) -> f64; }\nimpl $t {\n  pub fn $m(&self, x: u8) -> Option<u8> { let s = "fn no() { $x"; None }\n}\nfn top() {}\n',
    ".rb": "require '$m'\n=begin\nclass Fake $x\n=end\nmodule Store\n  class $t < Base\n    def $m(a, b)\n      list.each do |i|\n        puts \"def no $x\" if i\n      end\n    end\n    def self.make; end\n  end\nend\ndef top\nend\n",
    ".cs": 'using System.$m;\nnamespace App.Core {\n  // class Fake { $x\n  public class $t : Base {\n    public async Task<int> $m(string x) { Go("void No() { $x"); return 1; }\n    public string P { get; set; }\n  }\n  public interface IThing { void Run(int a); }\n}\n',
    ".go": 'package main\nimport (\n\t"fmt"\n\ta "lib/$m"\n)\nconst Most = 1\n/* func no() {\n$x */\ntype $t struct { a int }\ntype Shape interface { Area() int }\nfunc (s *$t) $m(x string) (int, error) {\n\treturn go1("func no() { $x"), nil\n}\nfunc Top() { }\n',
    ".php": "<?php\nnamespace App\\Core;\nuse Lib\\$m;\n# class Fake { $x\nabstract class $t extends Base implements A {\n  public static function $m(int $a, $b = '$x') : ?string { return function ($q) { return 'function no() {'; }; }\n}\ninterface Thing { public function run(); }\nfunction top($a) { }\n",
    ".cpp": '#include <vector>\n/* class Fake { $x */\nnamespace geo {\nenum class Color { Red };\nclass $t : public Base {\npublic:\n  int $m(const char* s) { if (s) { go("int no() { $x"); } return 1; }\n};\nint $t::area() const { return 2; }\n}\n',
    ".c": '#include "$m.h"\n// struct fake { $x\nstruct $t { int a; };\nenum color { RED };\nstatic int $m(int a) { for (;;) { go("int no(int b) { $x"); } }\nstruct $t *make(int a);\n',
}

#: What the files declare: kind, owner, name, base, parameters, result.
_DECLARED = {
    ".py": [("import", "", "os", "", "", ""), ("import", "", "lib.$m", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "self, x: int = 1", "str"), ("function", "$t", "later", "", "self", ""), ("type", "", "Other", "", "", ""), ("function", "Other", "$m", "", "self", ""), ("function", "", "top", "", "a, b", "")],
    ".ts": [("import", "", "./$m", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "x: string", "Promise<void>"), ("function", "", "arrow", "", "a, b", ""), ("function", "", "top", "", "a", "")],
    ".java": [("package", "", "package p.$m", "", "", ""), ("import", "", "java.util.List", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "String x", "int")],
    ".rs": [("import", "", "std::$m", "", "", ""), ("type", "", "$t", "", "", ""), ("interface", "", "Shape", "", "", ""), ("function", "Shape", "area", "", "&self", "f64"), ("function", "$t", "$m", "", "&self, x: u8", "Option<u8>"), ("function", "", "top", "", "", "")],
    ".rb": [("import", "", "$m", "", "", ""), ("package", "", "module Store", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "a, b", ""), ("function", "$t", "make", "", "", ""), ("function", "", "top", "", "", "")],
    ".cs": [("import", "", "System.$m", "", "", ""), ("package", "", "namespace App.Core", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "string x", "Task<int>"), ("interface", "", "IThing", "", "", ""), ("function", "IThing", "Run", "", "int a", "void")],
    ".go": [("package", "", "package main", "", "", ""), ("import", "", "fmt", "", "", ""), ("import", "", "lib/$m", "", "", ""), ("constant", "", "Most", "", "", ""), ("type", "", "$t", "", "", ""), ("interface", "", "Shape", "", "", ""), ("function", "$t", "$m", "", "x string", "(int, error)"), ("function", "", "Top", "", "", "")],
    ".php": [("package", "", "namespace App\\Core", "", "", ""), ("import", "", "Lib\\$m", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "int $a, $b = '$x'", "?string"), ("interface", "", "Thing", "", "", ""), ("function", "Thing", "run", "", "", ""), ("function", "", "top", "", "$a", "")],
    ".cpp": [("import", "", "vector", "", "", ""), ("package", "", "namespace geo", "", "", ""), ("constant", "", "Color", "", "", ""), ("type", "", "$t", "Base", "", ""), ("function", "$t", "$m", "", "const char* s", "int"), ("function", "$t", "area", "", "", "int")],
    ".c": [("import", "", "$m.h", "", "", ""), ("type", "", "$t", "", "", ""), ("constant", "", "color", "", "", ""), ("function", "", "$m", "", "int a", "int"), ("function", "", "make", "", "int a", "struct $t *")],
}
_EXT = list(_SOURCES)
_NO_SIGNS = "[^A-Za-z0-9.,]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _expected() -> str:
    rows = [f"({_EXT.index(e)}, {k}, {', '.join(map(_quoted, d))})" for e, found in _DECLARED.items() for k, d in enumerate(found)]
    fill = lambda c: f"replace(replace(replace({c}, '$t', 'T' || doc_id), '$m', 'm' || n), '$x', x)"
    params = f"CASE WHEN length({fill('params')}) > 100 THEN substr({fill('params')}, 1, 97) || '...' ELSE {fill('params')} END"
    return f"""WITH d AS (SELECT doc_id, length(text) AS n, trim(regexp_replace(text, '{_NO_SIGNS}', ' ', 'g')) AS x FROM documents), e(tongue, pos, kind, owner, name, base, params, returns) AS (VALUES {', '.join(rows)})
 SELECT doc_id, CAST(pos AS INTEGER) AS pos, kind, {fill('owner')} AS owner, {fill('name')} AS name, base, {params} AS params, {fill('returns')} AS returns FROM d JOIN e ON doc_id % {len(_EXT)} = tongue"""


def _files(spark, sf):
    d = T.load(spark, sf, "documents")
    words = F.trim(F.regexp_replace("text", _NO_SIGNS, " "))
    source = F.element_at(F.array(*map(F.lit, _SOURCES.values())), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    filled = F.replace(F.replace(F.replace(source, F.lit("$t"), F.concat(F.lit("T"), "doc_id")), F.lit("$m"), F.concat(F.lit("m"), F.length("text"))), F.lit("$x"), words)
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % len(_EXT) + 1).cast("int"))
    return d.select("doc_id", F.concat(F.lit("src/f"), "doc_id", ext).alias("path"), filled.alias("content"))


@query(_expected())
def code_skeletons(spark, sf):
    """Every declaration of a source file in one of ten languages, around the text of each document."""
    found = K.declarations(_files(spark, sf).drop("doc_id"))
    rows = found.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("long").alias("doc_id"), F.posexplode("declared").alias("pos", "d"))
    return rows.select("doc_id", "pos", *[f"d.{c}" for c in ("kind", "owner", "name", "base", "params", "returns")])


def _summaries() -> str:
    listed = {".py": ["class $t extends Base [$m, later]", "class Other [$m]", "func top(a, b)"], ".go": ["package main", "class $t", "($t) func $m(x string)", "func Top"], ".java": ["package p.$m", "class $t extends Base", "func $m(String x)"]}
    rows = [f"({_EXT.index(e)}, {_quoted(chr(10).join(lines))})" for e, lines in listed.items()]
    fill = "replace(replace(a, '$t', 'T' || doc_id), '$m', 'm' || length(text))"
    other = "array_to_string(list(CASE kind WHEN 'package' THEN name WHEN 'type' THEN 'class ' || name || CASE WHEN base <> '' THEN ' extends ' || base ELSE '' END ELSE 'func ' || name || CASE WHEN params <> '' THEN '(' || params || ')' ELSE '' END END ORDER BY CASE kind WHEN 'package' THEN 0 WHEN 'type' THEN 1 ELSE 2 END, pos) FILTER (kind IN ('package', 'type', 'function')), chr(10))"
    return f"""WITH r AS ({_expected()}), o AS (SELECT doc_id, {other} AS abstract FROM r GROUP BY doc_id), e(tongue, a) AS (VALUES {', '.join(rows)})
 SELECT doc_id, coalesce({fill}, abstract) AS abstract FROM documents JOIN o USING (doc_id) LEFT JOIN e ON doc_id % {len(_EXT)} = tongue"""


@query(_summaries())
def code_abstracts(spark, sf):
    """One line for each declaration of a source file."""
    found = K.skeletons(_files(spark, sf).drop("doc_id"))
    return found.select(F.regexp_extract("path", r"f(\d+)\.", 1).cast("long").alias("doc_id"), "abstract")
