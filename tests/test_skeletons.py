"""Declarations of source files: what the lexer must find, and what it must not."""

import pytest

from quiverlake.operators.skeletons import declarations, skeletons

#: A file of each language and its declarations: kind, owner, name, base, parameters, result.
FILES = {
    "f.py": (
        '"""class Fake: def no(): pass"""\nimport os, sys as s\nfrom typing import List\nclass UserService(Base, metaclass=M):\n    # def commented(self): pass\n    def __init__(self, db):\n        def inner(): pass\n        self.db = "def x():"\n    async def get_user(self,\n                       user_id: str = "a)") -> Optional[dict]:\n        return 1\nclass B: pass\nif x:\n    def cond(): pass\ndef helper(x: int, y: int) -> int:\n    return x + y\n',
        [
            ('import', '', 'os', '', '', ''),
            ('import', '', 'sys', '', '', ''),
            ('import', '', 'typing', '', '', ''),
            ('type', '', 'UserService', 'Base, metaclass=M', '', ''),
            ('function', 'UserService', '__init__', '', 'self, db', ''),
            ('function', 'UserService', 'get_user', '', 'self, user_id: str = "a)"', 'Optional[dict]'),
            ('type', '', 'B', '', '', ''),
            ('function', '', 'cond', '', '', ''),
            ('function', '', 'helper', '', 'x: int, y: int', 'int'),
        ],
    ),
    "f.ts": (
        '\nimport { useState, useEffect } from \'react\';\nimport axios from "axios";\nimport \'./side.css\'\nconst s = `function no() { class Z {} }`; // function c() {}\nexport default class ApiClient<T> extends BaseClient<T> implements A, B<C, D> {\n    private x = 1;\n    async fetchData(url: string): Promise<void> {\n        if (url) { return axios.get(url); }\n        items.forEach(function (i) { go(i) })\n    }\n    get name() { return "class" }\n}\nexport function formatDate(date) {\n    return date\n}\nexport const multiply = (a, b) => a * b;\nconst later = async (x: number): Promise<number> => {\n  return x\n}\ninterface Props { a: string }\nif (a) { function hidden() {} }\n',
        [
            ('import', '', 'react', '', '', ''),
            ('import', '', 'axios', '', '', ''),
            ('import', '', './side.css', '', '', ''),
            ('type', '', 'ApiClient', 'BaseClient<T>', '', ''),
            ('function', 'ApiClient', 'fetchData', '', 'url: string', 'Promise<void>'),
            ('function', 'ApiClient', 'name', '', '', ''),
            ('function', '', 'formatDate', '', 'date', ''),
            ('function', '', 'multiply', '', 'a, b', ''),
            ('function', '', 'later', '', 'x: number', 'Promise<number>'),
            ('interface', '', 'Props', '', '', ''),
        ],
    ),
    "f.java": (
        '\npackage com.example.service;\nimport java.util.List;\nimport static java.util.Map.*;\n/* class Commented { } */\n@Service("class Bad {")\npublic class UserController extends BaseController<User> implements Serializable, Map<A, B> {\n    private int x = compute(3);\n    public UserController(Db db) { this.db = db; }\n    @Override\n    public List<User> getUsers() {\n        for (int i = 0; i < 3; i++) { call(i); }\n        return userService.findAll();\n    }\n    public static <T> Optional<User> getUser(String id, int n) throws X { return null; }\n    enum Kind { A, B }\n    interface Inner { void run(int a); }\n}\n',
        [
            ('package', '', 'package com.example.service', '', '', ''),
            ('import', '', 'java.util.List', '', '', ''),
            ('import', '', 'java.util.Map.*', '', '', ''),
            ('type', '', 'UserController', 'BaseController<User>', '', ''),
            ('function', 'UserController', 'UserController', '', 'Db db', ''),
            ('function', 'UserController', 'getUsers', '', '', 'List<User>'),
            ('function', 'UserController', 'getUser', '', 'String id, int n', '<T> Optional<User>'),
            ('type', 'UserController', 'Kind', '', '', ''),
            ('type', 'UserController', 'Inner', '', '', ''),
            ('function', 'Inner', 'run', '', 'int a', 'void'),
        ],
    ),
    "f.rs": (
        '\nuse std::collections::{HashMap, HashSet};\npub use crate::a::b;\n#[derive(Debug)]\npub struct Point<T> { x: T }\nstruct Unit;\nenum E { A, B }\npub trait Shape { fn area(&self) -> f64; }\nimpl<T: Clone> Point<T> {\n    pub fn new<\'a>(x: T, s: &\'a str) -> Result<Self, Error> { let c = \'x\'; let s = "fn no() {"; Self { x } }\n}\nimpl Shape for Unit { fn area(&self) -> f64 { 1.0 } }\nasync fn top(a: i32) where i32: Copy {}\nmod m { pub(crate) fn deep() {} }\n',
        [
            ('import', '', 'std::collections', '', '', ''),
            ('import', '', 'crate::a::b', '', '', ''),
            ('type', '', 'Point', '', '', ''),
            ('type', '', 'Unit', '', '', ''),
            ('type', '', 'E', '', '', ''),
            ('interface', '', 'Shape', '', '', ''),
            ('function', 'Shape', 'area', '', '&self', 'f64'),
            ('function', 'Point', 'new', '', "x: T, s: &'a str", 'Result<Self, Error>'),
            ('function', 'Unit', 'area', '', '&self', 'f64'),
            ('function', '', 'top', '', 'a: i32', ''),
            ('function', '', 'deep', '', '', ''),
        ],
    ),
    "f.rb": (
        '\nrequire \'json\'\nmodule Store\n  class User < Base\n    attr_reader :name\n    def initialize(name, age = 1)\n      @name = name if name\n      items.each do |i|\n        puts "def no" # def nope\n      end\n      while x do y end\n    end\n    def self.find(id)\n      return nil unless id\n    end\n    def valid?\n      if a then b end\n      true\n    end\n  end\n  def top; end\nend\n',
        [
            ('import', '', 'json', '', '', ''),
            ('package', '', 'module Store', '', '', ''),
            ('type', '', 'User', 'Base', '', ''),
            ('function', 'User', 'initialize', '', 'name, age = 1', ''),
            ('function', 'User', 'find', '', 'id', ''),
            ('function', 'User', 'valid?', '', '', ''),
            ('function', '', 'top', '', '', ''),
        ],
    ),
    "f.cs": (
        '\nusing System.Text;\nnamespace App.Core {\n  public sealed class Svc : Base, IDisposable {\n    public Svc(int a) { }\n    public async Task<int> RunAsync<T>(string s, T t) { using (var x = Open()) { } return 1; }\n    private static readonly string S = "class No { void M() { } }";\n    public int P { get; set; }\n    public override void Dispose() => Close();\n  }\n  public interface IThing { void Do(int x); }\n}\n',
        [
            ('import', '', 'System.Text', '', '', ''),
            ('package', '', 'namespace App.Core', '', '', ''),
            ('type', '', 'Svc', 'Base, IDisposable', '', ''),
            ('function', 'Svc', 'Svc', '', 'int a', ''),
            ('function', 'Svc', 'RunAsync', '', 'string s, T t', 'Task<int>'),
            ('function', 'Svc', 'Dispose', '', '', 'void'),
            ('interface', '', 'IThing', '', '', ''),
            ('function', 'IThing', 'Do', '', 'int x', 'void'),
        ],
    ),
    "f.go": (
        '\npackage main\nimport "fmt"\nimport (\n\t"os"\n\tx "strings"\n)\nconst Top = 1\nconst (\n\tA = iota\n\tB\n)\ntype T struct { a int }\ntype (\n\tU struct { b string }\n\tI interface { M(a int) error }\n)\nfunc (t *T) Method(a int, f func(int) bool) (string, error) { s := "func no() {"; return s, nil }\nfunc Generic[K comparable](k K) K { return k }\nfunc main() {\n\tgo func() { fmt.Println(`type Z struct {`) }()\n}\n',
        [
            ('package', '', 'package main', '', '', ''),
            ('import', '', 'fmt', '', '', ''),
            ('import', '', 'os', '', '', ''),
            ('import', '', 'strings', '', '', ''),
            ('constant', '', 'Top', '', '', ''),
            ('constant', '', 'A', '', '', ''),
            ('constant', '', 'B', '', '', ''),
            ('type', '', 'T', '', '', ''),
            ('type', '', 'U', '', '', ''),
            ('interface', '', 'I', '', '', ''),
            ('function', 'T', 'Method', '', 'a int, f func(int) bool', '(string, error)'),
            ('function', '', 'Generic', '', 'k K', 'K'),
            ('function', '', 'main', '', '', ''),
        ],
    ),
    "f.php": (
        '<?php\nnamespace App\\Models;\nuse App\\Base\\Model as M;\n# class Hash {}\nabstract class User extends Model implements A, B {\n    use SoftDeletes;\n    public static function find(int $id, string $s = "){"): ?User { return new class { function no() {} }; }\n    private function x() { $f = function ($y) { return $y; }; }\n}\ninterface Thing { public function run(); }\ntrait Logs { function log($m) {} }\nfunction helper(array $a): int { return 1; }\n',
        [
            ('package', '', 'namespace App\\Models', '', '', ''),
            ('import', '', 'App\\Base\\Model', '', '', ''),
            ('type', '', 'User', 'Model', '', ''),
            ('function', 'User', 'find', '', 'int $id, string $s = "){"', '?User'),
            ('function', 'User', 'x', '', '', ''),
            ('interface', '', 'Thing', '', '', ''),
            ('function', 'Thing', 'run', '', '', ''),
            ('type', '', 'Logs (trait)', '', '', ''),
            ('function', 'Logs', 'log', '', '$m', ''),
            ('function', '', 'helper', '', 'array $a', 'int'),
        ],
    ),
    "f.cpp": (
        '\n#include <vector>\n#include "a/b.h"\nnamespace geo {\nenum class Color { Red };\ntemplate <typename T> class Shape : public Base {\npublic:\n    Shape(int a) : Base(a), b_(a) { if (a) { run(a); } }\n    virtual ~Shape() {}\n    virtual double area(int x) const = 0;\n    static std::vector<int> all(const char* s = "class X {") { return {}; }\n};\nstruct Point { int x; };\ndouble Shape::area(int x) const { return 1; }\nstruct Point *make(int a, int b) { struct Point p; return 0; }\nstatic inline int helper(int a) { for (;;) { go(a); } }\nint proto(int);\nint value = compute(3);\n}\n',
        [
            ('import', '', 'vector', '', '', ''),
            ('import', '', 'a/b.h', '', '', ''),
            ('package', '', 'namespace geo', '', '', ''),
            ('constant', '', 'Color', '', '', ''),
            ('type', '', 'Shape', 'Base', '', ''),
            ('function', 'Shape', 'Shape', '', 'int a', ''),
            ('function', 'Shape', '~Shape', '', '', ''),
            ('function', 'Shape', 'area', '', 'int x', 'double'),
            ('function', 'Shape', 'all', '', 'const char* s = "class X {"', 'std::vector<int>'),
            ('type', '', 'Point', '', '', ''),
            ('function', 'Shape', 'area', '', 'int x', 'double'),
            ('function', '', 'make', '', 'int a, int b', 'struct Point *'),
            ('function', '', 'helper', '', 'int a', 'int'),
            ('function', '', 'proto', '', 'int', 'int'),
        ],
    ),
}


@pytest.fixture(scope="module")
def read(spark):
    def of(*files):
        return {r.path: [(d.kind, d.owner, d["name"], d.base, d.params, d.returns) for d in r.declared] for r in declarations(spark.createDataFrame(list(files), "path string, content string")).collect()}

    return of


def test_declarations_of_each_language(read):
    found = read(*[(p, t) for p, (t, _) in FILES.items()])
    for path, (_, want) in FILES.items():
        assert found[path] == want, path


def test_async_and_interfaces(spark):
    rows = declarations(spark.createDataFrame([("a.py", FILES["f.py"][0]), ("b.ts", FILES["f.ts"][0]), ("c.cs", FILES["f.cs"][0])], "path string, content string")).collect()
    waits = {d["name"] for r in rows for d in r.declared if d.waits}
    assert waits == {"get_user", "fetchData", "later", "RunAsync"}
    assert {tuple(d.also) for r in rows for d in r.declared if d.also} == {("A", "B<C, D>")}


def test_odd_files(read):
    deep = "{" * 3000 + "class No {}" + "}" * 3000
    found = read(("a.py", None), ("b.py", ""), ("c.txt", "class A:"), ("d.kt", "class A"), ("e.java", '"' + "x" * 100_000), ("f.go", "func"), ("g.js", deep), ("h.cs", "}}}) class A {"), ("i.rb", "end\nend\ndef a\nend"), ("j.py", "class \ndef (x)\n'''"), ("k.PY", "def up(): pass"), ("l.cpp", "#include"))
    assert all(found[p] == [] for p in ("a.py", "b.py", "c.txt", "d.kt", "e.java", "f.go", "g.js", "j.py", "l.cpp"))
    assert [d[2] for d in found["i.rb"]] == ["a"] and [d[2] for d in found["k.PY"]] == ["up"] and [d[2] for d in found["h.cs"]] == ["A"]


def test_long_parameters_are_cut(read):
    (row,) = read(("a.py", "def f(" + ", ".join(f"a{k}" for k in range(60)) + "): pass"))["a.py"]
    assert len(row[4]) == 100 and row[4].endswith("...")


def test_abstracts(spark):
    files = [("x/f.py", FILES["f.py"][0]), ("f.go", FILES["f.go"][0]), ("e/none.py", "x = 1\n"), ("n.txt", "class A")]
    a = {r.path: r.abstract for r in skeletons(spark.createDataFrame(files, "path string, content string")).collect()}
    assert a["x/f.py"] == "class UserService extends Base, metaclass=M [__init__, get_user]\nclass B\nfunc cond\nfunc helper(x: int, y: int)"
    assert a["f.go"] == "package main\nclass T\nclass U\n(T) func Method(a int, f func(int) bool)\nfunc Generic(k K)\nfunc main"
    assert a["e/none.py"] == "none.py (python, 2 lines)" and a["n.txt"] == ""
