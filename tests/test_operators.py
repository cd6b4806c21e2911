"""Operators on literals: filters, tree, retrieval walk, parsers, memories, packs, streams."""

import io
import json
import random
import re
import zipfile
import zlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.functions import vector as V
from quiverlake.operators import evaluation as E
from quiverlake.operators import filters as L
from quiverlake.operators import memory as M
from quiverlake.operators import parsing as P
from quiverlake.operators import search as R
from quiverlake.operators import sessions as S
from quiverlake.operators import statistics as G
from quiverlake.operators import store, sync
from quiverlake.session import materialize
from quiverlake.sources import catalog, documents
from quiverlake.streaming import activity
from quiverlake.streaming import sync as stream


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def rows(spark):
    data = [("1", "ctx://resources/a", "ctx://resources", "x"), ("2", "ctx://resources/a/b.md", "ctx://resources/a", "x"), ("3", "ctx://resources/a_b/c.md", "ctx://resources/a_b", "y"), ("4", "ctx://resources/axb/c.md", None, None)]
    return spark.createDataFrame(data, "id string, uri string, parent_uri string, account_id string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_filters(rows):
    q = lambda f: ids(store.query(rows, f))
    assert q(L.Eq("account_id", "x")) == ["1", "2"]
    assert q(L.Eq("account_id", None)) == [] and q(L.In("id", ())) == [] and q(L.Or(())) == []
    assert q(L.And(())) == ["1", "2", "3", "4"] and q(L.Not(L.Eq("account_id", "x"))) == ["3", "4"]
    assert q(L.PathScope("uri", "ctx://resources/a")) == ["1", "2"]
    assert q(L.PathScope("uri", "ctx://resources/a_b")) == ["3"]  # the sign is no wildcard
    assert q(L.PathScope("uri", "ctx://resources/a", 0)) == ["1"] and q(L.PathScope("uri", "ctx://resources", 1)) == ["1"]
    assert L.merge(None, None) is None and L.merge(None, L.Eq("id", 1)) == L.Eq("id", 1)
    f = L.Or((L.And((L.Eq("id", "1"), L.In("uri", ("a",)))), L.Not(L.PathScope("uri", "b", 1))))
    assert L.from_json(L.to_json(f)) == f
    with pytest.raises(ValueError):
        L.Eq("id; drop", 1).column()


def test_delete_upsert_rename(rows):
    assert ids(store.delete_subtree(rows, "ctx://resources/a")) == ["3", "4"]
    left, vectors = store.delete_where(rows, rows.select("id"), L.Eq("account_id", "x"))
    assert ids(left) == ids(vectors) == ["3", "4"]
    moved = store.rename_subtree(rows, "ctx://resources/a", "ctx://resources/z")
    assert {r.uri for r in moved.collect()} >= {"ctx://resources/z/b.md", "ctx://resources/a_b/c.md"}
    assert store.get(rows, []).count() == 0


def test_uris(spark):
    v = lambda c, u: one(spark, c(F.col("u")), u=u)
    for raw in ("ctx:/a/b", "/a/b", "a/b", "ctx://a/b/"):
        assert v(U.normalize, raw) == "ctx://a/b"
    assert v(U.is_valid, "ctx://a/b") and not v(U.is_valid, "ctx://a/../b") and not v(U.is_valid, "ctx://") and not v(U.is_valid, "ctx://a\\b")
    assert v(U.row_type, "ctx://agent/x/skills/memories") == "skill" and v(U.query_type, "ctx://agent/x/skills/memories") == "memory"
    assert v(U.space, "ctx://user/memories/x") == "" and v(U.space, "ctx://user/bob/x") == "bob" and v(U.space, "ctx://session/.abstract.md") == ""
    assert v(U.archive, "ctx://user/b/memories/events/x.md") == "ctx://user/b/memories/_archive/events/x.md"
    once = v(U.archive, "ctx://user/b/memories/events/x.md")
    assert v(U.archive, once) == once and v(U.restore, once) == "ctx://user/b/memories/events/x.md"
    see = lambda u, role="user": one(spark, U.accessible(F.col("u"), F.lit(role), F.lit("me"), F.lit("bot")), u=u)
    assert [see(u) for u in ("ctx://resources/x", "ctx://user/me/x", "ctx://user/you/x", "ctx://agent/bot/x", "ctx://agent/skills", "ctx://_system/x", "ctx://other")] == [True, True, False, True, True, False, True]
    assert see("ctx://_system/x", "root")
    kinds = ["git@host:a/b.git", "https://github.com/a/b", "https://github.com/a/b/tree/main", "https://github.com/a", "https://x.org/a/b", "dir/file"]
    assert [v(U.source_kind, u) for u in kinds] == ["git", "git", "git", "url", "url", "local"]
    long = "é" * 200
    short = v(U.shorten, long)
    assert len(short.encode()) <= 260 and short != long and v(U.shorten, "ok") == "ok"


def test_texts(spark):
    v = lambda c, t: one(spark, c(F.col("t")), t=t)
    assert v(X.language, "привет мир") == "ru" and v(X.language, "안녕 하세요") == "ko" and v(X.language, "مرحبا بك") == "ar"
    assert v(X.language, "こんにちは 世界") == "ja" and v(X.language, "你好 world") == "zh-CN" and v(X.language, "") == "en"
    assert v(X.facet_key, "Coffee habit: strong") == "coffee habit" and v(X.facet_key, "a：b") == "a"
    assert v(X.facet_key, "word " * 10) == "word word word word word"[:24].strip() and v(X.facet_key, "x" * 40) == "x" * 24
    assert v(X.abstract, "\n\n# Title here\nbody") == "Title here" and v(X.abstract, "y" * 300) == "y" * 200 + "..." and v(X.abstract, " \n ") == ""
    assert v(lambda c: X.truncate_bytes(c, 3), "aéé") == "aé..." and v(lambda c: X.truncate_bytes(c, 2), "aé") == "a\ufffd..."
    assert v(X.error_class, "http 401 timeout") == "permanent" and v(X.error_class, "timeout") == "transient"
    assert v(X.tokens, "The cat, sat É a 9") == ["cat", "sat"] + [w for w in ["é"] if len(w.encode()) > 1]


def test_vectors(spark):
    c = lambda a, b: one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b)
    assert c([1.0, 0.0], [1.0, 0.0]) == 1 and c([1.0, 0.0], [0.0, 0.0]) == 0 and c([1.0], [1.0, 2.0]) == 0
    assert one(spark, V.truncate(F.col("v"), 2), v=[3.0, 4.0, 9.0]) == [0.6, 0.8] and one(spark, V.truncate(F.col("v"), 3), v=[3.0, 4.0]) == [3.0, 4.0]
    e = one(spark, V.hash_embedding(F.col("t"), 8), t="")
    assert e == [1.0] + [0.0] * 7 and V.fnv1a("a") == 0xE40C292C


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_equals_brute_force(spark, metric):
    import numpy as np

    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 6)), 1).astype(np.float32)
    x[50:80] = x[50]  # ties
    x[7] = 0
    rows = [(f"v{k}", k, v.tolist()) for k, v in enumerate(x)] + [("n", 1000, None), ("s", 1001, [1.0]), ("h", 1002, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id string, ord long, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(k, x[k].tolist()) for k in (0, 7, 50)], "query_id long, vector array<float>")
    got = {(r.query_id, r["rank"]): (r.ord, round(r.distance, 9)) for r in R.knn(queries, vectors, 40, metric).collect()}
    y = x.astype(np.float64)
    for q in (0, 7, 50):
        if metric == "l2":
            d = np.sqrt(((y - y[q]) ** 2).sum(1))
        else:
            size = np.linalg.norm(y, axis=1) * np.linalg.norm(y[q])
            d = 1 - np.divide(y @ y[q], size, out=np.zeros(len(y)), where=size > 0)
        want = sorted((round(v, 9), k) for k, v in enumerate(d))[:40]
        assert [got[q, n + 1][1] for n in range(40)] == [w[0] for w in want]
        if metric == "l2":
            assert [got[q, n + 1][0] for n in range(40)] == [w[1] for w in want]
    tiled = R.knn(queries, vectors, 40, metric, block=2, slice_rows=90).collect()
    assert {(r.query_id, r["rank"]): (r.ord, round(r.distance, 9)) for r in tiled} == got
    odd = queries.union(spark.createDataFrame([(900, None), (901, [1.0]), (902, [None] * 6)], "query_id long, vector array<float>"))
    mixed = R.knn(odd, vectors, 40, metric).collect()
    assert {(r.query_id, r["rank"]): (r.ord, round(r.distance, 9)) for r in mixed if r.query_id < 900} == got
    if metric == "l2":
        assert [(r.ord, r.distance) for r in mixed if r.query_id >= 900] == [(1001, 0.0)]
    assert R.knn(queries.limit(0), vectors, 5).count() == 0


def test_walk_equals_plain_model():
    def model(rows, limit, starts):
        m = max(limit, 10)
        got, start = {}, {}
        for u, _, lv, s, _, ok in [r for r in rows if r[5]][: 3 * m]:
            if lv == 2:
                got[u] = max(s, got.get(u, s))
            else:
                start.setdefault(u, s)
        for u in starts:
            start.setdefault(u, 0.0)
        todo, seen, same, last = list(start.items()), set(), 0, None
        while todo:
            todo.sort(key=lambda x: (-x[1], x[0]))
            u, s = todo.pop(0)
            if u in seen:
                continue
            seen.add(u)
            kids = [r for r in rows if r[1] == u and r[5] and r[4] <= max(3 * max(2 * limit, 20), 50)][: max(2 * limit, 20)]
            for k, _, lv, raw, _, _ in kids:
                f = (raw + s) / 2 if s > 0 else raw
                if f > 0:
                    got[k] = max(f, got.get(k, f))
                    if lv != 2 and k not in seen:
                        todo.append((k, f))
            if kids:
                best = {x for x, _ in sorted(got.items(), key=lambda x: (-x[1], x[0]))[:limit]}
                same, last = (same + 1 if best == last and len(best) >= limit else 0), best
                if same >= 3:
                    break
        return got

    rng = random.Random(3)
    for _ in range(40):
        names = [f"n{k}" for k in range(60)]
        rows = []
        for k in range(rng.randint(5, 90)):
            u = rng.choice(names)
            rows.append([u, rng.choice(names[:12] + ["root"]), rng.choice([0, 1, 2, 2, 2]), 1 - k / 50, k + 1, rng.random() < 0.9])
        limit = rng.randint(1, 12)
        got = dict(R.walk([tuple(r) for r in rows], limit, 0.0, ("root",)))
        want = model([tuple(r) for r in rows], limit, ("root",))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_evaluation_values(spark):
    s = spark.createDataFrame([(["doc1", "doc3", "doc6"], ["doc1", "doc2", "doc3", "doc4", "doc5"]), (["doc1", "doc3"], ["doc2", "doc1", "doc3"]), (["a", "b"], ["x", "y"]), ([], [])], "expected_docs array<string>, retrieved_docs array<string>")
    a, b, c, d = E.retrieval_metrics(s, 5).collect()
    assert (a.precision, round(a.recall, 4)) == (0.4, 0.6667) and b.mrr == 0.5 and (c.ndcg, c.hit_rate) == (0, 0) and d.precision == d.recall == d.mrr == 0
    lines = E.report_lines(E.report(E.retrieval_metrics(s), ["mrr"])).first().line
    assert lines.startswith("  mrr") and lines.endswith("0.3750")


def test_memory_merges(spark):
    assert M.apply_blocks("a b a", [("a", "x"), ("zz", "q"), ("", "end")]) == "x b a\nend"
    p = spark.createDataFrame([("k", 1, "5", "first", "p1"), ("k", 2, "", "second", None), ("k", 3, "2.5", None, "p3"), ("k", 4, "no", "", "")], "k string, seq int, n string, i string, p string")
    r = M.fold_fields(p, "k", "seq", {"n": "sum", "i": "immutable", "p": "patch"}).first()
    assert (r.n, r.i, r.p) == (7.5, "first", "p3")
    acts = spark.createDataFrame([(1, 0, "u", "merge"), (1, 1, "u", "delete"), (1, 2, "u", "merge"), (2, 0, "v", "delete"), (2, 1, "v", "delete"), (3, 0, "w", "merge"), (3, 1, "w", "delete")], "candidate int, pos bigint, uri string, action string")
    d = {r.candidate: (r.decision, [tuple(a) for a in r.actions]) for r in M.decide(spark.createDataFrame([(1, "create"), (2, "?"), (3, "skip")], "candidate int, decision string"), acts).collect()}
    assert d == {1: ("none", [("u", "merge")]), 2: ("create", [("v", "delete")]), 3: ("skip", [])}
    assert json.loads(M.json_object('x ```json\n{"a": "}"}\n``` y')) == {"a": "}"} and M.json_object("none") is None
    cands = spark.createDataFrame([(1, "ctx://u/memories/events/1", "new"), (2, "ctx://u/memories/profile/2", "me")], "candidate int, uri string, content string")
    settled = M.decide(spark.createDataFrame([(1, "none"), (2, "skip")], "candidate int, decision string"), spark.createDataFrame([(1, 0, "old", "merge")], "candidate int, pos bigint, uri string, action string"))
    out, counts = M.dispatch(cands, spark.createDataFrame([("old", "text")], "uri string, content string"), settled)
    assert {tuple(r) for r in out.collect()} == {("old", "text\n\n---\n\nnew"), ("ctx://u/memories/profile/2", "me")}
    assert counts.first().asDict() == {"created": 1, "skipped": 0, "merged": 1, "deleted": 0}


def test_links(spark):
    e = spark.createDataFrame([("s", "link_1", ["a", "b"], ""), ("s", "link_3", ["a"], "")], "src string, link_id string, uris array<string>, reason string")
    new = spark.createDataFrame([("s", ["c"], "r", 1), ("s", ["d"], "r", 2), ("t", ["x"], "r", 1)], "src string, uris array<string>, reason string, seq int")
    got = {(r.src, r.link_id) for r in store.link(e, new).collect()}
    assert got == {("s", "link_1"), ("s", "link_3"), ("s", "link_2"), ("s", "link_4"), ("t", "link_1")}
    assert {(r.link_id, tuple(r.uris)) for r in store.unlink(e, "s", "a").collect()} == {("link_1", ("b",))}


def test_tree_diff_kinds(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "uri string, content string")
    old = f(("ctx://r/x", "1"), ("ctx://r/d/a", "1"), ("ctx://r/d/e/b", "1"), ("ctx://r/same", "s"))
    new = f(("ctx://r/x/in", "1"), ("ctx://r/same", "t"), ("ctx://r/n", "1"))
    assert {tuple(r) for r in sync.tree_diff(old, new).collect()} == {("directory", "added", "ctx://r/x"), ("directory", "deleted", "ctx://r/d"), ("file", "deleted", "ctx://r/x"), ("file", "updated", "ctx://r/same"), ("file", "added", "ctx://r/n")}
    s = spark.createDataFrame([("a/.git/x.py", 1), ("a/.hid", 1), ("a/e.py", 0), ("a/t_skip.py", 2), ("a/b.py", 2), ("a/c.bin", 2)], "path string, length int")
    got = {r.path: r.status for r in sync.scan_files(s, [".py"], exclude="t_*").collect()}
    assert list(got.values()) == ["ignored_dir", "skipped", "skipped", "excluded", "processable", "unsupported"]


def test_sections_and_skeletons(spark):
    d = spark.createDataFrame([(1, "intro\n# One\nbody\n#### deep\n## Two\n\n### Three\nend")], "doc_id int, text string")
    got = [(r.level, r.heading, r.content) for r in P.sections(d).orderBy("section").collect()]
    assert got == [(0, "", "intro"), (1, "One", "body\n#### deep"), (2, "Two", ""), (3, "Three", "end")]
    src = [("a.py", "import os\nclass A:\n    def f(self): pass\nasync def g(): pass\n"), ("b.go", "package b\nconst C = 1\ntype T struct {\n}\nfunc (t *T) M() {}\nfunc N(a int, b string) error {}\n"), ("c.rs", "pub struct S;\npub trait Tr {}\nfn h() {}\n"), ("d.js", "export class Q extends Base {}\nfunction w() {}\nexport const arrow = async (x, y) => 1\n"), ("e.rb", "class R\n  def m\n  end\nend\n"), ("f.java", "package p.q;\npublic class J extends I {\n  public int k(int z) {}\n}\n"), ("g.cs", "public class K {\n  public void L() {}\n}\n"), ("h.php", "class O {\n  public function p() {}\n}\n"), ("i.cpp", "#include <x>\nclass Z {\n};\nint main() {\n}\n")]
    sk = {r.path: r for r in P.skeletons(spark.createDataFrame(src, "path string, content string")).collect()}
    got = {p: ([t.name for t in r.types], [f.name for f in r.functions]) for p, r in sk.items()}
    assert got == {"a.py": (["A"], ["g"]), "b.go": (["T"], ["M", "N"]), "c.rs": (["S"], ["h"]), "d.js": (["Q"], ["w", "arrow"]), "e.rb": (["R"], ["m"]), "f.java": (["J"], ["k"]), "g.cs": (["K"], ["L"]), "h.php": (["O"], ["p"]), "i.cpp": (["Z"], ["main"])}
    assert sk["a.py"].methods == ["f"] and sk["a.py"].imports == ["os"] and sk["a.py"].abstract == "class A [f]\nfunc g"
    assert sk["b.go"].abstract == "package b\nclass T\n(T) func M\nfunc N(a int, b string)" and sk["b.go"].functions[1].returns == "error"
    assert sk["d.js"].types[0].base == "Base" and sk["d.js"].functions[1].params == "x, y" and sk["f.java"].abstract == "package p.q\nclass J extends I\nfunc k(int z)"
    assert sk["c.rs"].interfaces == ["Tr"] and sk["b.go"].constants == ["C"]
    head, rest = P.front_matter(F.col("t"))
    assert one(spark, head, t="---\na: 1\n---\nbody") == "a: 1" and one(spark, rest, t="---\na: 1\n---\nbody") == "body"
    parts = P.chunks(spark.createDataFrame([(1, "x" * 2500), (2, "a" * 700 + "\n\n" + "b" * 600), (3, None), (4, "  ")], "doc_id int, text string"), 1000, 200).collect()
    assert [(r.doc_id, r.start, len(r.content)) for r in parts] == [(1, 0, 1000), (1, 800, 1000), (1, 1600, 900), (2, 0, 700), (2, 502, 800)]
    twice = spark.createDataFrame([(1, "# A\nx"), (1, "# B\ny\n##  \n # C")], "doc_id int, text string")
    assert sorted((r.section, r.heading, r.content) for r in P.sections(twice).collect()) == [(1, "A", "x"), (1, "B", "y\n##"), (2, "C", "")]


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, t in files.items():
            z.writestr(n, t)
    return bytearray(b.getvalue())


def test_file_parsers(spark):
    ns = 'xmlns:w="w" xmlns:a="a" xmlns:p="p"'
    files = [
        ("x.html", bytearray(b"<html><head><title>T</title></head><body><nav>no</nav><h2>Head</h2><p>a<b>b</b></p><ul><li>i</li></ul><pre>c  d</pre></body></html>")),
        ("d.docx", _zip({"word/document.xml": f"<w:document {ns}><w:p><w:t>one &amp; two</w:t></w:p><w:p/><w:p><w:t>three</w:t></w:p></w:document>"})),
        ("s.xlsx", _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="First"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>h|1</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c></row><row><c><v>5</v></c></row></sheetData></worksheet>'})),
        ("b.epub", _zip({"nav.xhtml": "<p>toc</p>", "c1.xhtml": "<h1>Ch</h1>"})),
        ("p.pptx", _zip({"ppt/slides/slide1.xml": f'<s {ns}><p:sp><p:ph type="title"/><a:p><a:t>Ti</a:t></a:p></p:sp><p:sp><a:p><a:t>body</a:t></a:p></p:sp></s>'})),
        ("z.zip", _zip({"a.txt": "1", "b.txt": "2", "c.py": "3"})),
        ("o.doc", bytearray(bytes.fromhex("d0cf11e0a1b11ae1") + bytes(504) + "Hello there".encode("utf-16-le"))),
        ("f.pdf", bytearray(b"%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\nBT (Hi) Tj 0 -14 Td [(th) -300 (ere \\(x\\))] TJ ET\nendstream\n2 0 obj << /Filter /FlateDecode /P << /A 1 >> >>\nstream\n" + zlib.compress(b"BT <486F> Tj (\\101) ' ET") + b"\nendstream")), ("bad.pdf", bytearray(b"nope")), ("m.png", bytearray(b"123")), ("n.unknown", bytearray(b"")),
    ]
    got = {r.path: r for r in documents.parse(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert "n.unknown" not in got and got["bad.pdf"].error.startswith("ValueError")
    md = got["x.html"].markdown
    assert "## Head" in md and "**b**" in md and "- i" in md and "c  d" in md and "no" not in md
    assert got["d.docx"].markdown == "one & two\nthree" and "| h\\|1 |\n| --- |\n| 5 |" in got["s.xlsx"].markdown and got["s.xlsx"].title == "First"
    assert got["b.epub"].part == "c1.xhtml" and got["p.pptx"].title == "Ti" and "- .txt: 2\n- .py: 1" in got["z.zip"].markdown
    assert got["o.doc"].markdown == "Hello there" and got["f.pdf"].markdown == "## Page 1\n\nHi\nth ere (x)\n\n---\n\n## Page 2\n\nHoA" and "3 bytes" in got["m.png"].markdown


def test_packs(spark):
    files = spark.createDataFrame([("a/b.md", bytearray(b"1")), ("c.md", bytearray(b"2")), ("x/.manifest.json", bytearray(b"{}"))], "path string, content binary")
    packs = documents.pack(files, 2)
    assert {(r.path, bytes(r.content)) for r in documents.unpack(packs).collect()} == {("a/b.md", b"1"), ("c.md", b"2")}
    assert [r.path for r in documents.unpack(packs, files.where("path = 'c.md'")).collect()] == ["a/b.md"]


def test_statistics(spark):
    log = spark.createDataFrame([("memory", 3, [0.9, 0.8, 0.7], 50.0, False), ("resource", 0, [], 30.0, True)], "query_type string, result_count int, scores array<double>, latency_ms double, used_rerank boolean")
    r = G.retrieval_stats(log).first()
    assert (r.queries, r.results, r.zero_results, r.max_score, r.min_score, r.avg_latency) == (2, 3, 1, 0.9, 0.7, 40.0)
    assert G.retrieval_stats(log.limit(0)).first().avg_score == 0
    h = {x.le: x["count"] for x in G.histogram(spark.createDataFrame([("a", 1.0), ("a", 7.0), ("a", 99999.0)], "k string, v double"), "v", ["k"]).collect()}
    assert h["1"] == 1 and h["10"] == 2 and h["10000"] == 2 and h["+Inf"] == 3 and len(h) == 13
    up = G.component_health(spark.createDataFrame([(0,)], "errors int"), spark.createDataFrame([(False,), (True,)], "up boolean"), spark.createDataFrame([(1,)], "free_bytes long"))
    assert {r.component: r.healthy for r in up.collect()} == {"queue": True, "models": True, "storage": False}


def test_messages(spark):
    m = spark.createDataFrame([(1, 0, "user", "x" * 100), (1, 1, "assistant", "ok"), (1, 2, "user", "y" * 400), (1, 3, "user", "z")], "session_id int, seq int, role string, content string")
    s = spark.createDataFrame([(1, "sum" * 1000)], "session_id int, summary string")
    got = [(r.kind, r.text[:8]) for r in S.assemble(m, s, 60).orderBy("place").collect()]
    assert got == [("message", "User: xx"), ("message", "Assistan")]  # the summary is too big; the first overflow ends it
    lines = spark.createDataFrame([(1, 0, '{"role":"user","parts":[{"type":"odd","x":1},{"type":"text","text":"hi"}]}')], "session_id int, seq int, line string")
    r = S.from_jsonl(lines).select(S.first_text().alias("t"), F.size(S.parts_of("text")).alias("n")).first()
    assert r.t == '{"type":"odd","x":1}' and r.n == 2


def test_catalog(spark, tmp_path):
    (tmp_path / "t.yaml").write_text("memory_type: tools\nfields:\n  - name: calls\n    type: int64\n    merge_op: sum\n  - name: note\n    field_type: string\n")
    schema, ops = catalog.memory_schema(str(tmp_path / "t.yaml"))
    assert schema.simpleString() == "struct<calls:bigint,note:string>" and ops == {"calls": "sum", "note": "patch"}
    assert catalog.render("Hi {{ .name }}{{ .gone }}!", {"name": "Bo"}) == "Hi Bo!"
    skills = catalog.skills(spark.createDataFrame([("s/SKILL.md", "---\nname: fix\ndescription: d\n---\n# Use\nsteps\n# Use\nagain")], "path string, content string"))
    r = skills.first()
    assert (r.name, r.description, r.sections) == ("fix", "d", {"use": "again"})
    (tmp_path / "d.json").write_text(json.dumps({"samples": [{"id": "1", "query": "q", "expected_docs": ["a"], "retrieved_docs": ["a"], "generated_answer": "", "ground_truth": ""}]}))
    assert E.retrieval_metrics(catalog.dataset(spark, str(tmp_path / "d.json"))).first().precision == 1
    done = catalog.bootstrap(spark, "ctx", "me", "bot", spark.createDataFrame([("ctx://resources", 0)], "uri string, level int"))
    assert done.where("uri = 'ctx://resources' and level = 0").count() == 0 and done.count() > 5


def test_stream_sync(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("one")
    seen = []
    state = stream.Snapshots(spark, str(tmp_path / "state"), "path string, hash string")

    def run():
        q = stream.sync_hashes(stream.watch(spark, str(src)), state, lambda df: seen.append(sorted((r.path[-4:], r.status) for r in df.collect())), str(tmp_path / "cp"))
        q.awaitTermination(120)

    run()
    (src / "b.md").write_text("two")
    run()
    assert [x for x in seen if x] == [[("a.md", "added")], [("b.md", "added")]]
    assert state.read().count() == 2


def test_stream_windows_equal_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "e").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "e" / "p"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e" / "p"))
    q = activity.windowed(live, "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.event_type, str(r.window.start), r.n) for r in df.collect())
    assert key(spark.table("w")) == key(activity.windowed(events, "1 day"))
    assert activity.sessions(events, "1 hour").agg(F.sum("n")).first()[0] == events.count()


def test_materialize(spark):
    df = materialize(spark.range(5), "t")
    assert df.count() == 5 and df.dtypes == spark.range(1).dtypes


def test_upsert_stream(spark, tmp_path):
    schema = "id string, created_at timestamp, text string"
    state = stream.Snapshots(spark, str(tmp_path / "rows"), schema)
    src = str(tmp_path / "in")

    def send(*rows):
        spark.createDataFrame(list(rows), "id string, created_at string, text string, seq long").withColumn("created_at", F.to_timestamp("created_at")).coalesce(1).write.mode("append").parquet(src)
        changes = spark.readStream.schema(schema + ", seq long").parquet(src)
        stream.upsert_stream(changes, state, str(tmp_path / "cp")).awaitTermination(120)

    send(("a", "2024-01-01", "old", 1), ("a", "2024-01-02", "new", 2), ("b", "2024-01-01", "x", 1))
    send(("b", "2024-01-09", "y", 5))
    assert {(r.id, str(r.created_at)[:10], r.text) for r in state.read().collect()} == {("a", "2024-01-01", "new"), ("b", "2024-01-01", "y")}


def test_skill_files_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("s/SKILL.md", "fix", "mends things", {"use": "steps", "notes": "none"})], "path string, name string, description string, sections map<string,string>")
    back = catalog.skills(catalog.skill_markdown(rows)).first()
    assert (back.name, back.description, back.sections) == ("fix", "mends things", {"use": "steps", "notes": "none"})
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "session.json").write_text(json.dumps({"info": {"id": "s1", "title": "t"}, "messages": [{"role": "user", "content": "hi", "timestamp": ""}, {"role": "assistant", "content": "yo", "timestamp": ""}]}))
    assert [(r.session_id, r.seq, r.content) for r in catalog.sessions(spark, f"{tmp_path}/*/session.json").orderBy("seq").collect()] == [("s1", 0, "hi"), ("s1", 1, "yo")]
    (tmp_path / "rec.json").write_text(json.dumps({"queries": [{"id": "1", "query": "q", "retrieved_uris": ["u"], "latency_ms": 3}, {"id": "2", "query": "q", "retrieved_uris": ["w"]}, {"id": "3", "query": "e", "retrieved_uris": []}]}))
    made = E.dataset_from_recordings(catalog.recordings(spark, f"{tmp_path}/rec.json"), 10).collect()
    assert [(r.query, r.expected_docs) for r in made] == [("q", ["u"])]


def test_locks(spark):
    held = spark.createDataFrame([("h1", "a/b", "subtree", "2024-01-02"), ("h2", "a/c", "point", "2024-01-02"), ("h3", "z", "subtree", "2023-01-01")], "handle string, path string, kind string, expires_at string").withColumn("expires_at", F.to_timestamp("expires_at"))
    wanted = spark.createDataFrame([("r1", "a/b/x", "point"), ("r2", "a", "subtree"), ("r3", "a/c", "point"), ("r4", "z", "point"), ("r5", "a/bb", "point"), ("r6", "a", "point")], "request string, path string, kind string")
    got = {tuple(r) for r in G.lock_conflicts(held, wanted, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {("r1", "h1"), ("r2", "h1"), ("r2", "h2"), ("r3", "h2")}


def test_lock_pairs_by_tiles(spark, monkeypatch):
    """Any tiles give each pair once, also where requests and handles have several rows."""
    monkeypatch.setattr(G, "TILE", 3)
    rng = random.Random(4)
    path = lambda: rng.choice([None, "a/", "/".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))])
    rows = lambda c: [(rng.choice([None, *(f"{c}{k}" for k in range(60))]), path(), rng.choice(["point", "subtree", None])) for _ in range(90)]
    asked, locks = rows("r"), rows("h")
    below = lambda p, q: p == q or p.startswith(q + "/")
    clash = lambda p, k, q, h: p is not None and q is not None and (p == q or h == "subtree" and below(p, q) or k == "subtree" and below(q, p))
    want = {(r, h) for r, p, k in asked for h, q, hk in locks if clash(p, k, q, hk)}
    at = F.lit("2024-01-01").cast("timestamp")
    held = spark.createDataFrame(locks, "handle string, path string, kind string").withColumn("expires_at", F.lit("2024-01-02").cast("timestamp"))
    got = [tuple(r) for r in G.lock_conflicts(held, spark.createDataFrame(asked, "request string, path string, kind string"), at).collect()]
    assert len(got) == len(want) and set(got) == want


def test_lock_pairs_are_not_shuffled(spark):
    """Pairs grow with the square of a path's rows; what is shuffled grows with the rows."""
    held = spark.range(400).select(F.concat(F.lit("h"), "id").alias("handle"), F.lit("a").alias("path"), F.lit("subtree").alias("kind"), F.lit("2024-01-02").cast("timestamp").alias("expires_at"))
    wanted = spark.range(400).select(F.concat(F.lit("r"), "id").alias("request"), F.concat(F.lit("a/"), "id").alias("path"), F.lit("point").alias("kind"))
    sc = spark.sparkContext
    sc.setJobGroup("locks", "locks")
    try:
        assert len(G.lock_conflicts(held, wanted, F.lit("2024-01-01").cast("timestamp")).collect()) == 160000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, store_ = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("locks") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(store_.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 20000


def test_upsert_ties_and_glob_classes(spark):
    base = spark.createDataFrame([], "id string, created_at string, v int")
    rows = [("a", "c", k, 1) for k in range(20)]
    out = {store.upsert(base, spark.createDataFrame(rows[k:] + rows[:k], "id string, created_at string, v int, seq long").repartition(3)).first().v for k in range(3)}
    assert len(out) == 1
    fits = lambda p, t: re.fullmatch(store.glob_pattern(p), t) is not None
    assert fits("a[^b-d]e", "axe") and not fits("a[^b-d]e", "ace") and not fits("a[^b]e", "a/e") and fits(r"\*[\]x]", "*]") and fits("[a-c]?*.md", "bz.md")
    for bad in ("[", "a[]", "[z-a]", "x\\", "[a"):
        with pytest.raises(ValueError):
            store.glob_pattern(bad)


def test_fold_text_streams_hot_keys(spark):
    rows = [(None, 1, "n")] + [(1, k, f"<<<<<<< SEARCH\n\n=======\nl{k}\n>>>>>>> REPLACE") for k in range(3000)] + [(2, 1, "x"), (2, 2, ""), (2, 3, None)]
    out = {r.k: r.t for r in M.fold_text(spark.createDataFrame(rows, "k long, s int, t string").repartition(5), "k", "s", "t").collect()}
    assert out == {None: "n", 1: "\n".join(f"l{k}" for k in range(3000)), 2: "x"}


def test_names_and_scopes(spark):
    rows = spark.createDataFrame([(k, "b" if k % 3 else None) for k in range(200)], "i int, base string").repartition(7)
    got = {r.i: r.name for r in sync.unique_names(rows, "base", "i").collect()}
    want, n = {}, 0
    for k in range(200):
        want[k] = None if k % 3 == 0 else "b" if n == 0 else f"b_{n}"
        n += k % 3 > 0
    assert got == want
    u = lambda c, **v: one(spark, c, **v)
    assert u(U.sanitize_segment(F.col("t")), t=" a/b c\\漢 ") == "a_b_c_漢" and u(U.sanitize_segment(F.col("t")), t="  ") == "unnamed"
    assert u(U.sanitize_name(F.col("t")), t="My Tool/2") == "my_tool_2" and u(U.sanitize_file(F.col("t")), t="a b:c/d" + "x" * 99) == "a-b_c_d" + "x" * 93
    a = F.lit("a")
    assert u(U.category_prefix(F.col("t"), F.lit("u"), a), t="cases") == "ctx://agent/a/memories/cases/" and u(U.category_prefix(F.col("t"), F.lit("u"), a), t="profile") == ""
    assert u(U.root_uris(F.col("t"), F.lit("user"), F.lit("u"), a), t="skill") == ["ctx://agent/a/skills"] and u(U.root_uris(F.col("t"), F.lit("root"), F.lit("u"), a), t="skill") == []


def test_ranked_metrics_equal_array_metrics(spark):
    rng = random.Random(3)
    samples = []
    for q in range(40):
        docs = [f"d{k}" for k in rng.sample(range(30), 10)]
        samples.append((q, [f"d{k}" for k in rng.sample(range(30), rng.randint(0, 8))], docs[: rng.randint(0, 10)]))
    s = spark.createDataFrame(samples, "query_id long, expected_docs array<string>, retrieved_docs array<string>")
    names = ["precision", "recall", "mrr", "ndcg", "hit_rate"]
    want = {r.query_id: [round(r[n], 9) for n in names] for r in E.retrieval_metrics(s, 5).collect()}
    ranked = s.select("query_id", "expected_docs", F.posexplode("retrieved_docs").alias("p", "d")).select("query_id", (F.col("p") + 1).alias("rank"), F.array_contains("expected_docs", F.col("d")).alias("hit"))
    got = {r.query_id: [round(r[n], 9) for n in names] for r in E.ranked_metrics(ranked, s.select("query_id", F.size("expected_docs").alias("n")), 5).collect()}
    assert got == want
