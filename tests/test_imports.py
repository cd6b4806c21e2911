"""Where imported trees go, and profiles that are merged in order."""

from pyspark.sql import functions as F

from quiverlake.operators import memory, sync
from quiverlake.plans import imports


def test_repositories(spark):
    urls = ["https://github.com/org/repo", "https://github.com/org/repo.git", "https://gitlab.com/a/b/tree/main", "https://bitbucket.org/only", "https://example.org/a/b", "git@github.com:a/b", None]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "k int, u string")
    got = [r[0] for r in rows.orderBy("k").select(sync.repository(F.col("u"))).collect()]
    assert got == ["org/repo", "org/repo", "a/b", None, None, None, None]


def test_targets_take_the_first_free_suffix(spark):
    schema = "seq int, scope string, name string, url string"
    rows = [(k, "user", "My notes/x", None) for k in range(4)] + [(10, "nowhere", None, ""), (11, "agent", "n", "https://github.com/o/r.git"), (12, "agent", "m", "https://gitlab.com/o/r")]
    existing = [("ctx://user/My_notes_x",), ("ctx://user/My_notes_x_2",), ("ctx://user/My_notes_x_02",), ("ctx://agent/o/r_1",), ("ctx://resources/other",)]
    got = {r.seq: r.uri for r in sync.import_targets(spark.createDataFrame(rows, schema), spark.createDataFrame(existing, "uri string")).collect()}
    assert got == {0: "ctx://user/My_notes_x_1", 1: "ctx://user/My_notes_x_3", 2: "ctx://user/My_notes_x_4", 3: "ctx://user/My_notes_x_5", 10: "ctx://resources/unnamed", 11: "ctx://agent/o/r", 12: "ctx://agent/o/r_2"}


def test_suffixes_end_at_101(spark):
    rows = spark.range(110).selectExpr("id AS seq", "'user' AS scope", "'a' AS name", "CAST(NULL AS STRING) AS url")
    got = {r.seq: r.uri for r in sync.import_targets(rows, spark.createDataFrame([("ctx://user/a_7",)], "uri string")).collect()}
    assert got[0] == "ctx://user/a" and got[6] == "ctx://user/a_6" and got[7] == "ctx://user/a_8" and got[99] == "ctx://user/a_100"
    assert {got[k] for k in range(100, 110)} == {"ctx://user/a_101"}


def test_profiles_are_merged_in_order(spark):
    known = spark.createDataFrame([("a", "A"), ("b", "  "), ("c", None), ("d", "D")], "uri string, content string")
    found = spark.createDataFrame([("a", 2, "s2", "two"), ("a", 1, "s1", "one"), ("b", 1, "x", "new"), ("b", 2, "skip", "no"), ("c", 1, None, None), ("c", 2, "y", "late"), ("e", 1, "z", "E")], "uri string, seq int, abstract string, content string")
    merge = lambda profile, abstract, content: None if abstract == "skip" else f"{profile}+{content}"
    got = {r.uri: (r.content, r.merged) for r in memory.merge_profiles(known, found, merge).collect()}
    assert got == {"a": ("A+one+two", 2), "b": ("new", 0), "c": ("late", 0), "d": ("D", 0), "e": ("E", 0)}
    assert memory.merge_profiles(known.limit(0), found.limit(0), merge).collect() == []


def test_office_files_of_short_and_odd_texts():
    from quiverlake.sources import documents as D

    for text in ("one", "a | b <c> & d", "x " * 100):
        sheets = D.xlsx(imports._sheets(text))
        assert [t for _, t, _ in sheets] == ["Front", "Back"]
        assert [w for _, _, m in sheets for w in m.replace("\\|", "¦").replace("|", " ").replace("---", " ").replace("¦", "|").split() if w not in ("##", "Front", "Back")] == text.split()
        assert " ".join(m.split("\n\n", 1)[0].split(": ", 1)[1] + " " + m.split("\n\n", 1)[1].replace("\n", " ") for _, _, m in D.pptx(imports._slides(text))).split() == text.split()
        assert "5 files" in D.archive_listing(imports._archive(text))[0][2]
