"""Ranks by ranges, and what is built on them."""

import random
from functools import partial

import duckdb
from pyspark.sql import functions as F

from quiverlake.operators import ranks, store, sync
from quiverlake.plans import registry


def test_number_ranks_within_keys(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.randrange(50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "key string, o int, id int").repartition(7)
    got = {r.id: r.n for r in ranks.number(df, ["key"], ["o", "id"], "n").collect()}
    want, seen = {}, {}
    for key, o, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        seen[key] = seen.get(key, 0) + 1
        want[i] = seen[key]
    assert got == want


def test_links_fill_gaps(spark):
    rng = random.Random(2)
    taken = {s: rng.sample(range(1, 60), rng.randrange(0, 40)) for s in "abcd"}
    edges = spark.createDataFrame([(s, f"link_{n}", ["x"], "old") for s, ns in taken.items() for n in ns] + [("a", "other", ["y"], "named")], "src string, link_id string, uris array<string>, reason string")
    new = spark.createDataFrame([(s, ["t"], f"r{k}", k) for k, s in enumerate("abcde" * 30)], "src string, uris array<string>, reason string, seq int")
    got = {(r.src, r.reason): r.link_id for r in store.link(edges, new).where("reason like 'r%'").collect()}
    for s in "abcde":
        free = (n for n in range(1, 200) if n not in taken.get(s, ()))
        for k in range(150):
            if "abcde"[k % 5] == s:
                assert got[s, f"r{k}"] == f"link_{next(free)}"
    assert store.link(edges, new.limit(0)).count() == edges.count()


def test_rollup_of_a_flat_folder_by_parts(spark):
    rows = [("root", None, 0, None), ("root/empty", "root", 1, "none")] + [(f"root/{k:03d}", "root", 1, f"t{k}") for k in range(100)]
    nodes = spark.createDataFrame(rows, "node string, parent string, depth int, text string")
    joined = lambda names, texts: F.array_join(texts, ";")
    one = {r.node: (r.text, r.leaves) for r in sync.rollup(nodes, joined).collect()}
    parts = {r.node: (r.text, r.leaves) for r in sync.rollup(nodes, joined, fan=7).collect()}
    assert one == parts and one["root"] == (";".join([f"t{k}" for k in range(100)] + ["none"]), 101)


def test_rollup_of_names_by_parts(spark, sf, monkeypatch):
    """Folders of more children than a row holds keep every name, also where the parts are too many again."""
    monkeypatch.setattr(sync, "rollup", partial(sync.rollup, fan=2))
    got = {(r.uri, r.leaves, r.summary) for r in registry.QUERIES["rollup_tree"](spark, sf).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = con.sql("SELECT uri, leaves, summary FROM (" + registry.ORACLES["rollup_tree"] + ")").fetchall()
    assert got == set(found) and max(leaves for _, leaves, _ in found) > 4
