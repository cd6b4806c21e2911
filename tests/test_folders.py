"""Folder sync by keyed state: any split into batches, deletions, late rows and what is written."""

import random
from pathlib import Path

import pytest

from quiverlake.operators import sync
from quiverlake.streaming import folders as S

FILES, MARKS = "path string, version long, content string", "path string, version long, kind string"


class Stage:
    def __init__(self, spark, root):
        self.spark, self.root = spark, str(root)
        spark.createDataFrame([], MARKS).write.parquet(f"{self.root}/marks")

    def put(self, rows, schema=FILES, name="files"):
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def run(self):
        files = self.spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/files")
        marks = self.spark.readStream.schema(MARKS).parquet(f"{self.root}/marks")
        S.start(S.changes_of(files, marks), lambda df, n: df.write.mode("overwrite").parquet(f"{self.root}/out/b{n}"), f"{self.root}/ck").awaitTermination()

    def out(self):
        return sorted(tuple(r) for r in self.spark.read.parquet(f"{self.root}/out/*").select("version", "path", "status").collect())

    def known(self):
        return {tuple(r) for r in S.known(self.spark, f"{self.root}/ck").collect()}


@pytest.fixture
def stage(spark, tmp_path):
    return Stage(spark, tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_same_state(spark, stage, seed):
    rng = random.Random(seed)
    rows = [(f"{rng.choice('abcdef')}.md", v, rng.choice("xyz")) for v in range(30)]
    newest = {p: c for p, _, c in rows}
    mixed = rng.sample(rows, len(rows)) + rows[:5]  # in any order, some twice
    at = 0
    while at < len(mixed):
        n = rng.randrange(4, 16)
        stage.put(mixed[at : at + n])
        at += n
    stage.run()
    want = sync.snapshot(spark.createDataFrame(list(newest.items()), "path string, content string"))
    assert stage.known() == {tuple(r) for r in want.collect()}
    plan = sync.sync_plan(S.known(spark, f"{stage.root}/ck"), spark.createDataFrame(list(newest.items()), "path string, content string"), "t")
    assert plan.collect() == []


def test_deletions_late_rows_and_forgetting(spark, stage):
    stage.put([("a.md", 1, "x"), ("b.md", 1, "y"), ("c.bin", 1, "z"), (None, 1, "n"), ("d.md", None, "n"), (".git/e.md", 1, "n")])
    stage.run()
    assert stage.out() == [(1, "a.md", "added"), (1, "b.md", "added")]
    gone = S.tombstones(spark, f"{stage.root}/ck", spark.createDataFrame([("a.md",)], "path string"), 5)
    stage.put(gone.collect(), MARKS, "marks")
    stage.put([("b.md", 4, "late"), ("a.md", 6, "x")])  # older than the deletion; a newer version of equal content
    stage.run()
    assert stage.out()[2:] == [(5, "b.md", "removed")]
    assert {r[0] for r in stage.known()} == {"a.md"}
    assert {(r.path, r.hash is None, r.version) for r in S.state_of(spark, f"{stage.root}/ck").collect()} == {("a.md", False, 6), ("b.md", True, 5)}
    # a deleted file comes back, and one that came after the listing isn't deleted by it
    assert S.tombstones(spark, f"{stage.root}/ck", spark.createDataFrame([], "path string"), 6).collect() == []
    stage.put([("b.md", 7, "again")])
    stage.run()
    assert stage.out()[3:] == [(7, "b.md", "added")]
    stage.put(S.tombstones(spark, f"{stage.root}/ck", spark.createDataFrame([("a.md",)], "path string"), 8).collect(), MARKS, "marks")
    stage.run()
    stage.put(S.forgettable(spark, f"{stage.root}/ck", 8).collect(), MARKS, "marks")
    stage.run()
    assert {r.path for r in S.state_of(spark, f"{stage.root}/ck").collect()} == {"a.md"}


def test_state_is_written_for_changes_only(spark, stage):
    stage.put([(f"f{k}.md", 1, "x" * 50) for k in range(3000)])
    stage.run()
    deltas = lambda: {p: p.stat().st_size for p in Path(f"{stage.root}/ck/state").rglob("*.delta")}
    first = deltas()
    stage.put([("f7.md", 2, "new")])
    stage.run()
    fresh = sum(size for p, size in deltas().items() if p not in first)
    assert stage.out()[-1] == (2, "f7.md", "changed")
    assert fresh < sum(first.values()) / 50
