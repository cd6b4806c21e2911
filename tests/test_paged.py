"""The paged source: whole listings, missing pages, streams that go on where they stopped."""

import json
from pathlib import Path

import pytest

from quiverlake.sources.paged import PagedSource


def _page(root, n, rows, total):
    folder = Path(root) / f"page={n}"
    folder.mkdir(parents=True)
    (folder / "part-0.json").write_text(json.dumps({"list": rows, "pager": {"page": n, "totalRows": total}}))
    (folder / "_SUCCESS").write_text("")


def _row(k):
    return {"path": f"n/{k}.md", "content": f"text {k}", "version": k}


@pytest.fixture
def source(spark):
    spark.dataSource.register(PagedSource)
    return lambda root: spark.read.format("paged").option("pageSize", 3).load(str(root))


def test_all_pages_in_a_batch(source, tmp_path):
    for n in range(1, 4):
        _page(tmp_path, n, [_row(k) for k in range(3 * n - 3, min(3 * n, 8))], 8)
    df = source(tmp_path)
    assert sorted(map(tuple, df.collect())) == [(k // 3 + 1, f"n/{k}.md", f"text {k}", k) for k in range(8)]
    assert df.rdd.getNumPartitions() == 3


def test_no_pages_and_missing_ones(source, tmp_path):
    assert source(tmp_path / "none").collect() == []
    _page(tmp_path, 1, [_row(0), {"path": None}, {}], 7)
    _page(tmp_path, 3, [_row(6)], 7)
    with pytest.raises(Exception, match="page 2 of .* is missing"):
        source(tmp_path).collect()


def test_a_stream_goes_on(spark, source, tmp_path):
    out = []

    def run():
        s = spark.readStream.format("paged").load(str(tmp_path / "pages"))
        s.writeStream.foreachBatch(lambda df, n: out.extend(r.version for r in df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for n in (1, 2, 4):  # the fourth waits for the third
        _page(tmp_path / "pages", n, [_row(n * 10), _row(n * 10 + 1)], 0)
    run()
    assert sorted(out) == [10, 11, 20, 21]
    _page(tmp_path / "pages", 3, [_row(30)], 0)
    run()
    run()
    assert sorted(out) == [10, 11, 20, 21, 30, 40, 41]
