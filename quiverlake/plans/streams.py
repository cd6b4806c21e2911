"""Queries that run a stream over staged tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.plans.registry import query
from quiverlake.session import work_folder
from quiverlake.sources import tables as T
from quiverlake.sources.paged import PagedSource
from quiverlake.streaming import folders as S

_ROUNDS = 3
_CONTENT = "text || CASE WHEN {r} > 0 AND doc_id % 3 = 1 THEN ' v' || {r} ELSE '' END"
_THERE = "(NOT ({r} = 1 AND doc_id % 5 = 2) AND NOT ({r} = 2 AND doc_id % 5 = 2 AND doc_id % 10 <> 2))"
_PATH = "concat('notes/', doc_id, CASE WHEN doc_id % 7 = 0 THEN '.bin' ELSE '.md' END)"


@query(f"""WITH r AS (SELECT doc_id, r, {_CONTENT.format(r='r')} AS c, {_CONTENT.format(r='(r - 1)')} AS b, {_THERE.format(r='r')} AS now, r > 0 AND {_THERE.format(r='(r - 1)')} AS before FROM documents, range({_ROUNDS}) t(r) WHERE doc_id % 7 <> 0)
 SELECT CAST(r AS BIGINT) AS round, 'notes/' || doc_id || '.md' AS path, CASE WHEN now AND NOT before THEN 'added' WHEN now THEN 'changed' ELSE 'removed' END AS status, sha256(CASE WHEN now THEN c ELSE b END) AS hash
 FROM r WHERE now <> before OR now AND before AND c <> b""")
def folder_stream(spark, sf):
    """A folder synced three times: new versions come as a stream in several batches, deletions from listings."""
    d = T.load(spark, sf, "documents")
    root = work_folder(spark, "folder")
    file_schema, mark_schema = "path string, version long, content string", "path string, version long, kind string"

    def run() -> None:
        files = spark.readStream.schema(file_schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/files")
        marks = spark.readStream.schema(mark_schema).parquet(f"{root}/marks")
        S.start(S.changes_of(files, marks), lambda out, n: out.write.mode("overwrite").parquet(f"{root}/out/batch={n}"), f"{root}/checkpoint").awaitTermination()

    spark.createDataFrame([], mark_schema).write.parquet(f"{root}/marks")
    for r in range(_ROUNDS):
        content, there = F.expr(_CONTENT.format(r=r)), F.expr(_THERE.format(r=r))
        # what a source of files shows: new files and those whose content is another
        new = F.lit(True) if r == 0 else ~F.expr(_THERE.format(r=r - 1)) | (content != F.expr(_CONTENT.format(r=r - 1)))
        d.where(there & new).select(F.expr(_PATH).alias("path"), F.lit(10 * r).cast("long").alias("version"), content.alias("content")).repartition(3, "path").write.mode("append").parquet(f"{root}/files")
        run()
        listing = d.where(there).select(F.expr(_PATH).alias("path"))
        S.tombstones(spark, f"{root}/checkpoint", listing, 10 * r + 5).write.mode("append").parquet(f"{root}/marks")
        run()
    out = spark.read.schema("path string, status string, hash string, version long").parquet(f"{root}/out")
    return out.select(F.floor(F.col("version") / 10).alias("round"), "path", "status", "hash")


_PAGE = 40


def _stage_pages(spark, rows, folder: str) -> None:
    """Rows ``(n, path, content, version)``, numbered from 0, as pages."""
    total = rows.count()
    entry = F.struct("path", "content", "version")
    pages = rows.groupBy((F.floor(F.col("n") / _PAGE) + 1).cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: x.e).alias("list"), F.struct("page", F.lit(total).alias("totalRows")).alias("pager")))
    pages.select("page", body.alias("value")).repartition("page").write.mode("append").partitionBy("page").text(folder)


@query(f"""SELECT way, CAST(page_id // {_PAGE} + 1 AS INTEGER) AS page, url AS path, sha256(html) AS hash, page_id AS version FROM pages, (VALUES ('batch'), ('stream')) w(way)""")
def paged_source(spark, sf):
    """Web pages from a paged listing, read at once and by a stream that is stopped and goes on; each row once."""
    root = work_folder(spark, "paged")
    rows = T.load(spark, sf, "pages").select(F.col("page_id").alias("n"), F.col("url").alias("path"), F.col("html").alias("content"), F.col("page_id").alias("version"))
    spark.dataSource.register(PagedSource)

    def run() -> None:
        stream = spark.readStream.format("paged").option("pageSize", _PAGE).load(f"{root}/pages")
        stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _stage_pages(spark, rows, f"{root}/all")
    both = [spark.read.format("paged").option("pageSize", _PAGE).load(f"{root}/all").select(F.lit("batch").alias("way"), "*")]
    for part in ("n < 80", "n >= 80"):  # the second run finds the pages that came after the first
        _stage_pages(spark, rows.where(part), f"{root}/pages")
        run()
    out = spark.read.schema("page int, path string, content string, version long").parquet(f"{root}/out")
    both.append(out.select(F.lit("stream").alias("way"), "page", "path", "content", "version"))
    return both[0].unionByName(both[1]).select("way", "page", "path", F.sha2("content", 256).alias("hash"), "version")
