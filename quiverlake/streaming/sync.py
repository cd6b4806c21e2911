"""Incremental sync of files by hash, and upserts of context rows, as streams.

A watched folder is a file stream; each micro-batch is compared with a snapshot table of path and hash, so
that files that did not change cost nothing further.  Deletions can't be seen by a stream: compare a listing
with :func:`quiverlake.operators.sync.diff`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quiverlake.operators import store


def watch(spark: SparkSession, folder: str, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """Stream of files ``(path, content, modificationTime, length)`` below a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(folder)


class Snapshots:
    """Versions of a table in a folder; a version is complete once its mark is written."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(conf)
        names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, version: int) -> None:
        """Write a version; a repeated batch writes the same version again."""
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")


def sync_hashes(files: DataFrame, state: Snapshots, changed: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Call ``changed`` with the new and changed files of each batch and keep their hashes.

    ``changed`` gets ``(path, hash, content, status)``; hashes are kept after it has returned, so that a failed
    batch is offered again.
    """

    def batch(df: DataFrame, number: int) -> None:
        known = state.read()
        now = df.select("path", F.sha2(F.col("content"), 256).alias("hash"), "content")
        fresh = now.join(known.withColumnRenamed("hash", "old"), "path", "left").where(F.col("old").isNull() | (F.col("old") != F.col("hash")))
        changed(fresh.select("path", "hash", "content", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("status")))
        rest = known.join(now.select("path"), "path", "left_anti")
        state.write(rest.select("path", "hash").unionByName(now.select("path", "hash")), number + 1)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(changes: DataFrame, state: Snapshots, checkpoint: str) -> StreamingQuery:
    """Merge a stream of context rows with ``seq`` into the snapshot table, last writer first."""

    def batch(df: DataFrame, number: int) -> None:
        state.write(store.upsert(state.read(), df), number + 1)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
