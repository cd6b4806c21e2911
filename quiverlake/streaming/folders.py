"""Folder sync as a stream with keyed state: what is known of each path, with tombstones.

The stream carries versions of files, ``(path, version, content)``, and deletions; the state holds the hash and
the version of each path.  A batch reads and writes the state of the paths that it names and of no others, so that
an unchanged folder costs nothing, however large it is.  Rows older than what is known are passed over, hence
splits of the stream into batches, and repeated rows, make no difference to what is known at the end.

A stream of files can't show what has gone.  :func:`tombstones` compares a listing with the paths of the state,
which it reads from the checkpoint; its rows are appended to the folder of deletions that the stream reads too.
A deletion stays in the state, so that an older version can't bring the file back, until :func:`forgettable` rows
of it are appended likewise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quiverlake.operators import sync

#: Rows of the stream; kinds are file, deletion and forget.
CHANGES = "path string, version long, hash string, kind string"

_OUT = "path string, status string, hash string, version long"


def _newest(rows: Iterator[pd.DataFrame]) -> tuple[int, bool, str] | None:
    """The row of greatest version; of one version a file before its deletion, then the least hash."""
    newest = None
    for part in rows:
        for version, kind, digest in zip(part["version"], part["kind"], part["hash"]):
            row = (int(version), kind == "file", digest if kind == "file" else "")
            if newest is None or row[:2] > newest[:2] or row[:2] == newest[:2] and row[2] < newest[2]:
                newest = row
    return newest


def _step(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One path's step: the state is its hash (null once it has gone) and its version."""
    parts = list(rows)
    newest = _newest(p[p["kind"] != "forget"] for p in parts)
    before, at = state.get if state.exists else (None, None)
    if newest is not None and (at is None or newest[0] > at):
        version, there, digest = newest
        now = digest if there else None
        state.update((now, version))
        if before != now:
            status = ("added" if before is None else "changed") if there else "removed"
            yield pd.DataFrame({"path": [key[0]], "status": [status], "hash": [now or before], "version": [version]})
        before, at = now, version
    forget = max((int(v) for p in parts for v in p.loc[p["kind"] == "forget", "version"]), default=None)
    if state.exists and before is None and forget is not None and at <= forget:
        state.remove()


def changes_of(files: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """The stream's rows from files ``(path, version, content)`` and ``marks (path, version, kind)`` of deletions.

    Files that a sync leaves out, by extension or directory, are left out; contents are hashed here and don't
    travel to the state.
    """
    rows = sync.synced(files).select("path", F.col("version").cast("long").alias("version"), F.sha2("content", 256).alias("hash"), F.lit("file").alias("kind"))
    if marks is None:
        return rows
    return rows.unionByName(marks.select("path", F.col("version").cast("long").alias("version"), F.lit(None).cast("string").alias("hash"), "kind"))


def track(changes: DataFrame) -> DataFrame:
    """Rows ``(path, status, hash, version)`` of what a stream of ``changes`` adds, changes and removes.

    Rows without a path or version are passed over; of rows of one version a file wins over its deletion, and
    the least hash over others; a null content counts as the empty hash.
    """
    given = changes.where("path is not null and version is not null").select("path", "version", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce("kind", F.lit("file")).alias("kind"))
    return given.groupBy("path").applyInPandasWithState(_step, _OUT, "hash string, version long", "append", GroupStateTimeout.NoTimeout)


def start(changes: DataFrame, changed: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run :func:`track` and hand the rows of each batch with its number to ``changed``.

    A batch that failed is offered again with the same number and rows.
    """
    return track(changes).writeStream.foreachBatch(changed).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a stream: ``(path, hash, version)``, the hash null once a path has gone."""
    return spark.read.format("statestore").option("path", checkpoint).load().select("key.path", "value.groupState.hash", "value.groupState.version")


def known(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The files that the state knows, as a snapshot ``(path, hash)``."""
    return state_of(spark, checkpoint).where("hash is not null").select("path", "hash")


def tombstones(spark: SparkSession, checkpoint: str, listing: DataFrame, version: int) -> DataFrame:
    """Deletions ``(path, version, kind)``: known paths that a complete ``listing (path)`` lacks.

    ``version`` is that of the listing; a file that came after it isn't deleted.
    """
    there = state_of(spark, checkpoint).where((F.col("version") < version) & F.col("hash").isNotNull())
    return there.join(listing.select("path"), "path", "left_anti").select("path", F.lit(version).cast("long").alias("version"), F.lit("deletion").alias("kind"))


def forgettable(spark: SparkSession, checkpoint: str, version: int) -> DataFrame:
    """Marks that drop the deletions up to ``version`` from the state; older files must not come any more."""
    old = state_of(spark, checkpoint).where((F.col("version") <= version) & F.col("hash").isNull())
    return old.select("path", "version", F.lit("forget").alias("kind"))
