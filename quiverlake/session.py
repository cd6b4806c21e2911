"""Session helpers: the shared work folder and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the cluster.

    Only a local master may go without the setting; it then uses a folder of this machine.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver has it.

    This helps where the folder exists on the workers; elsewhere hand the package over by ``--py-files``.
    """
    env = spark.sparkContext.environment
    home = str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([home, *paths])


#: Folders that this process has written and not deleted yet.
_WRITTEN: set[str] = set()


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which :func:`clear` deletes."""
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    The written table survives lost executors, and its real size steers later joins.  Tables that nothing
    reads any more are deleted by :func:`discard`; a result still reads the last ones, so whoever has written
    the result calls :func:`clear`.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")  # nothing reads the shuffles of this write again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialize` that nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        _WRITTEN.difference_update([w for w in _WRITTEN if folder.endswith(w.split(":", 1)[-1].rstrip("/"))])


def clear(spark: SparkSession) -> int:
    """Delete every working table that this process has written; results that read them must be written by then."""
    folders = sorted(_WRITTEN)
    for folder in folders:
        _delete(spark, folder)
    _WRITTEN.clear()
    return len(folders)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
