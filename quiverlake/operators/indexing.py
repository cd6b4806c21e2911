"""Building context rows: abstracts, overviews and files of directories, embedded by a hook."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.functions import vector as V
from quiverlake.operators.files import LEVEL_FILES
from quiverlake.operators.filters import PathScope
from quiverlake.operators.store import stable_id

#: Characters of a text that are embedded, and of its abstract.
EMBED_CHARS = 2000
ABSTRACT_CHARS = 500
_COLUMNS = ["source", "id", "uri", "parent_uri", "level", "is_leaf", "abstract", "vectorize_text"]


def file_rows(files: DataFrame) -> DataFrame:
    """Level-2 rows of files ``(source, uri, content)``; blank and hidden ones are left out."""
    shown = files.where((X.strip(F.col("content")) != "") & ~F.startswith(U.name(F.col("uri")), F.lit(".")))
    rows = shown.select("source", "uri", U.parent(F.col("uri")).alias("parent_uri"), F.lit(2).alias("level"), F.lit(True).alias("is_leaf"), F.substring("content", 1, ABSTRACT_CHARS).alias("abstract"), F.substring("content", 1, EMBED_CHARS).alias("vectorize_text"))
    return rows.withColumn("id", stable_id(F.col("uri"), F.col("level"))).select(*_COLUMNS)


def directory_rows(directories: DataFrame) -> DataFrame:
    """Rows of directories ``(source, uri, abstract, overview)``: level 0 by the abstract, level 1 by the
    overview; both show the abstract."""
    levels = F.explode(F.array(F.struct(F.lit(0).alias("level"), F.col("abstract").alias("t")), F.struct(F.lit(1).alias("level"), F.col("overview").alias("t"))))
    rows = directories.select("source", "uri", "abstract", levels.alias("x")).where(F.coalesce("x.t", F.lit("")) != "")
    rows = rows.select("source", "uri", U.parent(F.col("uri")).alias("parent_uri"), "x.level", F.lit(False).alias("is_leaf"), "abstract", F.substring("x.t", 1, EMBED_CHARS).alias("vectorize_text"))
    return rows.withColumn("id", stable_id(F.col("uri"), F.col("level"))).select(*_COLUMNS)


def embed(rows: DataFrame, hook: Callable[[Column], Column] = V.hash_embedding) -> DataFrame:
    """Add ``vector`` by an embedding hook, a pandas UDF over whole batches."""
    return rows.withColumn("vector", hook(F.col("vectorize_text")))


def index_tree(files: DataFrame, base: str, user_space: str = "", agent_space: str = "", recursive: bool = True, hook: Callable[[Column], Column] = V.hash_embedding) -> tuple[DataFrame, DataFrame]:
    """Index a directory from the listing ``files (source, uri, content)`` of a tree.

    Returns the context rows with their vectors, and the files that were passed over ``(uri, reason)``.  The
    level files of a directory give its rows of level 0 and 1, every other file that isn't hidden or blank one
    of level 2.  Not ``recursive``: the directory itself and the files in it.
    """
    u, above = F.col("uri"), U.parent(F.col("uri"))
    inside = files.where(PathScope("uri", base, -1 if recursive else 1).column() & (u != base.rstrip("/")))
    name = U.name(u)
    text = lambda level: F.max(F.when(name == LEVEL_FILES[level], F.col("content")))
    level_files = inside.where(name.isin(*LEVEL_FILES.values()))
    directories = level_files.groupBy(above.alias("uri")).agg(F.min("source").alias("source"), F.coalesce(text("l0"), F.lit("")).alias("abstract"), F.coalesce(text("l1"), F.lit("")).alias("overview"))
    rows = file_rows(inside).unionByName(directory_rows(directories))
    kind = U.row_type(u)
    placed = rows.withColumns({
        "context_type": F.when(kind != "", kind).otherwise("resource"), "category": U.category(u),
        "owner_space": U.owner_space(u, F.lit(user_space), F.lit(agent_space)),
    })
    other = inside.where(~name.isin(*LEVEL_FILES.values()))
    hidden = F.startswith(name, F.lit("."))
    passed = other.select("uri", F.when(hidden, "hidden").when(X.strip(F.coalesce("content", F.lit(""))) == "", "blank").alias("reason")).where("reason is not null")
    return embed(placed, hook), passed
