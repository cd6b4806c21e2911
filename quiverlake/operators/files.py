"""File-level reads over context rows: levels of directories, existence, roots, sizes, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.operators.filters import PathScope

#: Names of the level files (fixed values).
LEVEL_FILES = {"l0": ".abstract.md", "l1": ".overview.md"}
#: Bounds of size classes in bytes: in memory, in one process (fixed values).
SIZE_BOUNDS = (10 << 20, 10 << 30)
#: Archives that are unfolded (fixed values).
ARCHIVES = (".zip", ".tar", ".gz", ".tgz")


def read_batch(files: DataFrame, uris: DataFrame, level: str = "l2") -> DataFrame:
    """Contents at URIs; ``l0`` and ``l1`` read the level file of a directory.  Misses are left out."""
    path = F.concat("uri", F.lit("/" + LEVEL_FILES[level])) if level in LEVEL_FILES else F.col("uri")
    return uris.select("uri", path.alias("path")).join(files.select(F.col("uri").alias("path"), "content"), "path").select("uri", "content")


def stat(files: DataFrame) -> DataFrame:
    return files.select("uri", U.name(F.col("uri")).alias("name"), F.octet_length("content").cast("long").alias("size"), F.lit(False).alias("is_dir"))


def exists(files: DataFrame, uris: DataFrame) -> DataFrame:
    """Whether each URI is a file or a directory of some file."""
    p = U.parts(F.col("uri"))
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.concat(F.lit(f"{U.SCHEME}://"), F.array_join(F.slice(p, F.lit(1), n), "/")))).alias("uri")).distinct()
    return uris.select("uri").join(every.withColumn("found", F.lit(True)), "uri", "left").select("uri", F.coalesce("found", F.lit(False)).alias("exists"))


def collect(files: DataFrame, base: str, recursive: bool = True) -> DataFrame:
    """URIs below a directory, of all depths or of the first."""
    scope = PathScope("uri", base, -1 if recursive else 1).column()
    return files.where(scope & (F.col("uri") != base)).select("uri")


def scope_roots(files: DataFrame) -> DataFrame:
    """First segments in use, with the number of rows below."""
    return files.groupBy(U.scope(F.col("uri")).alias("scope")).agg(F.count("*").alias("rows"))


def since(rows: DataFrame, column: str, at: Column) -> DataFrame:
    """Rows of a text time at or after ``at``; times that can't be read stay."""
    return rows.where(F.coalesce(F.try_to_timestamp(F.col(column)) >= at, F.lit(True)))


def extension_summary(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    return files.groupBy(U.extension(F.col(path)).alias("ext")).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("bytes"))


def size_class(size: Column) -> Column:
    return F.when(size <= SIZE_BOUNDS[0], "in_memory").when(size <= SIZE_BOUNDS[1], "external").otherwise("too_large")


def detect(resources: DataFrame) -> DataFrame:
    """How a resource ``(path, size)`` is visited, how large it is and whether it unfolds."""
    kind = U.source_kind(F.col("path"))
    web = kind != "local"
    ext = U.extension(F.col("path"))
    visit = F.when(web, "download").when(ext == ".pack", "pack").when(F.col("size").isNull(), "direct").otherwise("file")
    size = F.when(web, "external").when(F.col("size").isNull(), "in_memory").otherwise(size_class(F.col("size")))
    unfold = F.when(kind == "git", "recursive").when(web, "single").when(ext.isin(*ARCHIVES, ".pack"), "expand").otherwise("single")
    return resources.select("path", visit.alias("visit"), size.alias("size_class"), unfold.alias("recursion"))


def relations_from_json(files: DataFrame) -> DataFrame:
    """Relation files ``(src, content)``: a list of entries, or lists by user; malformed ones are empty."""
    entry = "struct<id:string,uris:array<string>,reason:string>"
    flat = F.from_json("content", f"array<{entry}>")
    nested = F.flatten(F.map_values(F.from_json("content", f"map<string,array<{entry}>>")))
    listed = F.when(F.startswith(F.ltrim("content"), F.lit("[")), flat).otherwise(nested)
    return files.select("src", F.explode(listed).alias("e")).select("src", F.col("e.id").alias("link_id"), "e.uris", "e.reason").where("uris is not null")


def format_results(results: DataFrame) -> DataFrame:
    """One text for each query: numbered results with type, URI, score and abstract."""
    line = F.format_string("%d. [%s] %s (%.4f)\n   %s", F.col("place").cast("int"), "context_type", "uri", "score", X.truncate(F.coalesce("abstract", F.lit("")), 300))
    rows = F.array_sort(F.collect_list(F.struct("place", line.alias("line"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r.line), "\n").alias("text"))
