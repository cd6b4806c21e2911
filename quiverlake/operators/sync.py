"""Incremental sync and trees: hash snapshots, diffs, bottom-up rollups, ancestors, unique names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import uri as U
from quiverlake.operators.ranks import number
from quiverlake.operators.store import directories, glob_pattern
from quiverlake.session import materialize


def snapshot(files: DataFrame) -> DataFrame:
    """``(path, content)`` to ``(path, hash)``; a path that occurs twice keeps its least hash."""
    return files.groupBy("path").agg(F.min(F.sha2("content", 256)).alias("hash"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, status, hash)`` of two snapshots: added, removed, changed or same."""
    b, a = before.withColumnRenamed("hash", "old"), after.withColumnRenamed("hash", "new")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return b.join(a, "path", "full_outer").select("path", status.alias("status"), F.coalesce("new", "old").alias("hash"))


def tree_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(kind, status, uri)`` from two listings ``(uri, content)``.

    Size and bytes decide whether a file changed.  A new or deleted directory is reported once; neither its
    files nor its subdirectories are.  Where a file and a directory share a name, the new kind wins.
    """
    d_old, d_new = directories(old), directories(new)
    gone = d_old.join(d_new, "uri", "left_anti").withColumn("status", F.lit("deleted"))
    made = d_new.join(d_old, "uri", "left_anti").withColumn("status", F.lit("added"))
    dirs = gone.union(made)
    parent = lambda df: df.withColumn("up", U.parent(F.col("uri")))
    outside = lambda df: parent(df).join(dirs.select(F.col("uri").alias("up"), "status"), ["up", "status"], "left_anti")
    top = outside(dirs).select(F.lit("directory").alias("kind"), "status", "uri")
    # what lies in a directory that came or went isn't hashed
    old = parent(old).join(gone.select(F.col("uri").alias("up")), "up", "left_anti")
    new = parent(new).join(made.select(F.col("uri").alias("up")), "up", "left_anti")
    a = old.select("uri", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("hash"))
    b = new.select("uri", F.octet_length("content").alias("size2"), F.sha2("content", 256).alias("hash2"))
    status = F.when(F.col("size").isNull(), "added").when(F.col("size2").isNull(), "deleted").when((F.col("size") != F.col("size2")) | (F.col("hash") != F.col("hash2")), "updated")
    files = a.join(b, "uri", "full_outer").withColumn("status", status).where("status is not null").select("uri", "status")
    return top.union(files.select(F.lit("file").alias("kind"), "status", "uri"))


#: Children that are summarised at once.
FAN = 4096


def rollup(nodes: DataFrame, summarise: Callable[[Column, Column], Column], fan: int = FAN, merge: Callable[[Column], Column] | None = None) -> DataFrame:
    """Fill in ``text`` bottom up: ``(node, parent, depth, text)``, leaves have a text.

    One pass for each depth; a directory is summarised once all its children are.  ``summarise`` gets the
    sorted names and the texts of the children.  No row holds more than ``fan`` children: those of a larger
    directory are summarised by ``fan`` in their order, and ``merge`` makes one text of the summaries in that
    order.  Without it they are summarised again, named by their first child, which suits summaries of texts
    but not of names.
    """
    summary = summarise(F.col("kids.node"), F.col("kids.text"))
    if merge:
        summary = F.when(F.col("kids")[0]["part"].isNotNull(), merge(F.col("kids.text"))).otherwise(summary)
    deepest = nodes.agg(F.max("depth")).first()[0]
    done = nodes.where(F.col("depth") == deepest).withColumn("leaves", F.lit(1).cast("long"))
    level = done
    for depth in range((deepest or 0) - 1, -1, -1):
        kids = _fanned(level.select("parent", "node", "text", "leaves"), summary, fan)
        here = nodes.where(F.col("depth") == depth).join(kids.withColumnRenamed("parent", "of"), F.col("node") == F.col("of"), "left")
        text = F.when(F.col("kids").isNotNull(), summary).otherwise(F.col("text"))
        level = materialize(here.select("node", "parent", "depth", text.alias("text"), F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves")), "rollup")
        done = done.union(level)
    return done


def _fanned(kids: DataFrame, summary: Column, fan: int) -> DataFrame:
    """Children of each parent as one sorted array of at most ``fan``; ``part`` numbers summaries of several."""
    kids = kids.withColumn("part", F.lit(None).cast("long"))
    gathered = [F.array_sort(F.collect_list(F.struct("part", "node", "text"))).alias("kids"), F.sum("leaves").alias("leaves")]
    while True:
        many = kids.groupBy("parent").count().where(F.col("count") > fan).select("parent")
        if many.isEmpty():
            return kids.groupBy("parent").agg(*gathered)
        large = number(kids.join(many, "parent", "left_semi"), ["parent"], ["part", "node"], "rank")
        parts = large.groupBy("parent", F.floor((F.col("rank") - 1) / fan).alias("part")).agg(*gathered)
        less = parts.select("parent", F.col("kids")[0]["node"].alias("node"), summary.alias("text"), "leaves", "part")
        kids = materialize(kids.join(many, "parent", "left_anti").unionByName(less), "fanned")


def ancestors(tree: DataFrame, most: int = 32) -> DataFrame:
    """``(node, ancestor, distance)`` of a tree ``(node, parent)``; the depth cap guards against cycles.

    Each step up is written, so that it is computed once; there are as many as the tree is deep.
    """
    tree = materialize(tree.select("node", "parent"), "tree")
    step = tree.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    out, now = step, step
    for d in range(2, most + 1):
        up = now.join(tree.select(F.col("node").alias("ancestor"), "parent"), "ancestor")
        now = materialize(up.select("node", F.col("parent").alias("ancestor"), F.lit(d).alias("distance")), "ancestors")
        if now.isEmpty():
            break
        out = out.union(now)
    return out


def unique_names(rows: DataFrame, base: str, order: str) -> DataFrame:
    """The first row keeps its name, later ones get ``_1``, ``_2`` and so on."""
    n = F.col("__number")
    name = F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), n - 1))
    return number(rows, [base], [order], "__number").select(*rows.columns, name.alias("name"))


#: Places of a scope, and sites whose addresses name an organisation and a repository (fixed values).
SCOPES = ("resources", "user", "agent")
CODE_HOSTS = ("https://github.com/", "https://gitlab.com/", "https://bitbucket.org/")
#: Suffixes that are tried; one more name is taken whatever lies there (fixed value).
MOST_SUFFIXES = 100


def repository(url: Column) -> Column:
    """``organisation/repository`` of the address of a code host, else null."""
    hosts = "|".join(h.replace(".", "\\.") for h in CODE_HOSTS)
    rest = F.regexp_replace(F.regexp_replace(url, f"^(?:{hosts})", ""), r"\.git$", "")
    parts = F.split(rest, "/")
    return F.when(F.regexp_like(url, F.lit(f"^(?:{hosts})")) & (F.size(parts) > 1), F.concat(parts[0], F.lit("/"), F.try_element_at(parts, F.lit(2))))


def import_targets(imports: DataFrame, existing: DataFrame) -> DataFrame:
    """Where imported trees go: ``(seq, uri)`` for ``imports (seq, scope, name, url)``, none on another.

    A tree lies below its scope, under its repository or its name as one segment.  The first of a name that
    ``existing (uri)`` lacks, then ``_1`` to ``_100`` are taken in order of ``seq``; later ones all go to ``_101``.
    Free numbers are counted by ranges, as for links.
    """
    scope = F.when(F.col("scope").isin(*SCOPES), F.col("scope")).otherwise("resources")
    place = F.concat(F.lit(f"{U.SCHEME}://"), scope, F.lit("/"), F.coalesce(repository(F.col("url")), U.sanitize_segment(F.coalesce("name", F.lit("")))))
    asked = materialize(imports.select("seq", place.alias("base")), "imports")
    suffix = F.regexp_extract("uri", r"_([1-9]\d{0,2})$", 1)
    spots = existing.select(F.explode(F.array(F.struct(F.col("uri").alias("base"), F.lit(1).alias("m")), F.struct(F.regexp_replace("uri", r"_[1-9]\d{0,2}$", "").alias("base"), (F.try_to_number(suffix, F.lit("999")) + 1).cast("int").alias("m")))).alias("x")).select("x.*")
    spots = spots.where(F.col("m").isNotNull() & (F.col("m") <= MOST_SUFFIXES + 1)).join(asked.select("base").distinct(), "base", "left_semi").distinct()
    taken = number(spots, ["base"], ["m"], "j").select("base", (F.col("m") - F.col("j")).cast("long").alias("key"), F.lit(1).alias("kind"), F.col("m").cast("long").alias("tie"), F.lit(None).cast(asked.schema["seq"].dataType).alias("seq"))
    new = number(asked, ["base"], ["seq"], "k").select("base", F.col("k").cast("long").alias("key"), F.lit(0).alias("kind"), F.col("k").cast("long").alias("tie"), "seq")
    placed = number(taken.unionByName(new), ["base"], ["key", "kind", "tie"], "m").where("kind = 0")
    n = F.least(F.col("m") - 1, F.lit(MOST_SUFFIXES + 1))
    return placed.select("seq", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("_"), n.cast("string"))).alias("uri"))


def classify(entries: DataFrame, rules: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """Status of directory entries: the first rule that holds."""
    return entries.withColumn("status", F.coalesce(*[F.when(c, s) for c, s in rules], F.lit(otherwise)))


#: Extensions that a folder sync takes, and directories that it leaves out (fixed values).
SYNC_EXTENSIONS = (".md", ".txt", ".json", ".yaml", ".yml", ".html", ".xml", ".csv", ".rst", ".org", ".py", ".go", ".js", ".ts", ".sh")
SYNC_SKIPPED = (".git", ".obsidian", "node_modules", ".trash")


def synced(files: DataFrame, path: str = "path") -> DataFrame:
    """The files of a listing that a folder sync takes: by extension, outside the left-out directories."""
    above = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return files.where(U.extension(F.col(path)).isin(*SYNC_EXTENSIONS) & ~F.arrays_overlap(above, F.lit(list(SYNC_SKIPPED))))


def sync_plan(known: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """What a folder sync writes and removes: ``(path, target, status)``, status added, changed or removed.

    ``known (path, hash)`` is the snapshot of the last run, ``files (path, content)`` the whole folder now.
    """
    moved = diff(known, snapshot(synced(files))).where("status <> 'same'")
    return moved.select("path", F.concat(F.lit(target.rstrip("/") + "/"), "path").alias("target"), "status")


#: Names of directories that scans leave out (fixed values).
IGNORED_DIRS = (
    "node_modules", ".git", ".svn", ".hg", "__pycache__", ".tox", ".pytest_cache", ".mypy_cache", ".ruff_cache",
    "venv", ".venv", "env", ".env", "dist", "build", ".next", ".nuxt", "target", "vendor",
)


def scan_files(files: DataFrame, processable: list[str], include: str = "", exclude: str = "") -> DataFrame:
    """Classify ``(path, length)`` of a listing: ignored, skipped, excluded, not included, processable, unsupported."""
    parts, name = F.split("path", "/"), F.substring_index("path", "/", -1)
    ext = U.extension(F.col("path"))
    rules = [
        (F.arrays_overlap(parts, F.lit(list(IGNORED_DIRS))), "ignored_dir"),
        (F.startswith(name, F.lit(".")) | (F.col("length") == 0), "skipped"),
        (name.rlike(glob_pattern(exclude)) if exclude else F.lit(False), "excluded"),
        (~name.rlike(glob_pattern(include)) if include else F.lit(False), "not_included"),
        (ext.isin(*processable), "processable"),
    ]
    return classify(files, rules, "unsupported")
