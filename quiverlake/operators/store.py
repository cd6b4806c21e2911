"""The context table: reads, sorted pages, counts, and snapshot forms of upsert, delete and rename."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import uri as U
from quiverlake.operators.filters import FIELDS, PathScope
from quiverlake.operators.ranks import number


def get(contexts: DataFrame, ids: list[str]) -> DataFrame:
    return contexts.where(F.col("id").isin(*ids)) if ids else contexts.limit(0)


def get_by_uri(contexts: DataFrame, uri: str) -> DataFrame:
    """One row: several levels share a URI, the lowest level wins."""
    return contexts.where(F.col("uri") == uri).orderBy("level", "id").limit(1)


def query(contexts: DataFrame, where=None, order_by: str = "", descending: bool = False, limit: int = 0, offset: int = 0) -> DataFrame:
    """Filtered, sorted page; ties are broken by id."""
    out = contexts.where(where.column()) if where else contexts
    if order_by:
        if order_by not in FIELDS:
            raise ValueError(f"unknown field {order_by!r}")
        key = F.col(order_by)
        out = out.orderBy(key.desc() if descending else key.asc(), "id")
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def newest(contexts: DataFrame, limit: int) -> DataFrame:
    return contexts.orderBy(F.desc("updated_at"), "uri", "id").limit(limit)


def scroll(contexts: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Slim page, newest first, with the next offset while pages are full."""
    limit = min(limit, 1000)
    page = contexts.select("id", "uri", "context_type", "level", "abstract", "updated_at").orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit)
    full = F.count("*").over(Window.partitionBy()) == limit
    return page.withColumn("next_offset", F.when(full, F.lit(offset + limit)).cast("long"))


def count(contexts: DataFrame, where=None) -> DataFrame:
    return contexts.agg(F.count_if(where.column() if where else F.lit(True)).alias("n"))


def category_counts(contexts: DataFrame) -> DataFrame:
    """Memories by category; unknown categories count in the total alone."""
    memories = contexts.where(F.col("context_type") == "memory")
    by = memories.where(F.col("category").isin(*U.CATEGORIES)).groupBy("category").agg(F.count("*").alias("n"))
    return by.union(memories.agg(F.lit("total").alias("category"), F.count("*").alias("n")))


def store_stats(contexts: DataFrame, vectors: DataFrame) -> DataFrame:
    v = vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"))
    return contexts.agg(F.count("*").alias("contexts")).crossJoin(v).withColumn("has_vectors", F.col("vectors") > 0)


def upsert(contexts: DataFrame, changes: DataFrame, order: str = "seq") -> DataFrame:
    """Last writer wins by id; ``created_at`` keeps its first value.

    Of changes with one id and one ``order`` the row of the greatest hash wins, so that the result doesn't
    depend on how rows are dealt out.
    """
    base = contexts.withColumn(order, F.lit(-1).cast("long"))
    both = base.unionByName(changes.withColumn(order, F.col(order).cast("long")))
    cols = [c for c in contexts.columns if c not in ("id", "created_at")]
    place = F.struct(F.col(order), F.xxhash64("created_at", *cols))
    last = F.max_by(F.struct(*cols), place).alias("r")
    merged = both.groupBy("id").agg(last, F.min_by("created_at", place).alias("created_at"))
    return merged.select("id", "created_at", "r.*").select(*contexts.columns)


def delete(contexts: DataFrame, ids: DataFrame) -> DataFrame:
    return contexts.join(ids.select("id"), "id", "left_anti")


def delete_where(contexts: DataFrame, vectors: DataFrame, where) -> tuple[DataFrame, DataFrame]:
    """Rows that match go, and their vectors with them."""
    gone = F.coalesce(where.column(), F.lit(False))
    return contexts.where(~gone), vectors.join(contexts.where(gone).select("id"), "id", "left_anti")


def delete_subtree(contexts: DataFrame, base: str) -> DataFrame:
    return contexts.where(~PathScope("uri", base).column())


def rename_subtree(contexts: DataFrame, old: str, new: str) -> DataFrame:
    """Move all rows of a subtree; parents follow."""
    inside = PathScope("uri", old).column()
    moved = F.concat(F.lit(new), F.substring("uri", len(old) + 1, 1 << 30))
    uri = F.when(inside, moved).otherwise(F.col("uri"))
    return contexts.withColumn("parent_uri", F.when(inside, U.parent(moved)).otherwise(F.col("parent_uri"))).withColumn("uri", uri)


def complete(rows: DataFrame) -> DataFrame:
    """Fill in type, category and parent of new rows where they are unset."""
    blank = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    kind = U.row_type(F.col("uri"))
    return rows.withColumns({
        "context_type": F.coalesce(blank("context_type"), F.when(kind != "", kind), F.lit("resource")),
        "category": F.coalesce(blank("category"), U.category(F.col("uri"))),
        "parent_uri": F.coalesce(blank("parent_uri"), U.parent(F.col("uri"))),
    })


def stable_id(uri, level) -> F.Column:
    """Row id from URI and level, so that indexing again replaces rows."""
    return F.sha2(F.concat_ws("|", uri, F.coalesce(level, F.lit(2)).cast("string")), 256)


# -- the tree ---------------------------------------------------------------------------------------


def list_children(contexts: DataFrame, uri: str) -> DataFrame:
    return contexts.where(PathScope("uri", uri, 1).column()).select("uri", U.name(F.col("uri")).alias("name"), "is_leaf").orderBy("name")


def directories(contexts: DataFrame) -> DataFrame:
    """Every ancestor directory of the rows, once; parents are made distinct before their own are listed."""
    p = U.parts(F.col("uri"))
    parents = contexts.where(F.size(p) > 1).select(F.slice(p, F.lit(1), F.size(p) - 1).alias("p")).distinct()
    paths = F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.concat(F.lit(f"{U.SCHEME}://"), F.array_join(F.slice("p", F.lit(1), n), "/")))
    return parents.select(F.explode(paths).alias("uri")).distinct()


def tree(contexts: DataFrame, base: str, level_limit: int, node_limit: int = 0) -> DataFrame:
    """Walk in preorder: segments are compared one by one; hidden files are left out."""
    d = F.size(U.parts(F.col("uri"))) - len([x for x in base.split("://")[-1].split("/") if x])
    entries = directories(contexts).withColumn("is_dir", F.lit(True)).unionByName(contexts.select("uri").withColumn("is_dir", F.lit(False)))
    below = entries.where(PathScope("uri", base).column() & (F.col("uri") != base)).withColumn("depth", (d - 1).cast("int"))
    shown = below.where((F.col("depth") < level_limit) & (F.col("is_dir") | ~F.startswith(U.name(F.col("uri")), F.lit("."))))
    out = shown.orderBy(U.parts(F.col("uri")), F.desc("is_dir"))
    return out.limit(node_limit) if node_limit else out


def disk_usage(contexts: DataFrame, size: str = "size") -> DataFrame:
    """Bytes and files of every directory, its subdirectories included."""
    p = U.parts(F.col("uri"))
    paths = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda n: F.concat(F.lit(f"{U.SCHEME}://"), F.array_join(F.slice(p, F.lit(1), n), "/")))
    return contexts.where(F.size(p) > 1).select(F.explode(paths).alias("uri"), size).groupBy("uri").agg(F.sum(size).cast("long").alias("bytes"), F.count("*").alias("files"))


def grep(files: DataFrame, needle: str, ignore_case: bool = False, limit: int = 0) -> DataFrame:
    """Lines that hold a fixed string, numbered from 1."""
    hit = F.lower("line_text").contains(needle.lower()) if ignore_case else F.col("line_text").contains(needle)
    # the filter on whole texts runs before lines are made
    whole = F.lower("content").contains(needle.lower()) if ignore_case else F.col("content").contains(needle)
    lines = files.where(whole).select("uri", F.posexplode(F.split("content", "\n")).alias("pos", "line_text"))
    out = lines.where(hit).select((F.col("pos") + 1).cast("long").alias("line"), "uri", F.col("line_text").alias("content"))
    return out.orderBy("uri", "line").limit(limit) if limit else out


def glob_pattern(pattern: str) -> str:
    """A path pattern as a regular expression; ``*`` and ``?`` do not cross ``/``.

    ``[a-z]`` is one sign of a class and ``[^a-z]`` one outside it, a backslash takes the next sign literally,
    also in a class.  A class that is open, empty or backwards and a backslash at the end are errors.
    """
    literal = lambda c: c if c.isalnum() or c in "_/" else "\\" + c
    bad = ValueError(f"bad pattern {pattern!r}")
    out, signs = "", iter(pattern)

    def taken(c: str | None) -> str:
        c = next(signs, None) if c == "\\" else c
        if c is None:
            raise bad
        return c

    for c in signs:
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c != "[":
            out += literal(taken(c))
        else:
            c, ranges, outside = next(signs, None), "", ""
            if c == "^":
                c, outside = next(signs, None), "^/"
            while c != "]" or not ranges:
                if c in ("]", "-", None):
                    raise bad
                low, c = taken(c), next(signs, None)
                high = low
                if c == "-":
                    high, c = taken(next(signs, None)), next(signs, None)
                if high < low:
                    raise bad
                ranges += f"{literal(low)}-{literal(high)}"
            out += f"[{outside}{ranges}]"
    return f"^{out}$"


def glob(contexts: DataFrame, pattern: str, base: str) -> DataFrame:
    """Rows below ``base`` whose name or relative path fits the pattern."""
    expr = glob_pattern(pattern)
    rel = F.substring("uri", len(base) + 2, 1 << 30)
    return contexts.where(PathScope("uri", base).column() & (U.name(F.col("uri")).rlike(expr) | rel.rlike(expr))).select("uri")


def relations(edges: DataFrame, uri: str | None = None) -> DataFrame:
    """Relation table ``(src, link_id, uris, reason)`` as one row for each link and target."""
    out = edges.select("src", "link_id", F.explode("uris").alias("dst"), "reason")
    return out.where(F.col("src") == uri) if uri else out


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Add links ``(src, uris, reason, seq)``; each gets the first free ``link_n`` of its source.

    The j-th taken number n has n - j free ones before it, so sorted by that, between the new links by their
    rank, a new link stands at the place that is its number.  Places are counted by ranges, whatever a source holds.
    """
    held = edges.select("src", F.regexp_extract("link_id", r"^link_(\d+)$", 1).alias("n")).where("n <> ''").select("src", F.col("n").cast("long").alias("n")).where("n > 0").distinct()
    taken = number(held, ["src"], ["n"], "j").select("src", (F.col("n") - F.col("j")).alias("key"), F.lit(1).alias("kind"), F.col("n").alias("tie"), F.lit(None).cast(new.schema["uris"].dataType).alias("uris"), F.lit(None).cast("string").alias("reason"))
    asked = number(new, ["src"], ["seq"], "k").select("src", F.col("k").alias("key"), F.lit(0).alias("kind"), F.col("k").alias("tie"), "uris", "reason")
    placed = number(taken.unionByName(asked), ["src"], ["key", "kind", "tie"], "place").where("kind = 0")
    return edges.unionByName(placed.select("src", F.concat(F.lit("link_"), "place").alias("link_id"), "uris", "reason"))


def unlink(edges: DataFrame, src: str, target: str) -> DataFrame:
    """Remove the first occurrence of a target in each entry of a source; empty entries go."""
    at = F.array_position("uris", target)
    cut = F.concat(F.slice("uris", F.lit(1), F.greatest((at - 1).cast("int"), F.lit(0))), F.slice("uris", (at + 1).cast("int"), F.size("uris")))
    mine = (F.col("src") == src) & (at > 0)
    return edges.withColumn("uris", F.when(mine, cut).otherwise(F.col("uris"))).where(F.size("uris") > 0)
