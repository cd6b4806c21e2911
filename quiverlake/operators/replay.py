"""Replay of a log of file operations: the files and directories that it leaves.

The log holds operations that have been carried out, in order of ``seq``: write, append, mkdir, rm and mv.  No
task goes through the log.  Each text is a thing of its own, with a place and a time; the next operation that
moves or removes what lies there is found by a search for the next rule of every directory above the place, for
all texts at once, and prefix after prefix is put in place of the old one until nothing moves the text any more.
So there are as many rounds as the most moves that one text goes through, whatever the length of the log.  Then
the texts of one place are put together from its last write on.

The next rule is a window over rules and questions of one directory, dealt out by ranges of time, so that a
directory that a third of all operations name is no single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.operators import sync
from quiverlake.operators.indexing import file_rows
from quiverlake.session import materialize

#: Ranges of time into which the rules of a directory are dealt.
SLICES = 64
#: Time before every operation.
BEGIN = -(1 << 62)

_RULE = "struct<seq: bigint, gone: int, path: string, target: string>"


def clean(path: Column) -> Column:
    """A path without empty parts and outer slashes."""
    return F.array_join(F.filter(F.split(path, "/"), lambda p: p != ""), "/")


def prefixes(path: Column, whole: bool = True) -> Column:
    """The directories above a path, and, ``whole``, the path itself."""
    parts = F.split(path, "/")
    n = F.size(parts) - (0 if whole else 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).otherwise(F.array().cast("array<string>"))


def rules_of(log: DataFrame) -> DataFrame:
    """What removals and moves do: ``(path, rule)``; a move also removes what its target was."""
    rule = lambda gone, path, target: F.struct(F.col("seq").alias("seq"), F.lit(gone).alias("gone"), path.alias("path"), target.alias("target"))
    path, target, none = F.col("path"), F.col("target"), F.lit(None).cast("string")
    moved = log.where((F.col("op") == "mv") & (path != target) & (target != "")).select(F.explode(F.array(rule(0, path, target), rule(1, target, none))).alias("rule"))
    gone = log.where("op = 'rm'").select(rule(1, path, none).alias("rule"))
    return moved.union(gone).select("rule.path", F.col("rule").cast(_RULE).alias("rule"))


def next_rules(asked: DataFrame, rules: DataFrame, bounds: list[int]) -> DataFrame:
    """The first rule after its time for each ``asked (key, at, time)``, of ``rules (path, rule)``.

    ``at`` is a directory; a key may ask about several, and the first rule of all of them counts.
    """
    slice_of = lambda t: F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= t)) if bounds else F.lit(0)
    asked = asked.join(rules.select(F.col("path").alias("at")).distinct(), "at", "left_semi")
    both = rules.select("path", F.col("rule.seq").alias("time"), F.lit(0).alias("asks"), "rule", F.lit(None).cast(asked.schema["key"].dataType).alias("key")).unionByName(
        asked.select(F.col("at").alias("path"), "time", F.lit(1).alias("asks"), F.lit(None).cast(_RULE).alias("rule"), "key")
    ).withColumn("part", slice_of(F.col("time")))
    # within a range: the latest seen from behind; later ranges: their first rules, a row for each range
    behind = Window.partitionBy("path", "part").orderBy(F.col("time").desc(), F.col("asks").desc(), F.col("rule").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("here", F.last("rule", True).over(behind)).where("asks = 1").select("path", "part", "key", "here")
    later = Window.partitionBy("path").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy("path", "part").agg(F.min("rule").alias("first")).withColumn("later", F.last("first", True).over(later)).select("path", "part", "later")
    found = here.join(firsts, ["path", "part"]).select("key", F.coalesce("here", "later").alias("rule"))
    return found.groupBy("key").agg(F.min("rule").alias("rule")).where("rule is not null")


def follow(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``places (path, time)`` to ``(path, time, final)``: where what was put there then lies at the end.

    Places whose text was removed are left out.
    """
    rules = materialize(rules, "rules")
    known = rules.agg(F.percentile_approx("rule.seq", [k / SLICES for k in range(1, SLICES)], 10 * SLICES).alias("b")).first().b or []
    bounds = sorted(set(known))
    start = F.struct("path", "time")
    now = places.select("path", "time").distinct().select(start.alias("key"), F.col("path").alias("now"), "time")
    settled: list[DataFrame] = []
    while True:
        asked = now.select("key", F.explode(prefixes(F.col("now"))).alias("at"), "time")
        rule = next_rules(asked, rules, bounds)
        moved = F.concat(F.col("rule.target"), F.substring(F.col("now"), F.length("rule.path") + 1, F.length("now")))
        step = materialize(now.join(rule, "key", "left").select("key", F.coalesce(moved, "now").alias("now"), F.col("rule.seq").alias("time"), F.coalesce("rule.gone", F.lit(0)).alias("gone")), "follow")
        settled.append(step.where("time is null").select("key.path", "key.time", F.col("now").alias("final")))
        now = step.where("time is not null and gone = 0").select("key", "now", "time")
        if now.isEmpty():
            return reduce(DataFrame.union, settled)


def replay(log: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The tree after ``log (seq, op, path, target, content)``: rows ``(path, kind, content)``.

    ``files (path, content)`` is the tree before.  A write replaces the text of its place, an append adds to
    it; both, and a move, make the directories above; a file's directories stay when it goes.  Removing or
    moving a place takes everything below with it; a move replaces what its target was.  Null texts count as
    empty, other operations and those without a path are passed over; rows of equal ``seq`` at one place are
    put together in order of their texts.
    """
    log = log.select(F.col("seq").cast("long").alias("seq"), "op", clean(F.col("path")).alias("path"), clean(F.coalesce("target", F.lit(""))).alias("target"), F.coalesce("content", F.lit("")).alias("content"))
    log = log.where("path <> ''")
    texts = log.where("op in ('write', 'append')").select("path", F.col("seq").alias("time"), F.col("op").alias("op"), "content")
    if files is not None:
        texts = texts.union(files.select(clean(F.col("path")).alias("path"), F.lit(BEGIN).cast("long").alias("time"), F.lit("write").alias("op"), F.coalesce("content", F.lit("")).alias("content")))
    made = lambda rows, path, time, whole: rows.select(F.explode(prefixes(F.col(path), whole)).alias("path"), F.col(time).alias("time"))
    folders = made(texts, "path", "time", False).union(made(log.where("op = 'mkdir'"), "path", "seq", True)).union(made(log.where("op = 'mv'"), "target", "seq", False)).distinct()
    places = texts.select("path", "time").union(folders)
    ends = materialize(follow(places, rules_of(log)), "ends")
    kept = folders.join(ends, ["path", "time"]).select(F.col("final").alias("path")).distinct()
    parts = texts.join(ends, ["path", "time"])
    last = parts.where("op = 'write'").groupBy("final").agg(F.max("time").alias("last"))
    shown = parts.join(last, "final", "left").where(F.coalesce(F.col("time") >= F.col("last"), F.lit(True)))
    order = F.transform(F.array_sort(F.collect_list(F.struct("time", "content"))), lambda x: x.content)
    whole = shown.groupBy("final").agg(F.array_join(order, "").alias("content"))
    return whole.select(F.col("final").alias("path"), F.lit("file").alias("kind"), "content").union(kept.select("path", F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("content")))


def changed_contexts(before: DataFrame, after: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """Context rows to write and rows to drop, ``(uri)``, after a replay.

    ``before`` and ``after`` hold files ``(path, content)``; only texts that are new or differ are made into rows.
    """
    uri = F.concat(F.lit(base.rstrip("/") + "/"), F.col("path"))
    status = sync.diff(sync.snapshot(before), sync.snapshot(after)).where("status <> 'same'").select("path", "status")
    fresh = after.join(status.where("status <> 'removed'"), "path").select(F.col("status").alias("source"), uri.alias("uri"), "content")
    return file_rows(fresh), status.where("status = 'removed'").select(uri.alias("uri"))
