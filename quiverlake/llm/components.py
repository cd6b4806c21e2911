"""Connected components of an edge table by alternating large and small stars.

Each round points nodes at the smallest neighbour they know; hot nodes need no gathering, since only
minima are grouped and joins may be split.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.session import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b")


#: Parts into which the rows of a component are dealt where their names are joined.
SALT = 16


def with_smallest(rows: DataFrame, group: str, value: str, by: str) -> DataFrame:
    """``rows`` with ``smallest``, the least non-null ``value`` of the row's ``group``.

    A giant group is dealt out: its rows go to ``SALT`` parts by the hash of ``by``, and the group's one value
    goes to each of them.
    """
    part = F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")
    least = rows.groupBy(group).agg(F.min(value).alias("smallest")).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("__part", part).join(least, [group, "__part"]).drop("__part")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges (a long, b long)`` to ``(node long, component long)``: the least node that links reach.

    Self links and repeated links may occur.  Nodes without an edge are not returned.
    """
    now = materialize(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).select("a", "b").distinct(), "edges")
    mark = None
    while True:
        nxt = materialize(_small_star(_large_star(now).distinct()).distinct(), "edges")
        discard(now)
        now = nxt
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
