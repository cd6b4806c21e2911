"""Ranks within keys, counted by ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.session import materialize


def number(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their rank from 1 within ``by`` in ``order``.

    Rows are dealt out by ranges of both and ranked within a range; the ranks before a range come from the
    counts of the ranges, so that a key that a third of the rows share is no single task.
    """
    part = rows.repartitionByRange(*map(F.col, [*by, *order])).withColumn("__part", F.spark_partition_id())
    held = materialize(part, "ranges")
    # a row for each range and key in it: about as many as there are ranges and keys
    counts = held.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__n")
    starts = counts.select(*[F.col(c).alias(f"__{k}") for k, c in enumerate(by)], F.col("__part").alias("__of"), before.alias("__before"))
    ranked = held.withColumn("__rank", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{k}")) for k, c in enumerate(by)])
    joined = ranked.join(starts, (F.col("__part") == F.col("__of")) & same)
    return joined.select(*rows.columns, (F.col("__before") + F.col("__rank")).alias(name))
