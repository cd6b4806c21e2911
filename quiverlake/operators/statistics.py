"""Operational statistics: retrieval counters, cumulative histograms, meters, health, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.session import materialize

#: Upper bounds of latency buckets in milliseconds (fixed value).
BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def _rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def retrieval_stats(log: DataFrame) -> DataFrame:
    """One row over a query log ``(query_type, result_count, scores, latency_ms, used_rerank)``.

    The mean score is by results; the largest score starts at 0.
    """
    out = log.agg(
        F.count("*").alias("queries"), F.coalesce(F.sum("result_count"), F.lit(0)).cast("long").alias("results"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"), F.count_if("used_rerank").alias("reranked"),
        F.sum(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)).alias("score_sum"),
        F.coalesce(F.greatest(F.max(F.array_max("scores")), F.lit(0.0)), F.lit(0.0)).alias("max_score"),
        F.coalesce(F.min(F.array_min("scores")), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.sum("latency_ms"), F.lit(0.0)).alias("latency_sum"), F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency"),
    )
    return out.withColumns({
        "avg_results": _rate(F.col("results"), F.col("queries")), "zero_rate": _rate(F.col("zero_results"), F.col("queries")),
        "avg_score": _rate(F.col("score_sum"), F.col("results")), "avg_latency": _rate(F.col("latency_sum"), F.col("queries")),
    })


def by_type(log: DataFrame) -> DataFrame:
    return log.groupBy("query_type").agg(F.count("*").alias("queries"))


def histogram(values: DataFrame, value: str, keys: list[str], bounds: tuple = BOUNDS) -> DataFrame:
    """Cumulative buckets ``(keys, le, count)``; ``+Inf`` holds all.  Every bound is a row."""
    spot = F.coalesce(*[F.when(F.col(value) <= b, k) for k, b in enumerate(bounds)], F.lit(len(bounds)))
    counts = values.groupBy(*keys, spot.alias("__bucket")).agg(F.count("*").alias("n"))
    grid = counts.select(*keys).distinct().withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(len(bounds)))))
    filled = grid.join(counts, [*keys, "__bucket"], "left")
    run = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*keys).orderBy("__bucket"))
    labels = F.array(*[F.lit(str(b)) for b in bounds], F.lit("+Inf"))
    return filled.select(*keys, F.element_at(labels, F.col("__bucket") + 1).alias("le"), run.alias("count"))


def meter(points: DataFrame) -> DataFrame:
    """Counters add up, gauges keep the last value: ``(metric, attrs, kind, value, ts)``."""
    key = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")
    return points.groupBy("metric", key.alias("attrs"), "kind").agg(F.when(F.first("kind") == "gauge", F.max_by("value", "ts")).otherwise(F.sum("value")).alias("value"), F.count("*").alias("points"))


def prometheus_lines(buckets: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Text exposition of histogram buckets."""
    labels = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), F.col(k).cast("string"), F.lit('"')) for k in keys], F.concat(F.lit('le="'), F.col("le"), F.lit('"')))
    return buckets.select(F.concat(F.lit(f"{name}_bucket{{"), labels, F.lit("} "), F.col("count").cast("string")).alias("line"))


def health(stats: DataFrame, components: DataFrame, worst_zero_rate: float = 0.5, least_queries: int = 5) -> DataFrame:
    """All components healthy, and retrieval finding something often enough once it has been used."""
    bad = (F.col("zero_rate") >= worst_zero_rate) & (F.col("queries") >= least_queries)
    all_up = components.agg(F.every("healthy").alias("up"), F.count_if(~F.col("healthy")).alias("down"))
    return stats.crossJoin(all_up).select((F.coalesce("up", F.lit(True)) & ~bad).alias("healthy"), "down", bad.alias("retrieval_failing"))


def component_health(queues: DataFrame, models: DataFrame, storage: DataFrame) -> DataFrame:
    """Queues without errors, one model that is up, 100 MB of storage left."""
    return (
        queues.agg((F.coalesce(F.sum("errors"), F.lit(0)) == 0).alias("healthy")).select(F.lit("queue").alias("component"), "healthy")
        .union(models.agg(F.coalesce(F.some("up"), F.lit(False)).alias("healthy")).select(F.lit("models"), "healthy"))
        .union(storage.agg(F.coalesce(F.min("free_bytes") >= 100 * 1024 * 1024, F.lit(False)).alias("healthy")).select(F.lit("storage"), "healthy"))
    )


def rollup_counters(points: DataFrame) -> DataFrame:
    """Dotted counters by their first name: ``(operation, counters map<string,double>, total)``."""
    name = F.substring_index("counter", ".", 1)
    rest = F.regexp_replace("counter", r"^[^.]*\.", "")
    sums = points.groupBy(name.alias("operation"), rest.alias("part")).agg(F.sum("value").alias("value"))
    return sums.groupBy("operation").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "value")))).alias("counters"), F.sum("value").alias("total"))


def queue_counters(jobs: DataFrame) -> DataFrame:
    """Jobs ``(queue, status, seq, error)`` by status, with the last hundred errors."""
    rank = F.row_number().over(Window.partitionBy("queue", F.col("status") == "failed").orderBy(F.desc("seq")))
    marked = jobs.withColumn("n", rank)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return marked.groupBy("queue").agg(n("pending"), n("running"), n("done"), n("failed"), F.count_if((F.col("status") == "failed") & (F.col("n") <= 100)).alias("kept_errors"))


def tasks(rows: DataFrame, status: str = "", kind: str = "", limit: int = 50) -> DataFrame:
    """Tracked tasks by optional equalities, newest first."""
    for name, value in (("status", status), ("kind", kind)):
        rows = rows.where(F.col(name) == value) if value else rows
    return rows.orderBy(F.desc("updated_at"), "task_id").limit(limit)


#: Rows of either side of a path that are paired at once.
TILE = 2048


def lock_conflicts(held: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """Which requests ``(request, path, kind)`` clash with live locks ``(handle, path, kind, expires_at)``, each pair once.

    Point locks clash on one path; a subtree lock covers its path and all below.  Two rows meet at one place at
    most, so that pairs repeat only where a request or a handle has several rows; only those are made distinct.
    The rows of a place are dealt out by tiles, for a path may have as many pairs as its requests times its locks.
    """
    live = _places(held.where(F.col("expires_at") > as_of), "handle", climbs=2, covers=1)
    asked = materialize(_places(wanted, "request", climbs=1, covers=2), "places")
    size = lambda rows, name: rows.groupBy("way", "place").agg(F.ceil(F.count("*") / TILE).alias(name))
    grid = materialize(size(asked, "down").join(size(live, "across"), ["way", "place"]), "grid")
    asked, live = _tiles(asked, grid, "down", "across"), _tiles(live, grid, "across", "down")
    pairs = lambda a, b: a.join(b.hint("merge"), ["way", "place", "down", "across"]).select("request", "handle")
    one, several = F.col("alone"), ~F.col("alone")
    again = pairs(asked.where(several), live).union(pairs(asked.where(one), live.where(several)))
    return pairs(asked.where(one), live.where(one)).union(again.distinct())


def _places(rows: DataFrame, name: str, climbs: int, covers: int) -> DataFrame:
    """Where rows meet others: at their path, in the way ``climbs`` at all above it, and as subtrees in the way ``covers``.

    ``alone`` tells rows whose name no other row has.
    """
    rows = rows.select(name, "path", "kind").distinct()
    names = rows.groupBy(F.col(name).alias("of")).agg((F.count("*") == 1).alias("alone"))
    parts = F.split("path", "/")
    above = F.transform(F.slice(F.sequence(F.lit(1), F.size(parts)), F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    spot = lambda way, place: F.struct(F.lit(way).alias("way"), place.alias("place"))
    own = F.array_compact(F.array(spot(0, F.col("path")), F.when(F.col("kind") == "subtree", spot(covers, F.col("path")))))
    spots = F.concat(own, F.transform(above, lambda p: spot(climbs, p)))
    known = rows.join(names, F.col(name).eqNullSafe(F.col("of")))
    return known.select(name, "alone", F.xxhash64(name, "path", "kind").alias("salt"), F.explode(spots).alias("spot")).select(name, "alone", "salt", "spot.*")


def _tiles(rows: DataFrame, grid: DataFrame, own: str, other: str) -> DataFrame:
    """Rows in their own stripe of a place's grid, once for each stripe of the other side."""
    met = rows.join(grid, ["way", "place"])
    stripe = F.pmod("salt", F.col(own)).alias(own)
    return materialize(met.select(*rows.columns, stripe, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other)).drop("salt"), "tiles")
