"""Queries of operational statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.operators import statistics as S
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T
from quiverlake.streaming import activity

_LOG = "log AS (SELECT event_id, event_type AS query_type, CAST(floor(value) % 4 AS INTEGER) AS n, value AS latency, user_id % 2 = 0 AS rerank FROM events) "


def _log(spark, sf):
    """Events as a query log: up to three results, scores 1, 1/2, 1/3."""
    n = (F.floor("value") % 4).cast("int")
    scores = F.transform(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda i: i <= n), lambda i: 1.0 / i)
    return T.load(spark, sf, "events").select(F.col("event_type").alias("query_type"), n.alias("result_count"), scores.alias("scores"), F.col("value").alias("latency_ms"), (F.col("user_id") % 2 == 0).alias("used_rerank"))


@query("WITH " + _LOG + """, s AS (SELECT *, CASE n WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.5 ELSE 1.5 + 1.0 / 3 END AS total FROM log)
 SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS results, count(*) FILTER (n = 0) AS zero_results, count(*) FILTER (rerank) AS reranked, max(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS max_score, round(1.0 / 3, 9) AS min_score,
 round(sum(n) / count(*), 9) AS avg_results, round(count(*) FILTER (n = 0) / count(*), 9) AS zero_rate, round(sum(total) / sum(n), 6) AS avg_score, round(sum(latency) / count(*), 6) AS avg_latency, max(latency) AS max_latency FROM s""")
def retrieval_statistics(spark, sf):
    r = lambda c, n=9: F.round(c, n).alias(c)
    return S.retrieval_stats(_log(spark, sf)).select("queries", "results", "zero_results", "reranked", "max_score", r("min_score"), r("avg_results"), r("zero_rate"), r("avg_score", 6), r("avg_latency", 6), "max_latency")


@query("SELECT event_type AS query_type, count(*) AS queries FROM events GROUP BY 1")
def queries_by_type(spark, sf):
    return S.by_type(_log(spark, sf))


@query("""WITH b(le, bound) AS (VALUES ('1', 1), ('5', 5), ('10', 10), ('25', 25), ('50', 50), ('100', 100), ('250', 250), ('500', 500), ('1000', 1000), ('2500', 2500), ('5000', 5000), ('10000', 10000), ('+Inf', 1e300))
 SELECT event_type, le, count(*) FILTER (value <= bound) AS count FROM events, b GROUP BY ALL""")
def latency_histogram(spark, sf):
    return S.histogram(T.load(spark, sf, "events"), "value", ["event_type"])


@query("""SELECT CASE WHEN event_type = 'view' THEN 'gauge' ELSE 'counter' END AS kind, event_type AS metric, 'user=' || CAST(user_id % 3 AS VARCHAR) AS attrs, round(CASE WHEN event_type = 'view' THEN arg_max(value, event_id) ELSE sum(value) END, 4) AS value, count(*) AS points FROM events GROUP BY event_type, user_id % 3""")
def tagged_meters(spark, sf):
    e = T.load(spark, sf, "events")
    points = e.select(F.col("event_type").alias("metric"), F.create_map(F.lit("user"), (F.col("user_id") % 3).cast("string")).alias("attrs"), F.when(F.col("event_type") == "view", "gauge").otherwise("counter").alias("kind"), "value", F.col("event_id").alias("ts"))
    return S.meter(points).withColumn("value", F.round("value", 4))


_DOWN = "(SELECT count(*) FROM (SELECT user_id FROM events GROUP BY user_id HAVING NOT count(*) FILTER (event_type = 'error') * 4 < count(*)))"


@query("WITH " + _LOG + f"SELECT {_DOWN} = 0 AND NOT (count(*) FILTER (n = 0) / count(*) >= 0.5 AND count(*) >= 5) AS healthy, {_DOWN} AS down, count(*) FILTER (n = 0) / count(*) >= 0.5 AND count(*) >= 5 AS retrieval_failing FROM log")
def system_health(spark, sf):
    """Users as components, which are down where a quarter of their events are errors."""
    components = T.load(spark, sf, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") == "error") * 4 < F.count("*")).alias("healthy"))
    return S.health(S.retrieval_stats(_log(spark, sf)), components)


@query("SELECT event_type AS operation, round(sum(value), 4) AS total, count(DISTINCT user_id % 5) AS counters FROM events GROUP BY 1")
def telemetry_rollup(spark, sf):
    e = T.load(spark, sf, "events").select(F.concat("event_type", F.lit(".u"), F.col("user_id") % 5).alias("counter"), "value")
    return S.rollup_counters(e).select("operation", F.round("total", 4).alias("total"), F.size("counters").cast("long").alias("counters"))


@query("""SELECT event_type AS queue, count(*) FILTER (event_id % 4 = 0) AS pending, count(*) FILTER (event_id % 4 = 1) AS running, count(*) FILTER (event_id % 4 = 2) AS done, count(*) FILTER (event_id % 4 = 3) AS failed, least(100, count(*) FILTER (event_id % 4 = 3)) AS kept_errors FROM events GROUP BY 1""")
def queue_counters(spark, sf):
    e = T.load(spark, sf, "events")
    status = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    return S.queue_counters(e.select(F.col("event_type").alias("queue"), status.alias("status"), F.col("event_id").alias("seq")))


@query("SELECT CAST(event_id AS VARCHAR) AS task_id, event_type AS kind FROM events WHERE event_type = 'error' ORDER BY ts DESC, task_id LIMIT 50")
def task_list(spark, sf):
    e = T.load(spark, sf, "events").select(F.col("event_id").cast("string").alias("task_id"), F.col("event_type").alias("kind"), F.lit("done").alias("status"), F.col("ts").alias("updated_at"))
    return S.tasks(e, status="done", kind="error").select("task_id", "kind")


@query("""SELECT 'r' || CAST(c.c_custkey AS VARCHAR) AS request, 'h' || CAST(s.s_suppkey AS VARCHAR) AS handle FROM customer c JOIN supplier s ON c.c_nationkey = s.s_nationkey""")
def lock_conflicts(spark, sf):
    """Which subtree scopes cover which paths: suppliers span their nation, customers lie below it."""
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    held = T.load(spark, sf, "supplier").select(F.concat(F.lit("h"), "s_suppkey").alias("handle"), F.concat(F.lit("n/"), "s_nationkey").alias("path"), F.lit("subtree").alias("kind"), F.lit("2024-02-01").cast("timestamp_ntz").alias("expires_at"))
    wanted = T.load(spark, sf, "customer").select(F.concat(F.lit("r"), "c_custkey").alias("request"), F.concat(F.lit("n/"), "c_nationkey", F.lit("/c"), "c_custkey").alias("path"), F.lit("point").alias("kind"))
    return S.lock_conflicts(held, wanted, at)


@query("""SELECT event_type, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_activity(spark, sf):
    """Event-time windows, an extension for streams; here over the whole table."""
    w = activity.windowed(T.load(spark, sf, "events"), "1 hour")
    return w.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))
