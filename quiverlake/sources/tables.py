"""Views of the given tables as context rows, vectors, messages and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.functions import uri as U

#: Event types stand for memory categories (fixed value).
KINDS = {"view": "events", "click": "preferences", "error": "cases", "purchase": "entities", "signup": "profile"}

#: The same views in SQL, for the oracles.
DOCS_SQL = """docs AS (SELECT doc_id, text AS content, 'ctx://resources/' || lang || '/' || source AS parent_uri,
 'ctx://resources/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS uri,
 'doc_' || CAST(doc_id AS VARCHAR) AS id FROM documents)"""
MEMORIES_SQL = """memories AS (SELECT 'mem_' || CAST(user_id AS VARCHAR) || '_' || event_type AS id,
 'ctx://user/u' || CAST(user_id AS VARCHAR) || '/memories/' || CASE event_type WHEN 'view' THEN 'events' WHEN 'click' THEN 'preferences'
 WHEN 'error' THEN 'cases' WHEN 'purchase' THEN 'entities' ELSE 'profile' END || '/' || event_type || '.md' AS uri,
 CASE event_type WHEN 'view' THEN 'events' WHEN 'click' THEN 'preferences' WHEN 'error' THEN 'cases' WHEN 'purchase' THEN 'entities' ELSE 'profile' END AS category,
 'u' || CAST(user_id AS VARCHAR) AS owner_space, CASE WHEN user_id % 3 = 0 THEN 'acme' ELSE 'default' END AS account_id,
 count(*) AS active_count, max(ts) AS updated_at, min(ts) AS created_at FROM events GROUP BY user_id, event_type)"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as leaf files: id, uri, parent_uri, content."""
    parent = F.concat_ws("/", F.lit("ctx://resources"), "lang", "source")
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("id"), F.concat(parent, F.lit("/"), "doc_id", F.lit(".md")).alias("uri"), parent.alias("parent_uri"), F.col("text").alias("content"))


def doc_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows of the context table."""
    d = docs(spark, sf_dir)
    return d.select(
        "id", "uri", "parent_uri", F.lit(True).alias("is_leaf"), X.abstract(F.col("content"), 10).alias("abstract"),
        F.lit("resource").alias("context_type"), F.lit("").alias("category"), F.lit(2).alias("level"),
        F.lit("default").alias("account_id"), F.lit("").alias("owner_space"), F.lit(0).cast("long").alias("active_count"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def memory_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory for each user and event type: use count and times from the events."""
    e = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("active_count"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"))
    category = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in KINDS.items()], F.lit("profile"))
    user = F.concat(F.lit("u"), "user_id")
    uri = F.concat(F.lit("ctx://user/"), user, F.lit("/memories/"), category, F.lit("/"), "event_type", F.lit(".md"))
    return e.select(
        F.concat(F.lit("mem_"), "user_id", F.lit("_"), "event_type").alias("id"), uri.alias("uri"), U.parent(uri).alias("parent_uri"), F.lit(True).alias("is_leaf"),
        F.concat_ws(" ", F.lit("seen"), "event_type").alias("abstract"), F.lit("memory").alias("context_type"), category.alias("category"), F.lit(2).alias("level"),
        F.when(F.col("user_id") % 3 == 0, "acme").otherwise("default").alias("account_id"), user.alias("owner_space"), "active_count", "created_at", "updated_at",
    )


def vector_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level tree over the vectors: a directory for each label with the vector of its least id."""
    e = load(spark, sf_dir, "embeddings")
    topic = F.concat(F.lit("ctx://resources/topic_"), "label")
    leaf = e.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(topic, F.lit("/"), "vec_id", F.lit(".md")).alias("uri"), topic.alias("parent_uri"), F.lit(2).alias("level"), F.col("embedding").alias("vector"), F.col("vec_id").alias("ord"))
    top = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    node = top.select(F.concat(F.lit("t"), "label").alias("id"), topic.alias("uri"), F.lit("ctx://resources").alias("parent_uri"), F.lit(0).alias("level"), "vector", (F.lit(1_000_000_000_000) + F.col("label")).alias("ord"))
    return leaf.unionByName(node)


VECTORS_SQL = """vecs AS (SELECT 'v' || CAST(vec_id AS VARCHAR) AS id, 'ctx://resources/topic_' || CAST(label AS VARCHAR) || '/' || CAST(vec_id AS VARCHAR) || '.md' AS uri,
 'ctx://resources/topic_' || CAST(label AS VARCHAR) AS parent_uri, 2 AS level, embedding::DOUBLE[] AS vector, vec_id AS ord FROM embeddings
 UNION ALL SELECT 't' || CAST(label AS VARCHAR), 'ctx://resources/topic_' || CAST(label AS VARCHAR), 'ctx://resources', 0, arg_min(embedding, vec_id)::DOUBLE[], 1000000000000 + label FROM embeddings GROUP BY label)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
