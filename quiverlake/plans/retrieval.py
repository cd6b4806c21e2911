"""Queries of vector search and hierarchical retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.operators import filters as L
from quiverlake.operators import search as R
from quiverlake.plans.functions import AS_OF, as_of
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T

_V = f"WITH {T.VECTORS_SQL}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT query_id, id, ord, uri, parent_uri, level, list_distance(qv, vector) AS distance FROM q, vecs), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS rank FROM r) "


def queries(spark, sf):
    """Every vector whose id is divisible by 100."""
    return T.load(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def contexts(spark, sf):
    """The vector tree as rows of the context table, with activity from the events."""
    v = T.vector_contexts(spark, sf).drop("vector")
    use = T.load(spark, sf, "events").groupBy(F.col("user_id").alias("ord")).agg(F.count("*").alias("active_count"), F.max("ts").alias("updated_at"))
    return v.join(use, "ord", "left").drop("ord").withColumns({"context_type": F.lit("resource"), "account_id": F.lit("default")})


@query(_V + "SELECT query_id, id, round(distance, 9) AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20")
def knn_search(spark, sf):
    return R.knn(queries(spark, sf), T.vector_contexts(spark, sf), 20).select("query_id", "id", F.round("distance", 9).alias("distance"), "rank")


@query(_V + ", d AS (SELECT query_id, id, ord, 1 - list_cosine_similarity(qv, vector) AS distance FROM q, vecs) SELECT query_id, id, round(distance, 7) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS rank FROM d) WHERE rank <= 10 AND distance > 1e-7".replace(", d AS", ", d AS", 1))
def knn_cosine(spark, sf):
    return R.knn(queries(spark, sf), T.vector_contexts(spark, sf), 10, "cosine").where("distance > 1e-7").select("query_id", "id", F.round("distance", 7).alias("distance"))


@query(_V + "SELECT query_id, uri, round(1 - distance, 9) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS place FROM k WHERE rank <= 50 AND starts_with(uri, 'ctx://resources/topic_1/')) WHERE place <= 10")
def search_post_filter(spark, sf):
    """The filter sees the fifty nearest of all vectors alone."""
    where = L.PathScope("uri", "ctx://resources/topic_1", 1)
    return R.search(queries(spark, sf), T.vector_contexts(spark, sf), contexts(spark, sf), 10, where).select("query_id", "uri", F.round("score", 9).alias("score"), "place")


@query(_V + "SELECT query_id, uri, round(1 - distance, 9) AS score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, ord) AS place FROM r WHERE starts_with(uri, 'ctx://resources/topic_1/')) WHERE place <= 10")
def search_pre_filter(spark, sf):
    where = L.PathScope("uri", "ctx://resources/topic_1", 1)
    return R.search(queries(spark, sf), T.vector_contexts(spark, sf), contexts(spark, sf), 10, where, mode="pre").select("query_id", "uri", F.round("score", 9).alias("score"), "place")


#: The walk without early stop over the two-level tree, limit 10, threshold 0: leaves near the query, leaves
#: of opened topics within the ninety... sixty nearest, topics as children of the root.
_WALK = f"""{_V}, top AS (SELECT * FROM k WHERE rank <= 90), firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM top),
 start AS (SELECT query_id, uri, 1 - distance AS s FROM firsts WHERE p <= 30 AND level = 0),
 near AS (SELECT *, row_number() OVER (PARTITION BY query_id, parent_uri ORDER BY rank) AS c FROM top WHERE rank <= 60),
 root_kids AS (SELECT query_id, uri, 1 - distance AS s FROM near WHERE parent_uri = 'ctx://resources' AND c <= 20 AND 1 - distance > 0),
 opened AS (SELECT query_id, uri, max(s) AS s FROM (SELECT * FROM start UNION ALL SELECT * FROM root_kids) GROUP BY ALL),
 kids AS (SELECT n.query_id, n.uri, CASE WHEN o.s > 0 THEN 0.5 * (1 - n.distance) + 0.5 * o.s ELSE 1 - n.distance END AS s FROM near n JOIN opened o ON n.query_id = o.query_id AND n.parent_uri = o.uri WHERE n.c <= 20),
 cand AS (SELECT query_id, uri, max(s) AS semantic FROM (SELECT query_id, uri, 1 - distance AS s FROM firsts WHERE p <= 30 AND level = 2 UNION ALL SELECT * FROM kids WHERE s > 0 UNION ALL SELECT * FROM root_kids) GROUP BY ALL),
 use AS (SELECT user_id AS ord, count(*) AS n, max(ts) AS t FROM events GROUP BY 1),
 hot AS (SELECT c.query_id, c.uri, v.level, c.semantic, least(1.0, 0.3 * ln(1 + coalesce(n, 0)) + coalesce(0.7 / log2(greatest(epoch(TIMESTAMP '{AS_OF}' - t) / 3600.0, 1.0) + 2.0), 0)) AS hotness FROM cand c JOIN vecs v ON v.uri = c.uri LEFT JOIN use ON use.ord = v.ord),
 final AS (SELECT *, 0.8 * semantic + 0.2 * hotness AS score FROM hot)
 SELECT query_id, CASE WHEN level = 0 THEN uri || '/.abstract.md' ELSE uri END AS uri, round(semantic, 9) AS semantic, round(score, 9) AS score, CAST(place AS INTEGER) AS place
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uri) AS place FROM final) WHERE place <= 10"""


@query(_WALK)
def hierarchical_retrieval(spark, sf):
    found = R.retrieve(queries(spark, sf), T.vector_contexts(spark, sf), contexts(spark, sf), as_of(), limit=10, starts=("ctx://resources",), converge=False)
    return found.select("query_id", "uri", F.round("semantic", 9).alias("semantic"), F.round("score", 9).alias("score"), "place")


@query()
def hierarchical_retrieval_converging(spark, sf):
    """The walk with its early stop; tests compare it with a plain model."""
    found = R.retrieve(queries(spark, sf), T.vector_contexts(spark, sf), contexts(spark, sf), as_of(), limit=10, starts=("ctx://resources",))
    return found.select("query_id", "uri", F.round("score", 9).alias("score"), "place")


@query(_V + "SELECT query_id, 'resource' AS kind, count(*) AS n, round(max(1 - distance), 9) AS best FROM k WHERE rank <= 10 GROUP BY 1")
def categorized_results(spark, sf):
    found = R.search(queries(spark, sf), T.vector_contexts(spark, sf), contexts(spark, sf), 10)
    grouped = R.categorize(found)
    return grouped.select("query_id", "kind", F.size("results").cast("long").alias("n"), F.round(F.array_max(F.transform("results", lambda r: r.score)), 9).alias("best"))
