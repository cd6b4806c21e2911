"""Queries of file-level reads and of result formatting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.operators import files as N
from quiverlake.operators import memory as M
from quiverlake.operators import search as R
from quiverlake.plans.functions import tokens_sql
from quiverlake.operators import sync as Y
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T

_D = f"WITH {T.DOCS_SQL} "


@query(_D + "SELECT DISTINCT parent_uri AS uri, 'about ' || parent_uri AS content FROM docs WHERE starts_with(parent_uri, 'ctx://resources/en/')")
def read_level_files(spark, sf):
    """Every directory has an abstract file; those of one language are read."""
    dirs = T.docs(spark, sf).select("parent_uri").distinct()
    files = dirs.select(F.concat("parent_uri", F.lit("/.abstract.md")).alias("uri"), F.concat(F.lit("about "), "parent_uri").alias("content"))
    wanted = dirs.where(F.startswith("parent_uri", F.lit("ctx://resources/en/"))).select(F.col("parent_uri").alias("uri")).unionByName(spark.createDataFrame([("ctx://gone",)], "uri string"))
    return N.read_batch(files, wanted, "l0")


@query(_D + "SELECT uri, regexp_extract(uri, '[^/]*$') AS name, strlen(content) AS size, false AS is_dir FROM docs")
def file_stat(spark, sf):
    return N.stat(T.docs(spark, sf))


@query(_D + "SELECT 'ctx://resources/' || x AS uri, x IN (SELECT DISTINCT regexp_extract(uri, 'resources/([a-z]+)', 1) FROM docs) AS exists FROM (VALUES ('en'), ('fr'), ('xx')) t(x)")
def file_exists(spark, sf):
    asked = spark.createDataFrame([(f"ctx://resources/{x}",) for x in ("en", "fr", "xx")], "uri string")
    return N.exists(T.docs(spark, sf), asked)


@query(_D + "SELECT uri FROM docs WHERE starts_with(uri, 'ctx://resources/es/')")
def collect_uris(spark, sf):
    return N.collect(T.docs(spark, sf), "ctx://resources/es")


@query(f"WITH {T.MEMORIES_SQL} SELECT 'user' AS scope, count(*) AS rows FROM memories")
def scope_roots(spark, sf):
    return N.scope_roots(T.memory_contexts(spark, sf))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' OR event_id % 50 = 0")
def since_filter(spark, sf):
    """Times as text; every fiftieth can't be read and stays."""
    e = T.load(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("at"))
    return N.since(e, "at", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT CASE WHEN regexp_matches(url, '\\.html$') THEN '.html' ELSE '' END AS ext, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM (SELECT regexp_replace(url, '[?#].*$', '') AS url, html FROM pages) GROUP BY 1")
def extension_summary(spark, sf):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://[^/]*", "")
    return N.extension_summary(T.load(spark, sf, "pages").select(path.alias("path"), F.octet_length("html").alias("length")))


@query("""SELECT url AS path, 'download' AS visit, 'external' AS size_class, 'single' AS recursion FROM pages UNION ALL
 SELECT 'dir/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 4 = 0 THEN '.zip' ELSE '.md' END, 'file', CASE WHEN n_chars * 20000 <= 10485760 THEN 'in_memory' WHEN n_chars * 20000 <= 10737418240 THEN 'external' ELSE 'too_large' END, CASE WHEN doc_id % 4 = 0 THEN 'expand' ELSE 'single' END FROM documents""")
def resource_detection(spark, sf):
    web = T.load(spark, sf, "pages").select(F.col("url").alias("path"), F.lit(None).cast("long").alias("size"))
    name = F.concat(F.lit("dir/"), "doc_id", F.when(F.col("doc_id") % 4 == 0, ".zip").otherwise(".md"))
    local = T.load(spark, sf, "documents").select(name.alias("path"), (F.col("n_chars") * 20000).alias("size"))
    return N.detect(web.union(local))


@query("""SELECT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst FROM customer""")
def relation_files(spark, sf):
    """Relation files, flat for even customers and by user for odd ones; one in ten is damaged besides."""
    c = T.load(spark, sf, "customer")
    entries = F.to_json(F.array(F.struct(F.lit("link_1").alias("id"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("uris"), F.lit("").alias("reason"))))
    content = F.when(F.col("c_custkey") % 2 == 0, entries).otherwise(F.concat(F.lit('{"u": '), entries, F.lit("}")))
    files = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), content.alias("content")).union(c.where("c_custkey % 10 = 0").select(F.lit("bad"), F.lit("{oops")))
    return N.relations_from_json(files).select("src", F.explode("uris").alias("dst"))


_PAIRS = f"WITH t AS (SELECT conv_id, turn, list_distinct({tokens_sql('text')}) AS q, list_distinct({tokens_sql('nxt')}) AS d FROM (SELECT conv_id, turn, text, coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS nxt FROM conversations)) "


@query(_PAIRS + "SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.5 ELSE len(list_intersect(q, d)) / len(q) END, 9) AS score FROM t")
def rerank_overlap(spark, sf):
    """Turns as queries, the turn that follows as the text to rank."""
    nxt = F.lead("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = T.load(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"), nxt.alias("abstract"), F.lit(0.5).alias("score"))
    return R.rerank_by_overlap(rows).select("conv_id", "turn", F.round("score", 9).alias("score"))


_BLOCK = """WITH r AS (SELECT conv_id, turn + 1 AS place, '[memory] ' || 'u' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || ': ' || substr(text, 1, 300) AS line FROM conversations),
 s AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY conv_id ORDER BY place) AS used FROM r) """


def _results(spark, sf):
    c = T.load(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("place"), F.lit("memory").alias("context_type"), F.concat(F.lit("u"), "conv_id", F.lit("/"), "turn").alias("uri"), F.col("text").alias("abstract"), (1.0 / (F.col("turn") + 1)).alias("score"))


@query(_BLOCK + "SELECT conv_id AS query_id, place, line FROM s WHERE used <= 700")
def context_blocks(spark, sf):
    return R.context_block(_results(spark, sf), 700).select("query_id", "place", "line")


@query("""SELECT conv_id AS query_id, string_agg(printf('%d. [memory] u%d/%d (%.4f)', turn + 1, conv_id, turn, 1.0 / (turn + 1)) || chr(10) || '   ' || substr(text, 1, 300) || CASE WHEN length(text) > 300 THEN '...' ELSE '' END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def formatted_results(spark, sf):
    return N.format_results(_results(spark, sf))


_IMPORTS = """i AS (SELECT doc_id AS seq, 'ctx://' || CASE doc_id % 4 WHEN 0 THEN 'resources' WHEN 1 THEN 'user' WHEN 2 THEN 'agent' ELSE 'resources' END || '/' || CASE WHEN doc_id % 3 = 0 THEN 'org' || lang || '/' || source WHEN doc_id % 3 = 1 THEN 'My_' || lang ELSE CASE doc_id % 5 WHEN 0 THEN 'unnamed' ELSE source || '_x' END END AS base FROM documents)"""


@query(f"""WITH RECURSIVE {_IMPORTS}, e AS (SELECT DISTINCT base || CASE WHEN seq % 7 = 0 THEN '' ELSE '_' || CAST(seq % 90 + 1 AS VARCHAR) END AS uri FROM i WHERE seq % 3 = 1),
 f AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM (SELECT DISTINCT base FROM i), range(0, 101) t(n) WHERE NOT EXISTS (FROM e WHERE e.uri = base || CASE WHEN n = 0 THEN '' ELSE '_' || n END)),
 r AS (SELECT seq, base, row_number() OVER (PARTITION BY base ORDER BY seq) AS k FROM i)
 SELECT seq, base || CASE WHEN n IS NULL THEN '_101' WHEN n = 0 THEN '' ELSE '_' || n END AS uri FROM r LEFT JOIN f USING (base, k)""")
def import_targets(spark, sf):
    """Places of imported trees by scope, repository or name, with the first free suffix."""
    d = T.load(spark, sf, "documents")
    i = F.col("doc_id")
    host = F.when(i % 2 == 0, "https://github.com/").otherwise("https://gitlab.com/")
    url = F.when(i % 3 == 0, F.concat(host, F.lit("org"), "lang", F.lit("/"), "source", F.when(i % 4 == 0, ".git").otherwise("/tree/main"))).otherwise("https://example.org/a/b")
    name = F.when(i % 3 == 1, F.concat(F.lit(" My "), "lang")).otherwise(F.when(i % 5 == 0, "  ").otherwise(F.concat("source", F.lit("/x"))))
    scope = F.element_at(F.array(*map(F.lit, ("resources", "user", "agent", "other"))), (i % 4 + 1).cast("int"))
    rows = d.select(i.alias("seq"), scope.alias("scope"), name.alias("name"), url.alias("url"))
    kept = F.element_at(F.array(*map(F.lit, ("resources", "user", "agent", "resources"))), (i % 4 + 1).cast("int"))
    uri = F.concat(F.lit("ctx://"), kept, F.lit("/My_"), "lang", F.when(i % 7 == 0, "").otherwise(F.concat(F.lit("_"), i % 90 + 1)))
    return Y.import_targets(rows, d.where(i % 3 == 1).select(uri.alias("uri")).distinct())


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 255 THEN text ELSE p || CASE WHEN strlen(p) < 246 THEN chr(65533) ELSE '' END || '_' || substr(sha256(text), 1, 8) END AS name
 FROM (SELECT doc_id, text, substr(text, 1, list_max(list_filter(range(0, 247), lambda i: strlen(substr(text, 1, i)) <= 246))) AS p FROM documents)""")
def shortened_names(spark, sf):
    """Path components of up to 255 bytes; longer ones keep a head and a hash."""
    return T.load(spark, sf, "documents").select("doc_id", U.shorten(F.col("text")).alias("name"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE p || CASE WHEN strlen(p) < 200 THEN chr(65533) ELSE '' END || '...' END AS cut
 FROM (SELECT doc_id, text, substr(text, 1, list_max(list_filter(range(0, 201), lambda i: strlen(substr(text, 1, i)) <= 200))) AS p FROM documents)""")
def byte_truncation(spark, sf):
    """Cut to 200 bytes: what is left of a character that is cut in two becomes one replacement character."""
    return T.load(spark, sf, "documents").select("doc_id", X.truncate_bytes(F.col("text"), 200).alias("cut"))


@query("""WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), c AS (SELECT user_id AS candidate, event_type FROM e WHERE n = 1)
 SELECT CASE WHEN candidate % 2 = 0 THEN 'mem/' || CAST(candidate AS VARCHAR) ELSE 'new/' || CAST(candidate AS VARCHAR) END AS uri, CASE WHEN candidate % 2 = 0 THEN 'old' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || event_type ELSE event_type END AS content FROM c
 UNION ALL SELECT 'mem/' || CAST(candidate AS VARCHAR), 'old' FROM c WHERE candidate % 2 = 1""")
def memory_dispatch(spark, sf):
    """Candidates of even users are merged into their memory, those of odd ones are created."""
    e = T.load(spark, sf, "events").groupBy(F.col("user_id").alias("candidate")).agg(F.min_by("event_type", "event_id").alias("content"))
    cand = e.select("candidate", F.concat(F.lit("new/"), "candidate").alias("uri"), "content")
    old = e.select(F.concat(F.lit("mem/"), "candidate").alias("uri"), F.lit("old").alias("content"))
    even = F.col("candidate") % 2 == 0
    settled = M.decide(e.select("candidate", F.when(even, "merge").otherwise("create").alias("decision")), e.where(even).select("candidate", F.lit(0).cast("long").alias("pos"), F.concat(F.lit("mem/"), "candidate").alias("uri"), F.lit("merge").alias("action")))
    return M.dispatch(cand, old, settled)[0]
