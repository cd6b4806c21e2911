"""Queries of the context table: filters, pages, tree, mutation and sync."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.operators import filters as L
from quiverlake.operators import store as S
from quiverlake.operators import sync
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T

_M = f"WITH {T.MEMORIES_SQL} "
_D = f"WITH {T.DOCS_SQL} "
_TS = "strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at"


def _ts(df):
    return df.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query(_M + "SELECT id, uri, category FROM memories WHERE (category = 'events' OR category IN ('cases','profile')) AND account_id = 'acme' AND NOT owner_space = 'u3'")
def filter_query(spark, sf):
    where = L.And((L.Or((L.Eq("category", "events"), L.In("category", ("cases", "profile")))), L.Eq("account_id", "acme"), L.Not(L.Eq("owner_space", "u3"))))
    return S.query(T.memory_contexts(spark, sf), where).select("id", "uri", "category")


@query(_D + "SELECT id, uri FROM docs WHERE starts_with(uri, 'ctx://resources/en/') AND NOT contains(substr(uri, 20), '/') OR uri = 'ctx://resources/fr/src1' OR starts_with(uri, 'ctx://resources/fr/src1/')")
def path_scope(spark, sf):
    where = L.Or((L.PathScope("uri", "ctx://resources/en", 1), L.PathScope("uri", "ctx://resources/fr/src1")))
    return S.query(T.doc_contexts(spark, sf), where).select("id", "uri")


@query(_D + "SELECT id FROM docs WHERE starts_with(uri, 'ctx://resources/de/')")
def filter_from_json(spark, sf):
    return S.query(T.doc_contexts(spark, sf), L.from_json(L.to_json(L.PathScope("uri", "ctx://resources/de")))).select("id")


@query(_M + f"SELECT id, category, {_TS} FROM memories WHERE account_id = 'default' ORDER BY active_count DESC, id LIMIT 25 OFFSET 10")
def sorted_page(spark, sf):
    page = S.query(T.memory_contexts(spark, sf), L.Eq("account_id", "default"), "active_count", True, 25, 10)
    return _ts(page.select("id", "category", "updated_at"))


@query(f"""{_M}SELECT id, uri, 'memory' AS context_type, 2 AS level, 'seen ' || regexp_extract(id, '[a-z]+$') AS abstract, strftime(m.updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at,
 CASE WHEN count(*) OVER () = 40 THEN 60 END::BIGINT AS next_offset FROM (SELECT * FROM memories ORDER BY updated_at DESC, id LIMIT 40 OFFSET 20) m""")
def vector_scroll(spark, sf):
    return _ts(S.scroll(T.memory_contexts(spark, sf), 40, 20))


@query(_M + f"SELECT id, {_TS} FROM memories m ORDER BY m.updated_at DESC, uri, id LIMIT 15")
def newest_contexts(spark, sf):
    return _ts(S.newest(T.memory_contexts(spark, sf), 15).select("id", "updated_at"))


@query(_M + "SELECT count(*) AS n FROM memories WHERE category = 'cases'")
def count_where(spark, sf):
    return S.count(T.memory_contexts(spark, sf), L.Eq("category", "cases"))


@query(_M + "SELECT category, count(*) AS n FROM memories GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM memories")
def memory_category_counts(spark, sf):
    return S.category_counts(T.memory_contexts(spark, sf))


@query(f"WITH {T.VECTORS_SQL} SELECT (SELECT count(*) FROM documents) AS contexts, count(*) AS vectors, max(len(vector))::INTEGER AS dimension, true AS has_vectors FROM vecs")
def store_statistics(spark, sf):
    return S.store_stats(T.doc_contexts(spark, sf), T.vector_contexts(spark, sf))


@query(_M + "SELECT owner_space AS session_id, count(*) AS n FROM memories WHERE account_id = 'acme' GROUP BY 1")
def extraction_counts(spark, sf):
    return T.memory_contexts(spark, sf).where("account_id = 'acme'").groupBy(F.col("owner_space").alias("session_id")).agg(F.count("*").alias("n"))


@query(_M + "SELECT id, uri, owner_space = 'u7' AS visible FROM memories")
def access_check(spark, sf):
    seen = U.accessible(F.col("uri"), F.lit("user"), F.lit("u7"), F.lit("u7"))
    return T.memory_contexts(spark, sf).select("id", "uri", seen.alias("visible"))


@query(_D + """SELECT uri, CAST(k + 1 AS BIGINT) AS line, lines[k + 1] AS content FROM (SELECT uri, string_split(content, chr(10)) AS lines FROM docs) t, unnest(range(len(lines))) u(k)
 WHERE contains(lower(lines[k + 1]), 'license')""")
def grep_lines(spark, sf):
    return S.grep(T.docs(spark, sf), "license", ignore_case=True)


@query(_D + "SELECT uri FROM docs WHERE regexp_matches(substr(uri, 17), '^en/src[^/]/[^/]*1\\.md$')")
def glob_paths(spark, sf):
    return S.glob(T.doc_contexts(spark, sf), "en/src?/*1.md", "ctx://resources")


@query(_D + """SELECT uri, name, true AS is_leaf FROM (SELECT uri, substr(uri, 25) AS name FROM docs) WHERE starts_with(uri, 'ctx://resources/en/src1/')""")
def list_directory(spark, sf):
    return S.list_children(T.doc_contexts(spark, sf), "ctx://resources/en/src1")


@query(_D + """, e AS (SELECT DISTINCT parent_uri AS uri, true AS is_dir, 1 AS depth FROM docs UNION ALL SELECT DISTINCT regexp_replace(parent_uri, '/[^/]*$', ''), true, 0 FROM docs
 UNION ALL SELECT uri, false, 2 FROM docs) SELECT uri, is_dir, CAST(depth AS INTEGER) AS depth FROM e WHERE depth < 2""")
def tree_walk(spark, sf):
    return S.tree(T.doc_contexts(spark, sf), "ctx://resources", 2)


@query(_D + """, s AS (SELECT parent_uri AS uri, strlen(content) AS size FROM docs UNION ALL SELECT regexp_replace(parent_uri, '/[^/]*$', ''), strlen(content) FROM docs
 UNION ALL SELECT 'ctx://resources', strlen(content) FROM docs) SELECT uri, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM s GROUP BY uri""")
def directory_usage(spark, sf):
    return S.disk_usage(T.docs(spark, sf).withColumn("size", F.octet_length("content")))


@query(_D + """SELECT id, 'ctx://archive/' || substr(uri, 20) AS uri, 'ctx://archive/' || substr(parent_uri, 20) AS parent_uri FROM docs WHERE starts_with(uri, 'ctx://resources/en/')
 UNION ALL SELECT id, uri, parent_uri FROM docs WHERE NOT starts_with(uri, 'ctx://resources/en/')""")
def rename_subtree(spark, sf):
    return S.rename_subtree(T.docs(spark, sf), "ctx://resources/en", "ctx://archive").select("id", "uri", "parent_uri")


@query(_D + "SELECT id FROM docs WHERE NOT starts_with(uri, 'ctx://resources/fr/')")
def delete_subtree(spark, sf):
    return S.delete_subtree(T.doc_contexts(spark, sf), "ctx://resources/fr").select("id")


@query(_D + "SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_ids(spark, sf):
    gone = T.load(spark, sf, "labels").where("toxic = 1").select(F.concat(F.lit("doc_"), "doc_id").alias("id"))
    return S.delete(T.doc_contexts(spark, sf), gone).select("id")


@query(f"WITH {T.VECTORS_SQL} SELECT id FROM vecs WHERE NOT (uri = 'ctx://resources/topic_3' OR starts_with(uri, 'ctx://resources/topic_3/'))")
def delete_where_with_vectors(spark, sf):
    v = T.vector_contexts(spark, sf)
    return S.delete_where(v.select("id", "uri"), v.select("id", "vector"), L.PathScope("uri", "ctx://resources/topic_3"))[1].select("id")


@query("""SELECT user_id AS id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS created_at, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def upsert_merge(spark, sf):
    """Events in order of id, the even ones as the table and the odd ones as its changes."""
    e = T.load(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("kind"), "value", F.col("event_id").alias("seq"))
    first = e.groupBy("id").agg(F.min_by(F.struct("created_at", "kind", "value"), F.col("seq")).alias("r"), F.min("created_at").alias("c")).select("id", F.col("c").alias("created_at"), "r.kind", "r.value")
    return S.upsert(first, e).withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query(_D + """SELECT id, 'resource' AS context_type, '' AS category, parent_uri FROM docs""")
def complete_rows(spark, sf):
    d = T.docs(spark, sf).select("id", "uri", F.lit(None).cast("string").alias("context_type"), F.lit("").alias("category"), F.lit(None).cast("string").alias("parent_uri"))
    return S.complete(d).select("id", "context_type", "category", "parent_uri")


@query(_D + "SELECT id, sha256(uri || '|2') AS row_id FROM docs")
def stable_ids(spark, sf):
    return T.docs(spark, sf).select("id", S.stable_id(F.col("uri"), F.lit(None).cast("int")).alias("row_id"))


@query("""WITH o AS (SELECT doc_id, text, doc_id % 10 AS m FROM documents), a AS (SELECT doc_id, sha256(text) AS h FROM o WHERE m <> 1),
 b AS (SELECT doc_id, sha256(CASE WHEN m = 2 THEN text || '!' ELSE text END) AS h FROM o WHERE m <> 3)
 SELECT coalesce(a.doc_id, b.doc_id) AS path, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status
 FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def snapshot_diff(spark, sf):
    """Two listings of the documents: some added, some edited, some gone."""
    d = T.load(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    m = F.col("path") % 10
    before = sync.snapshot(d.where(m != 1))
    after = sync.snapshot(d.where(m != 3).withColumn("content", F.when(m == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    return sync.diff(before, after).select("path", "status")


@query(_D + """, f AS (SELECT uri, regexp_extract(uri, 'src([0-9]+)/', 1)::INT AS s, lower(regexp_extract(uri, '//resources/([a-z]+)/', 1)) AS lang FROM docs), dirs AS (SELECT DISTINCT 'ctx://resources/' || lang || '/src' || s AS uri, s, lang FROM f)
 SELECT 'directory' AS kind, 'deleted' AS status, uri FROM dirs WHERE s = 1 UNION ALL SELECT 'directory', 'added', uri FROM dirs WHERE s = 2
 UNION ALL SELECT 'file', 'deleted', uri FROM f WHERE s = 3 AND ends_with(uri, '7.md') UNION ALL SELECT 'file', 'updated', uri FROM f WHERE s = 4 AND ends_with(uri, '5.md')""")
def tree_diff(spark, sf):
    """Whole directories appear and go; they are reported once, without what they hold."""
    d = T.docs(spark, sf)
    s = F.regexp_extract("uri", "src([0-9]+)/", 1).cast("int")
    old = d.where(s != 2).select("uri", "content")
    new = d.where((s != 1) & ~((s == 3) & F.endswith("uri", F.lit("7.md")))).select("uri", F.when((s == 4) & F.endswith("uri", F.lit("5.md")), F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return sync.tree_diff(old, new)


def _tree(spark, sf):
    """Files and directories of the documents as ``(node, parent, depth)``, the resources at the top."""
    d = T.docs(spark, sf)
    nodes = d.select("uri", X.abstract(F.col("content")).alias("text")).unionByName(S.directories(d).withColumn("text", F.lit(None).cast("string")))
    return nodes.select(F.col("uri").alias("node"), F.nullif(U.parent(F.col("uri")), F.lit("")).alias("parent"), (U.depth(F.col("uri")) - 1).alias("depth"), "text")


_LEVELS = _D + """, b AS (SELECT parent_uri AS uri, regexp_replace(parent_uri, '/[^/]*$', '') AS up, count(*) AS n, string_agg(uri, '; ' ORDER BY uri) AS s FROM docs GROUP BY ALL),
 a AS (SELECT up AS uri, CAST(sum(n) AS BIGINT) AS n, string_agg(uri, '; ' ORDER BY uri) AS s FROM b GROUP BY up) """


@query(_LEVELS + """SELECT uri, n AS leaves, s AS summary FROM b UNION ALL SELECT uri, n, s FROM a UNION ALL SELECT 'ctx://resources', CAST(sum(n) AS BIGINT), string_agg(uri, '; ' ORDER BY uri) FROM a""")
def rollup_tree(spark, sf):
    """Documents below sources below languages, summarised bottom up."""
    done = sync.rollup(_tree(spark, sf), lambda names, texts: F.array_join(names, "; "), merge=lambda texts: F.array_join(texts, "; "))
    return done.where("depth < 3").select(F.col("node").alias("uri"), "leaves", F.col("text").alias("summary"))


@query("""SELECT 'ctx://s/' || CAST(s_suppkey AS VARCHAR) AS src, 'link_1' AS link_id, 'ctx://n/' || CAST(s_nationkey AS VARCHAR) AS dst, 'home' AS reason FROM supplier""")
def relation_edges(spark, sf):
    s = T.load(spark, sf, "supplier")
    none = spark.createDataFrame([], "src string, link_id string, uris array<string>, reason string")
    new = s.select(F.concat(F.lit("ctx://s/"), "s_suppkey").alias("src"), F.array(F.concat(F.lit("ctx://n/"), "s_nationkey")).alias("uris"), F.lit("home").alias("reason"), F.col("s_suppkey").alias("seq"))
    return S.relations(S.link(none, new))


@query(_LEVELS + """, e AS (SELECT uri AS node, parent_uri AS ancestor, 1 AS distance FROM docs UNION ALL SELECT uri, regexp_replace(parent_uri, '/[^/]*$', ''), 2 FROM docs UNION ALL SELECT uri, 'ctx://resources', 3 FROM docs
 UNION ALL SELECT uri, up, 1 FROM b UNION ALL SELECT uri, 'ctx://resources', 2 FROM b UNION ALL SELECT uri, 'ctx://resources', 1 FROM a) SELECT node, ancestor, CAST(distance AS INTEGER) AS distance FROM e""")
def ancestors(spark, sf):
    return sync.ancestors(_tree(spark, sf).where("parent is not null"), most=8)


@query("""WITH c AS (SELECT doc_id, 'topic/' || lang AS base FROM documents) SELECT doc_id, CASE WHEN rn = 1 THEN base ELSE base || '_' || CAST(rn - 1 AS VARCHAR) END AS name
 FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS rn FROM c)""")
def unique_names(spark, sf):
    d = T.load(spark, sf, "documents").select("doc_id", F.concat(F.lit("topic/"), "lang").alias("base"))
    return sync.unique_names(d, "base", "doc_id").select("doc_id", "name")


@query("SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN n_chars > 20000 THEN 'too_large' WHEN lang = 'de' THEN 'excluded' WHEN n_chars < 200 THEN 'skipped' ELSE 'processable' END AS status FROM documents")
def scan_classification(spark, sf):
    d = T.load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", "n_chars")
    return sync.classify(d, [(F.col("n_chars") > 20000, "too_large"), (F.col("lang") == "de", "excluded"), (F.col("n_chars") < 200, "skipped")], "processable").select("path", "status")


_PATH = "source || CASE doc_id % 6 WHEN 0 THEN '/node_modules/' WHEN 1 THEN '/.trash/' ELSE '/' END || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || CASE WHEN doc_id % 11 = 0 THEN 'old_' ELSE '' END || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.bin' ELSE '' END"


def _listing(spark, sf):
    """Documents as files of a folder: some hidden, in tool folders, or without an extension."""
    i = F.col("doc_id")
    folder = F.when(i % 6 == 0, "/node_modules/").when(i % 6 == 1, "/.trash/").otherwise("/")
    ext = F.when(i % 4 == 0, ".py").when(i % 4 == 1, ".MD").when(i % 4 == 2, ".bin").otherwise("")
    name = F.concat(F.when(i % 7 == 0, ".").otherwise(""), F.when(i % 11 == 0, "old_").otherwise(""), i.cast("string"), ext)
    return T.load(spark, sf, "documents").select("doc_id", F.concat("source", folder, name).alias("path"), F.col("text").alias("content"), F.octet_length("text").alias("length"))


@query(f"""SELECT path, CASE WHEN contains(path, '/node_modules/') THEN 'ignored_dir' WHEN starts_with(name, '.') OR strlen(text) = 0 THEN 'skipped' WHEN starts_with(name, 'old_') THEN 'excluded'
 WHEN regexp_matches(name, '[.](py|MD)$') THEN 'processable' ELSE 'unsupported' END AS status FROM (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM (SELECT {_PATH} AS path, text FROM documents))""")
def scan_files(spark, sf):
    return sync.scan_files(_listing(spark, sf), [".py", ".md"], exclude="old_*").select("path", "status")


@query(f"""WITH f AS (SELECT doc_id, {_PATH} AS path FROM documents), t AS (SELECT * FROM f WHERE NOT contains(path, '/node_modules/') AND NOT contains(path, '/.trash/') AND regexp_matches(path, '[.](py|MD)$'))
 SELECT path, 'ctx://resources/in/' || path AS target, CASE WHEN doc_id % 5 = 1 THEN 'removed' WHEN doc_id % 5 = 2 THEN 'added' ELSE 'changed' END AS status FROM t WHERE doc_id % 5 IN (1, 2, 3)""")
def folder_sync(spark, sf):
    """A folder against its last snapshot: some files went, some came, some changed."""
    f = _listing(spark, sf)
    m = F.col("doc_id") % 5
    known = sync.snapshot(sync.synced(f.where(m != 2).withColumn("content", F.when(m == 3, "old").otherwise(F.col("content")))))
    return sync.sync_plan(known, f.where(m != 1), "ctx://resources/in/")


@query(_D + "SELECT id, uri FROM docs WHERE id IN (SELECT 'doc_' || CAST(doc_id AS VARCHAR) FROM documents ORDER BY doc_id LIMIT 3) OR id = (SELECT 'doc_' || CAST(max(doc_id) AS VARCHAR) FROM documents)")
def get_by_ids(spark, sf):
    """The three least ids and the greatest, which a reader would hold, and one that doesn't exist."""
    ids = T.load(spark, sf, "documents").select("doc_id")
    asked = [r.doc_id for r in ids.orderBy("doc_id").limit(3).union(ids.orderBy(F.desc("doc_id")).limit(1)).collect()]
    return S.get(T.doc_contexts(spark, sf), [f"doc_{i}" for i in asked] + ["gone"]).select("id", "uri")


@query(f"WITH {T.VECTORS_SQL} SELECT id, uri, level FROM vecs WHERE uri = 'ctx://resources/topic_1' LIMIT 1")
def get_by_uri(spark, sf):
    return S.get_by_uri(T.vector_contexts(spark, sf), "ctx://resources/topic_1").select("id", "uri", "level")


@query(_M + "SELECT id FROM memories WHERE account_id = 'acme'")
def scope_filter(spark, sf):
    """What a user of one tenant sees of a type."""
    return S.query(T.memory_contexts(spark, sf), L.scope_filter("memory", "acme", "user")).select("id")


@query("SELECT 'ctx://c/' || CAST(c_nationkey AS VARCHAR) AS src, 'link_' || CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS VARCHAR) AS link_id, CAST(c_custkey AS VARCHAR) AS dst FROM customer")
def numbered_links(spark, sf):
    """Every nation links its customers; each link gets the first free number, odd numbers are taken before."""
    c = T.load(spark, sf, "customer").withColumn("n", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    src, uris = F.concat(F.lit("ctx://c/"), "c_nationkey").alias("src"), F.array(F.col("c_custkey").cast("string")).alias("uris")
    old = c.where("n % 2 = 1").select(src, F.concat(F.lit("link_"), "n").alias("link_id"), uris, F.lit("").alias("reason"))
    new = c.where("n % 2 = 0").select(src, uris, F.lit("").alias("reason"), F.col("c_custkey").alias("seq"))
    return S.relations(S.link(old, new)).select("src", "link_id", "dst")


@query("""SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN CAST(strlen(text) AS VARCHAR) || ' B' ELSE printf('%.1f KB', strlen(text) / 1024.0) END AS size FROM documents""")
def human_sizes(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", X.human_size(F.octet_length("text")).alias("size"))
