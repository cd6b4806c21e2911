"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.functions import scoring
from quiverlake.functions import text as X
from quiverlake.functions import uri as U
from quiverlake.functions import vector as V
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T

_M = f"WITH {T.MEMORIES_SQL} "
_D = f"WITH {T.DOCS_SQL} "
AS_OF = "2024-02-01 00:00:00"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
TOKENS_SQL = f"list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+'), lambda w: strlen(w) > 1 AND w NOT IN ({_STOP}))"


def tokens_sql(col: str) -> str:
    return TOKENS_SQL.format(col)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("""SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9_-]', '_', 'g') AS tool, regexp_replace(text, '[^A-Za-z0-9_-]', '_', 'g') AS plain, CASE WHEN t = '' THEN 'unnamed' ELSE translate(t, ' /' || chr(92), '___') END AS segment,
 length(text) AS chars FROM (SELECT doc_id, text, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM documents)""")
def sanitized_names(spark, sf):
    t = F.col("text")
    return T.load(spark, sf, "documents").select("doc_id", U.sanitize_name(t).alias("tool"), U.sanitize_plain(t).alias("plain"), U.sanitize_segment(t).alias("segment"), F.length(t).cast("long").alias("chars"))


@query("""SELECT user_id, event_type, CASE event_type WHEN 'view' THEN 'ctx://user/u' || CAST(user_id AS VARCHAR) || '/memories/events/' WHEN 'click' THEN 'ctx://user/u' || CAST(user_id AS VARCHAR) || '/memories/preferences/'
 WHEN 'error' THEN 'ctx://agent/a/memories/cases/' WHEN 'purchase' THEN 'ctx://user/u' || CAST(user_id AS VARCHAR) || '/memories/entities/' ELSE '' END AS prefix,
 CASE WHEN user_id % 5 = 0 THEN '' WHEN event_type = 'view' THEN 'ctx://user/u' || CAST(user_id AS VARCHAR) || '/memories ctx://agent/a/memories' WHEN event_type = 'click' THEN 'ctx://resources' WHEN event_type = 'error' THEN 'ctx://agent/a/skills'
 ELSE 'ctx://user/u' || CAST(user_id AS VARCHAR) || '/memories ctx://agent/a/memories ctx://resources ctx://agent/a/skills' END AS roots FROM (SELECT DISTINCT user_id, event_type FROM events)""")
def search_scopes(spark, sf):
    """Category prefixes and search roots of each user; the type of an event tells what is asked for."""
    rows = T.load(spark, sf, "events").select("user_id", "event_type").distinct()
    user, agent, kind = F.concat(F.lit("u"), "user_id"), F.lit("a"), F.col("event_type")
    category = F.coalesce(*[F.when(kind == k, v) for k, v in T.KINDS.items()], F.lit("profile"))
    asked = F.when(kind == "view", "memory").when(kind == "click", "resource").when(kind == "error", "skill").otherwise("")
    role = F.when(F.col("user_id") % 5 == 0, "root").otherwise("user")
    return rows.select("user_id", "event_type", U.category_prefix(category, user, agent).alias("prefix"), F.array_join(U.root_uris(asked, role, user, agent), " ").alias("roots"))


@query(_M + """SELECT id, 'user' AS scope, owner_space AS space, regexp_replace(uri, '/[^/]*$', '') AS parent, 5 AS depth, regexp_extract(uri, '[^/]*$') AS name,
 'memory' AS row_type, 'memory' AS query_type, category FROM memories""")
def uri_parts(spark, sf):
    u = F.col("uri")
    return T.memory_contexts(spark, sf).select("id", U.scope(u).alias("scope"), U.space(u).alias("space"), U.parent(u).alias("parent"), U.depth(u).alias("depth"), U.name(u).alias("name"), U.row_type(u).alias("row_type"), U.query_type(u).alias("query_type"), U.category(u).alias("category"))


@query("""SELECT page_id, 'ctx://' || regexp_replace(p, '^/+|/+$', '', 'g') AS uri, NOT regexp_matches(p, '(^|/)\\.\\.?(/|$)') AND length(regexp_replace(p, '/', '', 'g')) > 0 AS valid
 FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/' || q WHEN 1 THEN q || '/' ELSE q END AS p FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE WHEN page_id % 5 = 0 THEN '/../x' ELSE '' END AS q FROM pages))""")
def uri_normalize(spark, sf):
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    raw = F.concat(bare, F.when(F.col("page_id") % 5 == 0, "/../x").otherwise(""))
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), raw)).when(F.col("page_id") % 3 == 1, F.concat(raw, F.lit("/"))).otherwise(raw)
    u = U.normalize(raw)
    return T.load(spark, sf, "pages").select("page_id", u.alias("uri"), U.is_valid(u).alias("valid"))


@query(_M + "SELECT id, regexp_replace(uri, '^(.*?/memories)/', '\\1/_archive/') AS archived, uri AS restored, uri || '/.abstract.md' AS l0, uri || '/.overview.md' AS l1, uri AS l2 FROM memories")
def uri_rewrites(spark, sf):
    u = F.col("uri")
    a = U.archive(u)
    return T.memory_contexts(spark, sf).select("id", U.archive(a).alias("archived"), U.restore(a).alias("restored"), *[U.with_level(u, F.lit(n)).alias(f"l{n}") for n in (0, 1, 2)])


@query("""SELECT page_id, 'url' AS kind, regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '([^/]*)/*$', 1) AS file,
 CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '\\.html$') THEN '.html' ELSE '' END AS ext FROM pages""")
def url_sources(spark, sf):
    u = F.col("url")
    path = F.regexp_replace(F.regexp_replace(u, "^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return T.load(spark, sf, "pages").select("page_id", U.source_kind(u).alias("kind"), U.url_file(u).alias("file"), U.extension(path).alias("ext"))


@query("""SELECT doc_id, substr(text, 1, 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS cut, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS safe,
 sha256(text) AS hash, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM documents""")
def text_scalars(spark, sf):
    t = F.col("text")
    return T.load(spark, sf, "documents").select("doc_id", X.truncate(t, 80).alias("cut"), U.sanitize(t).alias("safe"), F.sha2(t, 256).alias("hash"), X.estimate_tokens(t).alias("tokens"))


@query("""SELECT doc_id, coalesce(CASE WHEN starts_with(line, '# ') THEN trim(substr(line, 3), ' \t') WHEN length(line) > 200 THEN substr(line, 1, 200) || '...' ELSE line END, '') AS abstract
 FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10))[1:20], lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '')[1] AS line FROM documents)""")
def abstracts(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", X.abstract(F.col("text")).alias("abstract"))


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def evaluation_tokens(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", F.array_join(X.tokens(F.col("text")), " ").alias("tokens"))


@query("""SELECT conv_id, CASE WHEN m >= 2 AND m >= 0.1 * total THEN CASE WHEN ko = m THEN 'ko' WHEN ru = m THEN 'ru' ELSE 'ar' END WHEN kana > 0 THEN 'ja' WHEN han > 0 THEN 'zh-CN' ELSE 'en' END AS language
 FROM (SELECT *, greatest(ko, ru, ar) AS m FROM (SELECT conv_id, len(regexp_extract_all(t, '[\\x{AC00}-\\x{D7AF}]')) AS ko, len(regexp_extract_all(t, '[\\x{0400}-\\x{04FF}]')) AS ru, len(regexp_extract_all(t, '[\\x{0600}-\\x{06FF}]')) AS ar,
 len(regexp_extract_all(t, '[\\x{3040}-\\x{30FF}]')) AS kana, len(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]')) AS han, length(regexp_replace(t, '\\s+', '', 'g')) AS total
 FROM (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, chr(10) ORDER BY turn), '') AS t FROM conversations GROUP BY conv_id)))""")
def language_detect(spark, sf):
    m = T.messages(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("seq", "content")))).alias("m"))
    return m.select(F.col("session_id").alias("conv_id"), X.language(F.array_join(F.col("m.content"), "\n")).alias("language"))


@query("""WITH f AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM conversations),
 g AS (SELECT *, CASE WHEN contains(t, ':') AND trim(split_part(t, ':', 1)) <> '' THEN trim(split_part(t, ':', 1)) WHEN contains(t, '-') AND trim(split_part(t, '-', 1)) <> '' THEN trim(split_part(t, '-', 1))
 WHEN contains(t, '—') AND trim(split_part(t, '—', 1)) <> '' THEN trim(split_part(t, '—', 1)) WHEN regexp_extract(t, '^(.{1,24})\\s', 1) <> '' THEN trim(regexp_extract(t, '^(.{1,24})\\s', 1)) ELSE substr(t, 1, 24) END AS k FROM f)
 SELECT conv_id, turn, k AS facet FROM g""")
def facet_keys(spark, sf):
    return T.load(spark, sf, "conversations").select("conv_id", "turn", X.facet_key(F.col("text")).alias("facet"))


@query("""SELECT event_id, CASE WHEN regexp_matches(m, '400|401|403') THEN 'permanent' WHEN regexp_matches(m, '429|500|502|503|504') THEN 'transient' ELSE 'unknown' END AS class,
 least(5.0, 0.5 * pow(2.0, event_id % 6)) AS wait FROM (SELECT event_id, 'status ' || CAST(400 + CAST(floor(value) AS BIGINT) % 110 AS VARCHAR) AS m FROM events WHERE event_type = 'error')""")
def error_classes(spark, sf):
    e = T.load(spark, sf, "events").where("event_type = 'error'")
    m = F.concat(F.lit("status "), (F.lit(400) + F.floor("value") % 110).cast("string"))
    return e.select("event_id", X.error_class(m).alias("class"), X.backoff(F.col("event_id") % 6).alias("wait"))


@query("""SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, CAST(len(list_filter(l, lambda x: starts_with(x, 'def ') OR starts_with(x, 'func ') OR starts_with(x, 'fn ') OR starts_with(x, 'function '))) AS INTEGER) AS functions,
 CAST(len(list_filter(l, lambda x: starts_with(x, 'class ') OR starts_with(x, 'type ') OR starts_with(x, 'struct ') OR starts_with(x, 'interface '))) AS INTEGER) AS types
 FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))) AS l FROM documents)""")
def code_line_counts(spark, sf):
    return T.load(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in X.code_counts(F.col("text")).items()])


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"


@query(f"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM conversations),
 c AS (SELECT conv_id, turn, {_FNV} % 64 AS slot, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS size FROM c GROUP BY ALL)
 SELECT c.conv_id, c.turn, CAST(slot AS INTEGER) AS slot, round(n / size, 9) AS value FROM c JOIN s USING (conv_id, turn)""")
def hash_embeddings(spark, sf):
    c = T.load(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(V.hash_embedding(F.col("text"))).alias("slot", "value"))
    return c.where("value <> 0").select("conv_id", "turn", "slot", F.round("value", 9).alias("value"))


@query("""SELECT vec_id, CAST(k - 1 AS INTEGER) AS place, round(v[k] / n, 9) AS value FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding[1:16]::DOUBLE[], lambda x: x * x))) AS n, unnest(range(1, 17)) AS k FROM embeddings)""")
def matryoshka(spark, sf):
    """Every component of the vectors cut to 16 and scaled anew."""
    e = T.load(spark, sf, "embeddings").select("vec_id", F.posexplode(V.truncate(F.col("embedding"), 16)).alias("place", "value"))
    return e.select("vec_id", "place", F.round("value", 9).alias("value"))


@query("SELECT a.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS l2, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distances(spark, sf):
    a = T.load(spark, sf, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    e, o = F.col("embedding"), F.col("other")
    return a.join(b, "vec_id").select("vec_id", F.round(V.l2_distance(e, o), 9).alias("l2"), F.round(V.cosine(e, o), 9).alias("cosine"))


@query(_M + f"""SELECT id, round(h, 9) AS hotness, round(0.8 * 0.5 + 0.2 * h, 9) AS blended FROM (SELECT id, least(1.0, 0.3 * ln(1 + active_count) + 0.7 / log2(greatest(epoch(TIMESTAMP '{AS_OF}' - updated_at) / 3600.0, 1.0) + 2.0)) AS h FROM memories)""")
def hotness(spark, sf):
    h = scoring.hotness(F.col("active_count"), F.col("updated_at"), as_of())
    return T.memory_contexts(spark, sf).select("id", F.round(h, 9).alias("hotness"), F.round(scoring.blend(F.lit(0.5), h), 9).alias("blended"))
