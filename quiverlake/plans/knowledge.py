"""Queries of parsing, evaluation and memories."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from quiverlake.operators import embedding as B
from quiverlake.operators import evaluation as E
from quiverlake.operators import indexing as I
from quiverlake.operators import memory as M
from quiverlake.operators import parsing as P
from quiverlake.operators import sessions as S
from quiverlake.operators.search import knn
from quiverlake.plans.functions import AS_OF, as_of, tokens_sql
from quiverlake.plans.registry import query
from quiverlake.sources import documents as D
from quiverlake.sources import tables as T

_M = f"WITH {T.MEMORIES_SQL} "
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _end(start: str) -> str:
    """SQL of a chunk's end: behind the last blank line of its second half, or 1000 characters on."""
    part = f"substr(t, {start} + 1, 1000)"
    last = f"(1000 - strpos(reverse({part}), chr(10) || chr(10)) - 1)"
    return f"CASE WHEN {start} + 1000 >= length(t) THEN length(t) WHEN contains({part}, chr(10) || chr(10)) AND {last} > 500 THEN {start} + {last} + 2 ELSE {start} + 1000 END"


def _marked(spark, sf):
    """Documents whose every fifth line is made a heading."""
    d = T.load(spark, sf, "documents")
    mark = lambda x, i: F.when(i % 5 == 1, F.concat(F.lit("## "), x)).otherwise(x)
    return d.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("text"))


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 m AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 1 THEN '## ' || line ELSE line END AS line, CASE WHEN pos % 5 = 1 AND trim(line, {_TRIM}) <> '' THEN 2 ELSE 0 END AS level FROM l),
 s AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM m),
 g AS (SELECT doc_id, CAST(section AS INTEGER) AS section, CAST(max(level) AS INTEGER) AS level, coalesce(max(CASE WHEN level > 0 THEN regexp_replace(trim(line, {_TRIM}), '^#+\\s+', '') END), '') AS heading,
 coalesce(trim(string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY pos), {_TRIM}), '') AS content FROM s GROUP BY doc_id, section)
 SELECT doc_id, section, level, heading, content FROM g WHERE level > 0 OR content <> ''""")
def markdown_sections(spark, sf):
    return P.sections(_marked(spark, sf))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
 c AS (SELECT doc_id, t, 0::BIGINT AS k, 0::BIGINT AS a, {_end("0")} AS b FROM d WHERE length(t) > 0 UNION ALL
 SELECT doc_id, t, k + 1, b - 200, {_end("b - 200")} FROM c WHERE b < length(t))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk, CAST(a AS INTEGER) AS start, trim(substr(t, a + 1, b - a), {_TRIM}) AS content FROM c WHERE trim(substr(t, a + 1, b - a), {_TRIM}) <> ''""")
def text_chunks(spark, sf):
    """Line ends are doubled, so that texts have paragraphs to end chunks at."""
    d = T.load(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return P.chunks(d, 1000, 200)


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS items, CAST(strlen(html) AS INTEGER) AS bytes FROM pages")
def page_facts(spark, sf):
    return T.load(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<li>")).alias("items"), F.octet_length("html").alias("bytes"))


#: Pages as SQL sees them: scripts and styles are one token each, then comments, tags and texts.
_TOKEN = "(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>|<[^>]+>|[^<]+"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DROP = "['script', 'style', 'nav', 'footer', 'header', 'aside', 'noscript']"
_VOID = "['br', 'img', 'meta', 'link', 'input', 'hr', 'area', 'base', 'col', 'embed', 'source', 'track', 'wbr']"
_BLOCKS = "['p', 'div', 'section', 'article', 'table']"
_SEEN = "len(list_filter({}, lambda t: list_contains(" + _DROP + ", t))) > 0"
_CLOSED = f"CASE WHEN list_contains({_BLOCKS}, t) OR regexp_full_match(t, 'h[1-6]') THEN chr(10) WHEN t = 'pre' THEN chr(10) || '```' || chr(10) WHEN t = 'code' THEN '`' WHEN t IN ('strong', 'b') THEN '**' WHEN t IN ('em', 'i') THEN '*' WHEN t IN ('td', 'th') THEN ' | ' ELSE '' END"
_OPENED = f"CASE WHEN regexp_full_match(x.tag, 'h[1-6]') THEN chr(10) || chr(10) || repeat('#', CAST(substr(x.tag, 2) AS INTEGER)) || ' ' WHEN list_contains({_BLOCKS}, x.tag) OR x.tag = 'br' THEN chr(10) WHEN x.tag = 'pre' THEN chr(10) || '```' || chr(10) WHEN x.tag = 'code' THEN '`' WHEN x.tag IN ('strong', 'b') THEN '**' WHEN x.tag IN ('em', 'i') THEN '*' WHEN x.tag = 'li' THEN chr(10) || '- ' WHEN x.tag = 'tr' THEN chr(10) || '| ' ELSE '' END"
#: The innermost open element of the name that ends, from the front; 0 where there is none.
_AT = "coalesce(list_max(list_filter(range(1, len(s.stack) + 1), lambda i: s.stack[i] = x.tag)), 0)"
_ENDS = f"array_to_string(list_transform(range(len(s.stack), {_AT} - 1, -1), lambda i: CASE WHEN {_SEEN.format('s.stack[1:i]')} THEN '' ELSE list_transform([s.stack[i]], lambda t: {_CLOSED})[1] END), '')"
_FOLD = f"""struct_pack(kind := x.kind, tag := x.tag, text := x.text,
 stack := CASE WHEN x.kind = 'open' AND NOT list_contains({_VOID}, x.tag) THEN list_append(s.stack, x.tag) WHEN x.kind = 'close' AND {_AT} > 0 THEN s.stack[1:{_AT} - 1] ELSE s.stack END,
 out := s.out || CASE WHEN x.kind = 'open' THEN CASE WHEN {_SEEN.format('list_append(s.stack, x.tag)')} THEN '' ELSE {_OPENED} END WHEN x.kind = 'close' AND {_AT} > 0 THEN {_ENDS} WHEN x.kind = 'text' AND NOT {_SEEN.format('s.stack')} THEN CASE WHEN list_contains(s.stack, 'pre') THEN x.text ELSE trim(x.text, {_SPACE}) END ELSE '' END,
 hidden := greatest(0, s.hidden + CASE WHEN NOT list_contains(['script', 'style', 'nav', 'footer'], x.tag) THEN 0 WHEN x.kind = 'open' THEN 1 WHEN x.kind = 'close' THEN -1 ELSE 0 END),
 plain := CASE WHEN x.kind = 'text' AND s.hidden = 0 AND trim(x.text, {_SPACE}) <> '' THEN s.plain || CASE WHEN s.plain = '' THEN '' ELSE ' ' END || trim(x.text, {_SPACE}) ELSE s.plain END)"""
_PLAIN_TEXT = "replace(regexp_replace(regexp_replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), chr(0), '')"
_PAGES = f"""WITH k AS (SELECT page_id, html, list_transform(regexp_extract_all(html, '{_TOKEN}'), lambda t: struct_pack(kind := CASE WHEN regexp_matches(t, '(?is)^(<script|<style|<!)') THEN 'none' WHEN starts_with(t, '</') THEN 'close' WHEN starts_with(t, '<') THEN 'open' ELSE 'text' END,
 tag := CASE WHEN starts_with(t, '<') THEN lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1)) ELSE '' END, text := {_PLAIN_TEXT}, stack := []::VARCHAR[], out := '', hidden := 0, plain := '')) AS tokens FROM pages),
 f AS (SELECT page_id, html, list_reduce(list_prepend(struct_pack(kind := '', tag := '', text := '', stack := []::VARCHAR[], out := '', hidden := 0, plain := ''), tokens), lambda s, x: {_FOLD}) AS s FROM k) """


@query(_PAGES + f"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(s.out, '\n{{3,}}', chr(10) || chr(10), 'g'), {_SPACE}) AS markdown, s.plain AS plain FROM f""")
def html_markdown(spark, sf):
    """Web pages as markdown and as plain text; elements that a page leaves open end with the one around them."""
    return D.html_to_markdown(T.load(spark, sf, "pages").select("page_id", "html"), "page_id")


_KINDS = ("heading", "bullet", "ordered", "ordered", "code", "quote", "todo", "image", "divider", "text", "heading")


@query(f"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
 k AS (SELECT doc_id, pos, t, [{', '.join(f"'{k}'" for k in _KINDS)}][(pos + length(t)) % {len(_KINDS)} + 1] AS kind, 1 + (pos * 3 + length(t)) % 8 AS level FROM l),
 i AS (SELECT *, sum(CASE WHEN kind <> 'ordered' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM k),
 n AS (SELECT *, sum(CASE WHEN kind = 'ordered' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, island ORDER BY pos) AS n FROM i),
 m AS (SELECT doc_id, pos, CASE kind WHEN 'heading' THEN CASE WHEN level <= 6 THEN repeat('#', level::INT) || ' ' || t END WHEN 'bullet' THEN '- ' || t WHEN 'ordered' THEN n || '. ' || t WHEN 'code' THEN '```' || chr(10) || t || chr(10) || '```'
  WHEN 'quote' THEN '> ' || t WHEN 'todo' THEN CASE WHEN level = 1 THEN '- [x] ' ELSE '- [ ] ' END || t WHEN 'image' THEN '![' || CASE WHEN t = '' THEN 'image' ELSE t END || '](image/' || t || ')' WHEN 'divider' THEN '---' ELSE t END AS line FROM n)
 SELECT doc_id, string_agg(line, chr(10) || chr(10) ORDER BY pos) AS markdown FROM m WHERE line IS NOT NULL GROUP BY doc_id""")
def block_markdown(spark, sf):
    """Lines as blocks of every kind: headings of all levels, lists, code, quotes, tasks, images and dividers."""
    d = T.load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("pos") + F.length("text")) % len(_KINDS) + 1).cast("int"))
    return P.block_list_markdown(d.select("doc_id", "pos", kind.alias("kind"), (1 + (F.col("pos") * 3 + F.length("text")) % 8).alias("level"), "text"))


# -- evaluation -------------------------------------------------------------------------------------

_SAMPLES = """WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 25 = 0), n AS (SELECT q.vec_id, e.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.embedding::DOUBLE[]), e.vec_id) AS r, q.label = e.label AS hit
 FROM q, embeddings e), s AS (SELECT vec_id, count(*) FILTER (label_n) AS x FROM (SELECT vec_id, true AS label_n FROM q) GROUP BY 1), z AS (SELECT q.vec_id, (SELECT count(*) FROM embeddings e WHERE e.label = q.label) AS expected FROM q), """


def _measured(spark, sf):
    """Queries by vector: the ten nearest are retrieved, vectors of the same label are relevant."""
    e = T.load(spark, sf, "embeddings")
    q = e.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("asked"))
    v = e.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    near = knn(q, v, 10).join(q.select("query_id", "asked"), "query_id").join(e.select(F.col("vec_id").alias("ord"), "label"), "ord")
    per_label = e.groupBy(F.col("label").alias("asked")).agg(F.count("*").alias("n"))
    return E.ranked_metrics(near.select("query_id", "rank", (F.col("label") == F.col("asked")).alias("hit")), q.select("query_id", "asked").join(per_label, "asked").select("query_id", "n"), 5)


@query(_SAMPLES + """m AS (SELECT n.vec_id, count(*) FILTER (hit AND r <= 5) AS h5, min(r) FILTER (hit AND r <= 10) AS first, sum(CASE WHEN hit AND r <= 5 THEN 1 / log2(r + 1) ELSE 0 END) AS dcg FROM n GROUP BY 1)
 SELECT vec_id AS query_id, h5 / 5.0 AS precision, round(h5 / expected, 9) AS recall, round(coalesce(1.0 / first, 0), 9) AS mrr, round(dcg / list_sum(list_transform(range(1, least(5, expected)::INT + 1), lambda i: 1 / log2(i + 1))), 9) AS ndcg,
 CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit_rate FROM m JOIN z USING (vec_id)""")
def retrieval_metrics(spark, sf):
    s = _measured(spark, sf)
    return s.select("query_id", "precision", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "ndcg")], "hit_rate")


@query(_SAMPLES + """m AS (SELECT n.vec_id, count(*) FILTER (hit AND r <= 5) AS h5, min(r) FILTER (hit AND r <= 10) AS first FROM n GROUP BY 1)
 SELECT count(*) AS samples, 'mrr' AS metric, round(avg(coalesce(1.0 / first, 0)), 9) AS value FROM m UNION ALL SELECT count(*), 'precision', round(avg(h5 / 5.0), 9) FROM m""")
def evaluation_report(spark, sf):
    return E.report(_measured(spark, sf), ["precision", "mrr"]).withColumn("value", F.round("value", 9))


@query("""WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT q.vec_id, e.vec_id AS doc, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.embedding::DOUBLE[]), e.vec_id) AS r FROM q, embeddings e),
 m AS (SELECT vec_id, count(*) FILTER (hit AND r <= 5) AS h5, min(r) FILTER (hit) AS first, sum(CASE WHEN hit AND r <= 5 THEN 1 / log2(r + 1) ELSE 0 END) AS dcg FROM (SELECT *, doc >= vec_id AND doc < vec_id + 4 AS hit FROM n WHERE r <= 10) GROUP BY 1)
 SELECT vec_id AS query_id, h5 / 5.0 AS precision, h5 / 4.0 AS recall, round(coalesce(1.0 / first, 0), 9) AS mrr, round(dcg / (1 + 1 / log2(3) + 0.5 + 1 / log2(5)), 9) AS ndcg, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit_rate FROM m""")
def sample_metrics(spark, sf):
    """Samples with arrays: the query's own id and the three after it are relevant."""
    e = T.load(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    v = e.select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    near = knn(q, v, 10).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x.id).alias("retrieved_docs"))
    expected = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (F.col("query_id") + k).cast("string"))
    s = E.retrieval_metrics(near.withColumn("expected_docs", expected), 5)
    return s.select("query_id", "precision", "recall", *[F.round(c, 9).alias(c) for c in ("mrr", "ndcg")], "hit_rate")


def _turns(spark, sf):
    """User turns with the assistant's answer to each and the user's next turn as the truth."""
    c = T.load(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "turn", "role", F.col("text").alias("query"), F.lead("text", 1, "").over(w).alias("generated_answer"), F.lead("text", 2, "").over(w).alias("ground_truth"))
    return rows.withColumn("retrieved_texts", F.array("query", "ground_truth"))


_TURNS = "WITH t AS (SELECT conv_id, turn, text AS q, coalesce(lead(text, 1) OVER w, '') AS a, coalesce(lead(text, 2) OVER w, '') AS g FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), k AS (SELECT conv_id, turn, {q} AS q, {a} AS a, {g} AS g FROM t)".format(q=tokens_sql("q"), a=tokens_sql("a"), g=tokens_sql("g"))


@query(_TURNS + """, s AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(g))) AS shared, len(list_distinct(a)) AS na, len(list_distinct(g)) AS ng FROM k)
 SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_filter(a, lambda w: list_contains(q, w) OR list_contains(g, w))) / len(a), 9) END AS faithfulness,
 CASE WHEN len(a) = 0 THEN 0 ELSE round(len(list_filter(a, lambda w: list_contains(q, w))) / len(a), 9) END AS relevancy,
 CASE WHEN shared = 0 THEN 0 ELSE round(2.0 * (shared / na) * (shared / ng) / (shared / na + shared / ng), 9) END AS correctness FROM s""")
def answer_metrics(spark, sf):
    s = E.answer_metrics(_turns(spark, sf))
    return s.select("conv_id", "turn", *[F.round(c, 9).alias(c) for c in ("faithfulness", "relevancy", "correctness")])


@query("""WITH r AS (SELECT event_id AS seq, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value > 20)
 SELECT seq, 'user ' || CAST(user_id AS VARCHAR) AS query, CAST(floor(value) % 4 + 1 AS INTEGER) AS retrieved, CAST((CAST(floor(value) AS BIGINT) % 4 + 2) // 2 AS INTEGER) AS expected FROM r WHERE n = 1 ORDER BY seq LIMIT 100""")
def recorded_dataset(spark, sf):
    """Recordings made of events; a judge takes every other document."""
    e = T.load(spark, sf, "events").where("value > 20")
    n = (F.floor("value") % 4 + 1).cast("int")
    rec = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user "), "user_id").alias("query"), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d"), i)).alias("retrieved_uris"))
    d = E.dataset_from_recordings(rec, 100, lambda u: F.substring(u, 2, 9).cast("int") % 2 == 1)
    return d.select("seq", "query", F.size("retrieved_uris").alias("retrieved"), F.size("expected_docs").alias("expected"))


# -- memories ---------------------------------------------------------------------------------------


@query("SELECT user_id, arg_max(event_type, event_id) AS last_kind, arg_min(event_type, event_id) AS first_kind, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def merge_fields(spark, sf):
    e = T.load(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("last_kind"), F.col("event_type").alias("first_kind"), F.col("value").cast("string").alias("total"))
    return M.fold_fields(e, "user_id", "event_id", {"last_kind": "patch", "first_kind": "immutable", "total": "sum"}).withColumn("total", F.round("total", 4))


@query("SELECT user_id, string_agg(event_type, chr(10) ORDER BY event_id) AS text FROM events GROUP BY user_id")
def merge_blocks(spark, sf):
    """Each event appends its type by a block with an empty search."""
    e = T.load(spark, sf, "events")
    patch = F.concat(F.lit("<<<<<<< SEARCH\n\n=======\n"), F.col("event_type"), F.lit("\n>>>>>>> REPLACE"))
    return M.fold_text(e.select("user_id", "event_id", patch.alias("text")), "user_id", "event_id", "text")


@query("""WITH a AS (SELECT conv_id, turn, 'm' || CAST(turn % 3 AS VARCHAR) AS uri, CASE WHEN role = 'assistant' THEN 'merge' ELSE 'delete' END AS action, turn AS n FROM conversations),
 u AS (SELECT conv_id, uri, list_reduce(list_prepend('', list(action ORDER BY n)), lambda s, x: CASE WHEN s = '' THEN x WHEN s = x THEN s ELSE '' END) AS action FROM a GROUP BY conv_id, uri),
 c AS (SELECT DISTINCT conv_id AS candidate, CASE conv_id % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'create' WHEN 2 THEN 'none' ELSE 'create' END AS d FROM conversations),
 j AS (SELECT candidate, d, count(*) FILTER (action = 'merge') AS merges, count(*) FILTER (action = 'delete') AS deletes FROM c LEFT JOIN u ON u.conv_id = candidate GROUP BY ALL)
 SELECT candidate, CASE WHEN d = 'create' AND merges > 0 THEN 'none' ELSE d END AS decision, CASE WHEN d = 'skip' THEN 0 ELSE merges END AS merges, CASE WHEN d = 'skip' THEN 0 ELSE deletes END AS deletes FROM j""")
def dedup_decisions(spark, sf):
    c = T.load(spark, sf, "conversations")
    word = F.element_at(F.array(*map(F.lit, ("skip", "create", "none", "odd word"))), (F.col("candidate") % 4 + 1).cast("int"))
    decisions = c.select(F.col("conv_id").alias("candidate")).distinct().withColumn("decision", word)
    actions = c.select(F.col("conv_id").alias("candidate"), F.col("turn").alias("pos"), F.concat(F.lit("m"), F.col("turn") % 3).alias("uri"), F.when(F.col("role") == "assistant", "Merge ").otherwise("delete").alias("action"))
    out = M.decide(decisions, actions)
    n = lambda a: F.size(F.filter("actions", lambda x: x.action == a)).cast("long")
    return out.select("candidate", "decision", n("merge").alias("merges"), n("delete").alias("deletes"))


_AGE = f"epoch(TIMESTAMP '{AS_OF}' + INTERVAL 20 DAY - updated_at) / 86400.0"


@query(_M + f"""SELECT id, round(s, 9) AS score, regexp_replace(uri, '/memories/', '/memories/_archive/') AS archive_uri FROM (SELECT *, 1 / (1 + exp(-ln(1 + active_count))) * pow(2.0, -greatest({_AGE}, 0) / 7.0) AS s, {_AGE} AS age FROM memories) WHERE s < 0.1 AND NOT (age < 90 AND s > 0.05)""")
def archive_cold(spark, sf):
    when = as_of() + F.expr("interval 20 days")
    return M.archive_candidates(T.memory_contexts(spark, sf), when).select("id", F.round("score", 9).alias("score"), "archive_uri")


@query(_M + "SELECT id, uri, CAST(active_count + CASE WHEN category = 'cases' THEN 1 ELSE 0 END AS BIGINT) AS active_count FROM memories")
def restore_archived(spark, sf):
    """The memories of one category are archived and brought back."""
    c = T.memory_contexts(spark, sf)
    moved = c.where("category = 'cases'").withColumn("uri", F.regexp_replace("uri", "/memories/", "/memories/_archive/"))
    table = c.where("category <> 'cases'").unionByName(moved)
    return M.restore(table, moved.select("uri"), as_of()).select("id", "uri", "active_count")


@query("""SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (value < 100) AS success, count(*) FILTER (value >= 100) AS failure, CAST(sum(CAST(round(value) AS BIGINT)) AS BIGINT) AS total_ms,
 strftime(arg_max(ts, event_id), '%Y-%m-%d %H:%M:%S') AS last_used FROM events GROUP BY 1""")
def tool_statistics(spark, sf):
    e = T.load(spark, sf, "events")
    ok = F.col("value") < 100
    s = e.select(F.col("event_type").alias("tool"), F.lit(1).cast("long").alias("calls"), ok.cast("long").alias("success"), (~ok).cast("long").alias("failure"), F.round("value").cast("long").alias("total_ms"), F.col("ts").alias("last_used"), F.col("event_id").alias("seq"))
    return M.merge_tool_stats(s).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS guidelines FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def guideline_merge(spark, sf):
    g = M.merge_guidelines(T.load(spark, sf, "events"), "user_id", "event_type", "event_id")
    return g.select("user_id", F.array_join("guidelines", ",").alias("guidelines"))


@query("""SELECT user_id, event_type, '<!-- MEMORY_FIELDS {"kind":"' || event_type || '","n":' || CAST(n AS VARCHAR) || '} -->' || chr(10) || 'body' AS file, n, 'body' AS body FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)""")
def memory_files(spark, sf):
    g = T.load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    f = g.withColumn("file", M.to_file(F.struct(F.col("event_type").alias("kind"), "n"), F.lit("body")))
    fields, body = M.from_file(F.col("file"), "struct<kind:string,n:bigint>")
    return f.select("user_id", "event_type", "file", fields["n"].alias("n"), body.alias("body"))


_TALK = "SELECT conv_id AS session_id, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS t FROM conversations WHERE text <> '' GROUP BY 1"


@query(f"""SELECT session_id, CAST(0 AS INTEGER) AS pos, CASE WHEN length(t) % 2 = 0 THEN 'events' ELSE 'patterns' END AS category, t AS abstract FROM ({_TALK})""")
def candidate_parse(spark, sf):
    """A stand-in for a model answers with the talk as fenced JSON; unknown categories become patterns."""

    def answer(t: str) -> str:
        memory = {"category": "events" if len(t) % 2 == 0 else "odd {", "abstract": t, "content": "x"}
        return f"Sure:\n```json\n{json.dumps({'memories': [memory]})}\n```"

    return M.extract_memories(S.transcripts(T.messages(spark, sf)), answer).select("session_id", "pos", "category", "abstract")


@query(f"""SELECT session_id, CAST(0 AS INTEGER) AS pos, t AS query, CASE WHEN length(t) % 3 = 0 THEN 'memory' ELSE 'resource' END AS context_type, CAST(greatest(1, least(5, length(t) % 8)) AS INTEGER) AS priority FROM ({_TALK})""")
def query_plans(spark, sf):
    """A stand-in for a model plans one typed query a talk; odd types become resource, priorities 1 to 5."""
    t = S.transcripts(T.messages(spark, sf))
    plan = F.struct(F.col("text").alias("query"), F.when(F.length("text") % 3 == 0, "memory").otherwise("thing").alias("context_type"), (F.length("text") % 8).alias("priority"))
    answers = t.select("session_id", F.concat(F.lit("Plan: "), F.to_json(F.struct(F.array(plan).alias("queries")))).alias("answer"))
    return M.parse_query_plan(answers)


@query("""WITH q AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT q.vec_id AS query_id, q.label AS asked, e.vec_id, e.label, list_distance(q.v, e.embedding::DOUBLE[]) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, e.embedding::DOUBLE[]), e.vec_id) AS r FROM q, embeddings e)
 SELECT query_id, 'v' || CAST(vec_id AS VARCHAR) AS id, round(1 - d, 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INTEGER) AS place FROM n WHERE r <= 50 AND label = asked AND asked % 2 = 0 AND vec_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) <= 10""")
def similar_memories(spark, sf):
    """Vectors as memories: their label tells the category, even ids belong to the asking user; odd labels ask nothing."""
    e = T.load(spark, sf, "embeddings")
    prefix = F.when(F.col("label") % 2 == 0, F.concat(F.lit("ctx://user/u/memories/c"), "label", F.lit("/"))).otherwise("")
    asks = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), prefix.alias("prefix"), F.lit("u").alias("owner_space"))
    vectors = e.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"))
    rows = e.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.concat(F.lit("ctx://user/u/memories/c"), "label", F.lit("/"), "vec_id").alias("uri"), F.when(F.col("vec_id") % 2 == 0, "u").otherwise("w").alias("owner_space"))
    return M.similar_memories(asks, vectors, rows).withColumn("score", F.round("score", 9))


@query(f"""SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS source, 2 AS level, substr(text, 1, 2000) AS embedded, substr(text, 1, 500) AS abstract FROM documents WHERE trim(text, {_TRIM}) <> ''""")
def index_files(spark, sf):
    rows = I.file_rows(T.docs(spark, sf).select(F.col("id").alias("source"), "uri", "content"))
    return rows.select("source", "level", F.col("vectorize_text").alias("embedded"), "abstract")


_LISTED = f"""WITH d AS (SELECT doc_id, text, 'ctx://resources/' || lang || '/' || source AS dir FROM documents), p AS (SELECT dir, count(*) AS n FROM d GROUP BY 1),
 f AS (SELECT dir || '/' || CASE WHEN doc_id % 9 = 0 THEN '.' ELSE '' END || CAST(doc_id AS VARCHAR) AS uri, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE text END AS content, doc_id % 9 = 0 AS hidden FROM d), g AS (SELECT *, trim(content, {_TRIM}) = '' AS blank FROM f) """


def _listing(spark, sf):
    """Documents as files, some hidden, some blank, and the level files of each directory."""
    d = T.docs(spark, sf)
    i = F.col("doc_id")
    name = F.concat("parent_uri", F.lit("/"), F.when(i % 9 == 0, ".").otherwise(""), i.cast("string"))
    files = d.select(F.lit("scan").alias("source"), name.alias("uri"), F.when(i % 7 == 0, " ").otherwise(F.col("content")).alias("content"))
    counts = d.groupBy("parent_uri").agg(F.count("*").cast("string").alias("n"))
    level = lambda name, text: counts.select(F.lit("scan").alias("source"), F.concat("parent_uri", F.lit("/" + name)).alias("uri"), F.concat("n", F.lit(text)).alias("content"))
    return files.unionByName(level(".abstract.md", " files")).unionByName(level(".overview.md", " files in all"))


@query(_LISTED + """SELECT uri, 2 AS level, 'resource' AS context_type, substr(content, 1, 500) AS abstract, substr(content, 1, 2000) AS embedded, 64 AS dim FROM g WHERE NOT hidden AND NOT blank
 UNION ALL SELECT dir, 0, 'resource', CAST(n AS VARCHAR) || ' files', CAST(n AS VARCHAR) || ' files', 64 FROM p
 UNION ALL SELECT dir, 1, 'resource', CAST(n AS VARCHAR) || ' files', CAST(n AS VARCHAR) || ' files in all', 64 FROM p""")
def index_tree(spark, sf):
    rows = I.index_tree(_listing(spark, sf), "ctx://resources")[0]
    return rows.select("uri", "level", "context_type", "abstract", F.col("vectorize_text").alias("embedded"), F.size("vector").alias("dim"))


@query(_LISTED + """SELECT uri, CASE WHEN hidden THEN 'hidden' ELSE 'blank' END AS reason FROM g WHERE hidden OR blank""")
def index_passed_over(spark, sf):
    return I.index_tree(_listing(spark, sf), "ctx://resources")[1]


def _flaky(texts):
    """A service that refuses some texts, is never there for others, and for some only at the third try."""
    for t in texts:
        sign = hashlib.md5(t.encode()).hexdigest()[0]
        if sign == "0":
            raise ValueError("400 bad input")
        if sign == "a":
            raise ConnectionError("503 not now")
        if sign == "b" and _TRIED.setdefault(t, 0) < 2:
            _TRIED[t] += 1
            raise TimeoutError("timeout")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


_TRIED: dict[str, int] = {}


@query("""SELECT doc_id, CASE WHEN md5(text)[1] NOT IN ('0', 'a') THEN CAST(length(text) AS DOUBLE) END AS signs, CASE WHEN md5(text)[1] NOT IN ('0', 'a') THEN CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) END AS spaces,
 CASE md5(text)[1] WHEN '0' THEN 'ValueError: 400 bad input' WHEN 'a' THEN 'ConnectionError: 503 not now' END AS error, CASE md5(text)[1] WHEN '0' THEN 'permanent' WHEN 'a' THEN 'transient' END AS error_class FROM documents""")
def embedding_outcomes(spark, sf):
    """Documents embedded by a service that fails; rows that it won't take are dead letters."""
    rows = T.load(spark, sf, "documents").select("doc_id", "text")
    done, dead = B.embedded_and_dead(rows, _flaky, "text", B.Limits(batch=8, tries=3, base=0.001))
    number = lambda k: F.col("vector")[k].cast("double")
    none = F.lit(None)
    return done.select("doc_id", number(0).alias("signs"), number(1).alias("spaces"), none.cast("string").alias("error"), none.cast("string").alias("error_class")).union(
        dead.select("doc_id", none.cast("double"), none.cast("double"), "error", "error_class")
    )
