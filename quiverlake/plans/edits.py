"""Queries of edits to files: a model's operations, and logs of file operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.operators import edits as X
from quiverlake.operators import memory as M
from quiverlake.operators import replay as R
from quiverlake.operators import rounds as O
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T

_PROFILE: dict[str, X.Schema] = {"profile": {"content": ("string", "patch"), "name": ("string", "immutable"), "visits": ("int64", "sum")}}


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _asked(spark, sf):
    """Events as operations on a file of their user, a batch a day."""
    e = T.load(spark, sf, "events").withColumn("k", _k())
    kind = F.col("event_type")
    gone = (kind == "error") & (F.col("k") % 3 == 0)
    phase = F.when(kind == "signup", "write").when(kind == "purchase", "overview").when(gone, "delete").otherwise("edit")
    say = lambda text: F.format_string(text.replace("$k", "%1$d").replace("$e", "%2$d"), "k", "event_id")
    fields = (
        F.when((kind == "signup") & (F.col("k") % 7 == 6), F.lit("{bad"))
        .when(kind == "signup", say('{"name": "n<$k>", "visits": 1, "other": "x"}'))
        .when((kind == "purchase") & (F.col("k") % 5 == 4), F.lit("{}"))
        .when((kind == "purchase") & (F.col("k") % 2 == 1), say('{"overview": {"blocks": [{"search": "", "replace": "o$k"}]}}'))
        .when(kind == "purchase", say('{"overview": "o$k"}'))
        .when(kind == "view", say('{"content": "note $k", "name": "zz"}'))
        .otherwise(say('{"name": "m$k", "visits": $k, "content": {"blocks": [{"search": "v$k", "replace": "w$k"}, {"search": "", "replace": "+$e"}]}}'))
    )
    content = F.when(kind == "signup", say("v$k start")).otherwise(say("fresh $k"))
    return e.select(
        F.datediff("ts", F.lit("2024-01-01")).alias("batch"), phase.alias("phase"), F.col("event_id").alias("seq"), F.format_string("user/%d.md", "user_id").alias("uri"),
        F.when(kind == "view", "note").otherwise("profile").alias("memory_type"), content.alias("content"), fields.alias("fields"))


_BLOCKS = """'{"blocks":[{"replace":"w' || x.k || '","search":"v' || x.k || '"},{"replace":"+' || x.e || '","search":""}]}'"""
_FIRST = "CASE WHEN strpos(s.text, 'v' || x.k) > 0 THEN substr(s.text, 1, strpos(s.text, 'v' || x.k) - 1) || 'w' || x.k || substr(s.text, strpos(s.text, 'v' || x.k) + length('v' || x.k)) ELSE s.text END"
_ADDED = f"CASE WHEN ({_FIRST}) = '' THEN '+' || x.e ELSE ({_FIRST}) || chr(10) || '+' || x.e END"
_NEXT = f"""struct_pack(op := x.op, k := x.k, e := x.e,
 ex := CASE x.op WHEN 'delete' THEN false WHEN 'bad' THEN s.ex WHEN 'none' THEN s.ex ELSE true END,
 name := CASE x.op WHEN 'delete' THEN NULL WHEN 'write' THEN 'n\\u003c' || x.k || '\\u003e' WHEN 'put' THEN NULL WHEN 'note' THEN CASE WHEN s.ex THEN s.name END WHEN 'edit' THEN coalesce(s.name, 'm' || x.k) ELSE s.name END,
 visits := CASE x.op WHEN 'delete' THEN NULL WHEN 'write' THEN 1 WHEN 'put' THEN NULL WHEN 'note' THEN CASE WHEN s.ex THEN s.visits END WHEN 'edit' THEN coalesce(s.visits, 0) + x.k ELSE s.visits END,
 mc := CASE x.op WHEN 'delete' THEN NULL WHEN 'write' THEN NULL WHEN 'put' THEN NULL WHEN 'note' THEN CASE WHEN s.ex THEN s.mc END WHEN 'edit' THEN CASE WHEN s.ex THEN s.mc ELSE {_BLOCKS} END ELSE s.mc END,
 text := CASE x.op WHEN 'delete' THEN '' WHEN 'write' THEN 'v' || x.k || ' start' WHEN 'put' THEN 'o' || x.k
  WHEN 'add' THEN CASE WHEN NOT s.ex OR s.text = '' AND s.name IS NULL THEN 'o' || x.k ELSE s.text || chr(10) || 'o' || x.k END
  WHEN 'note' THEN CASE WHEN s.ex THEN 'note ' || x.k ELSE 'fresh ' || x.k END WHEN 'edit' THEN CASE WHEN s.ex THEN {_ADDED} ELSE 'fresh ' || x.k END ELSE s.text END)"""


@query(f"""WITH o AS (SELECT 'user/' || user_id || '.md' AS uri, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch, event_id AS seq, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
 p AS (SELECT *, CASE WHEN t = 'signup' THEN 'write' WHEN t = 'purchase' THEN 'overview' WHEN t = 'error' AND k % 3 = 0 THEN 'delete' ELSE 'edit' END AS phase,
  CASE WHEN t = 'signup' AND k % 7 = 6 THEN 'bad' WHEN t = 'signup' THEN 'write' WHEN t = 'purchase' AND k % 5 = 4 THEN 'none' WHEN t = 'purchase' AND k % 2 = 1 THEN 'add' WHEN t = 'purchase' THEN 'put' WHEN t = 'error' AND k % 3 = 0 THEN 'delete' WHEN t = 'view' THEN 'note' ELSE 'edit' END AS op FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY batch, CASE phase WHEN 'write' THEN 1 WHEN 'edit' THEN 2 WHEN 'overview' THEN 3 ELSE 4 END, seq) AS n FROM p),
 f AS (SELECT 'user/' || c_custkey || '.md' AS uri, c_name AS text FROM customer),
 y AS (SELECT r.*, coalesce(last_value(CASE WHEN op NOT IN ('bad', 'none') THEN op <> 'delete' END IGNORE NULLS) OVER (PARTITION BY r.uri ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f.uri IS NOT NULL) AS there FROM r LEFT JOIN f ON f.uri = r.uri),
 h AS (SELECT uri, list(struct_pack(op := op, k := k, e := seq, ex := false, name := NULL::VARCHAR, visits := NULL::INTEGER, mc := NULL::VARCHAR, text := '') ORDER BY n) AS ops FROM r GROUP BY uri),
 z AS (SELECT coalesce(h.uri, f.uri) AS uri, list_reduce(list_prepend(struct_pack(op := '', k := 0, e := 0::BIGINT, ex := f.uri IS NOT NULL, name := NULL::VARCHAR, visits := NULL::INTEGER, mc := NULL::VARCHAR, text := coalesce(f.text, '')), coalesce(h.ops, [])), lambda s, x: {_NEXT}) AS s FROM f FULL JOIN h ON h.uri = f.uri)
 SELECT uri, batch, phase, seq, CASE WHEN op = 'bad' OR op = 'delete' AND NOT there THEN 'failed' WHEN phase = 'write' THEN 'written' WHEN phase = 'delete' THEN 'deleted' ELSE 'edited' END AS outcome,
 CASE WHEN op = 'bad' THEN 'fields are no JSON object' WHEN op = 'delete' AND NOT there THEN 'no such file' END AS message, NULL AS content FROM y
 UNION ALL SELECT uri, NULL, 'file', NULL, 'kept', NULL, CASE WHEN s.name IS NULL THEN s.text ELSE '<!-- MEMORY_FIELDS {{' || CASE WHEN s.mc IS NULL THEN '' ELSE '"content":' || s.mc || ',' END || '"name":"' || s.name || '","visits":' || s.visits || '}} -->' || chr(10) || s.text END FROM z WHERE s.ex""")
def apply_operations(spark, sf):
    """Edits of a model on files of users: outcome of every operation, and the files at the end."""
    c = T.load(spark, sf, "customer")
    files = c.select(F.format_string("user/%d.md", "c_custkey").alias("uri"), F.col("c_name").alias("content"))
    return X.apply_operations(files, _asked(spark, sf), _PROFILE)


# -- logs of file operations ------------------------------------------------------------------------

#: Operations made from events; e is the event, u its user, k its number, t its kind.
_LOG_SQL = """l AS (SELECT event_id AS seq, CASE WHEN t = 'purchase' AND k % 10 = 0 THEN 'mv' WHEN t = 'purchase' AND k % 10 = 3 THEN 'mkdir' WHEN t = 'error' AND k % 10 = 1 THEN 'rm' WHEN t IN ('click', 'view') THEN 'write' ELSE 'append' END AS op,
 CASE WHEN t = 'purchase' AND k % 10 = 3 THEN 'd' || u % 6 || '/new' || e % 5 WHEN (t = 'purchase' AND k % 10 = 0 OR t = 'error' AND k % 10 = 1) AND e % 11 = 0 THEN 'd' || u % 6
  WHEN (t = 'purchase' AND k % 10 = 0 OR t = 'error' AND k % 10 = 1) AND e % 2 = 0 THEN 'd' || u % 6 || '/s' || e % 5 ELSE 'd' || u % 6 || '/s' || e % 5 || '/f' || u % 4 || '.md' END AS path,
 CASE WHEN t = 'purchase' AND k % 10 = 0 THEN CASE WHEN e % 11 = 0 THEN 'd' || k % 7 WHEN e % 2 = 0 THEN 'd' || (u + 1) % 6 || '/s' || e % 3 ELSE 'd' || k % 3 || '/deep/x/f' || e % 4 || '.md' END ELSE '' END AS target,
 'e' || e || ';' AS content FROM (SELECT event_id, event_id AS e, user_id AS u, event_type AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def _log(spark, sf):
    e = T.load(spark, sf, "events").select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), _k().alias("k"))
    return e.selectExpr(
        "e AS seq",
        "CASE WHEN t = 'purchase' AND k % 10 = 0 THEN 'mv' WHEN t = 'purchase' AND k % 10 = 3 THEN 'mkdir' WHEN t = 'error' AND k % 10 = 1 THEN 'rm' WHEN t IN ('click', 'view') THEN 'write' ELSE 'append' END AS op",
        """concat('d', u % 6, CASE WHEN t = 'purchase' AND k % 10 = 3 THEN concat('/new', e % 5) WHEN (t = 'purchase' AND k % 10 = 0 OR t = 'error' AND k % 10 = 1) AND e % 11 = 0 THEN ''
         WHEN (t = 'purchase' AND k % 10 = 0 OR t = 'error' AND k % 10 = 1) AND e % 2 = 0 THEN concat('/s', e % 5) ELSE concat('/s', e % 5, '/f', u % 4, '.md') END) AS path""",
        "CASE WHEN t = 'purchase' AND k % 10 = 0 THEN CASE WHEN e % 11 = 0 THEN concat('d', k % 7) WHEN e % 2 = 0 THEN concat('d', (u + 1) % 6, '/s', e % 3) ELSE concat('d', k % 3, '/deep/x/f', e % 4, '.md') END ELSE '' END AS target",
        "concat('e', e, ';') AS content",
    )


_REPLAY_SQL = f"""WITH RECURSIVE {_LOG_SQL},
 r AS MATERIALIZED (SELECT seq, 0 AS gone, path, target FROM l WHERE op = 'mv' AND path <> target UNION ALL SELECT seq, 1, target, NULL FROM l WHERE op = 'mv' AND path <> target UNION ALL SELECT seq, 1, path, NULL FROM l WHERE op = 'rm'),
 w AS (SELECT path, seq AS t, op, content FROM l WHERE op IN ('write', 'append')),
 n AS (SELECT path AS p, seq AS t, false AS own FROM l WHERE op IN ('write', 'append') UNION ALL SELECT path, seq, true FROM l WHERE op = 'mkdir' UNION ALL SELECT target, seq, false FROM l WHERE op = 'mv'),
 f AS (SELECT DISTINCT array_to_string(string_split(p, '/')[1:i], '/') AS path, t FROM (SELECT p, t, unnest(range(1, len(string_split(p, '/')) + CASE WHEN own THEN 1 ELSE 0 END)) AS i FROM n)),
 s AS (SELECT path, t FROM w UNION SELECT path, t FROM f),
 z AS (SELECT path AS p0, t AS t0, path, t, 0 AS gone FROM s
  UNION ALL SELECT p0, t0, CASE WHEN x.gone = 0 THEN x.target || substr(z.path, length(x.path) + 1) ELSE z.path END, x.seq, x.gone FROM z JOIN r x ON x.seq > z.t AND (z.path = x.path OR starts_with(z.path, x.path || '/')) WHERE z.gone = 0
  QUALIFY row_number() OVER (PARTITION BY p0, t0 ORDER BY x.seq, x.gone) = 1),
 e AS MATERIALIZED (SELECT p0, t0, path FROM (SELECT *, row_number() OVER (PARTITION BY p0, t0 ORDER BY t DESC) AS k FROM z) WHERE k = 1 AND gone = 0),
 c AS (SELECT e.path, w.t, w.op, w.content, max(CASE WHEN op = 'write' THEN w.t END) OVER (PARTITION BY e.path) AS last FROM w JOIN e ON w.path = e.p0 AND w.t = e.t0),
 tree AS (SELECT path, 'file' AS kind, string_agg(content, '' ORDER BY t) AS content FROM c WHERE t >= coalesce(last, t) GROUP BY path UNION ALL SELECT DISTINCT e.path, 'directory', NULL FROM f JOIN e ON f.path = e.p0 AND f.t = e.t0)"""


@query(f"{_REPLAY_SQL} SELECT * FROM tree")
def replayed_tree(spark, sf):
    """Files and directories that a log of writes, appends, removals and moves of subtrees leaves."""
    return R.replay(_log(spark, sf))


@query(f"""{_REPLAY_SQL}, b AS (SELECT 'd' || user_id % 6 || '/s' || event_id % 5 || '/f' || user_id % 4 || '.md' AS path, min('e' || event_id || ';') AS content FROM events WHERE event_type = 'view' GROUP BY 1),
 a AS (SELECT path, content FROM tree WHERE kind = 'file')
 SELECT 'ctx://log/' || coalesce(a.path, b.path) AS uri, CASE WHEN a.path IS NULL THEN 'removed' WHEN b.path IS NULL THEN 'added' ELSE 'changed' END AS status, substr(a.content, 1, 500) AS abstract FROM a FULL JOIN b ON a.path = b.path WHERE a.content IS DISTINCT FROM b.content""")
def replayed_contexts(spark, sf):
    """Context rows to write and to drop where the replayed tree differs from an older listing."""
    e = T.load(spark, sf, "events").where("event_type = 'view'")
    before = e.groupBy(F.expr("concat('d', user_id % 6, '/s', event_id % 5, '/f', user_id % 4, '.md')").alias("path")).agg(F.min(F.concat(F.lit("e"), "event_id", F.lit(";"))).alias("content"))
    rows, gone = R.changed_contexts(before, R.replay(_log(spark, sf)).where("kind = 'file'").select("path", "content"), "ctx://log")
    return rows.select("uri", F.col("source").alias("status"), "abstract").union(gone.select("uri", F.lit("removed").alias("status"), F.lit(None).cast("string").alias("abstract")))


# -- rounds of a model and a table --------------------------------------------------------------------


def _stand_in(messages, r):
    """A model that is none: what it asks for and says follows from lengths."""
    talk, last = F.get(messages, F.lit(0)).content, F.try_element_at(messages, F.lit(-1)).content
    n, turns = F.length(talk), F.size(messages)
    body = F.regexp_replace(last, r"^\[tool_result:\w+\] ", "")
    read = lambda k: F.struct(F.lit("read").alias("name"), F.format_string("ctx://user/%d.md", k).alias("uri"))
    none = F.array().cast("array<struct<name: string, uri: string>>")
    say = lambda calls, content: F.struct(calls.alias("calls"), content.alias("content"))
    write = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("ctx://notes/"), F.md5(talk)).alias("uri"), F.concat(n, F.lit(" "), body).alias("content"))).alias("write_ops")))
    drop = F.to_json(F.struct(F.array(F.format_string("ctx://user/%d.md", n % 1700)).alias("delete_uris")))
    if r == 0:
        first = F.array(F.struct(F.lit("ls").alias("name"), F.format_string("ctx://part/%d", n % 9).alias("uri")), read(n % 1700))
        return F.when(n % 5 == 0, say(none, F.lit("no answer yet"))).otherwise(say(first, F.lit("let me look")))
    if r == 1:
        return F.when(turns == 1, say(none, drop)).when(F.startswith(body, F.lit("error")), say(none, write)).otherwise(say(F.array(read(F.length(body) * 7 % 1700)), F.lit("")))
    return F.when(n % 3 == 0, say(none, F.lit("garbage"))).otherwise(say(none, write))


@query("""WITH s AS (SELECT conv_id AS batch, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS talk FROM conversations GROUP BY 1),
 f AS (SELECT 'ctx://user/' || c_custkey || '.md' AS uri, c_name || repeat('x', CAST(c_custkey % 50 AS INTEGER)) AS content FROM customer),
 a AS (SELECT batch, talk, length(talk) AS n, content AS one FROM s LEFT JOIN f ON f.uri = 'ctx://user/' || (length(talk) % 1700) || '.md'),
 b AS (SELECT batch, talk, n, one, f.content AS two FROM a LEFT JOIN f ON f.uri = 'ctx://user/' || (length(one) * 7 % 1700) || '.md'),
 o AS (SELECT batch, 'delete' AS phase, 'ctx://user/' || (n % 1700) || '.md' AS uri, NULL AS content FROM b WHERE n % 5 = 0
  UNION ALL SELECT batch, 'write', 'ctx://notes/' || md5(talk), n || ' ' || CASE WHEN one IS NULL THEN 'error: no such file' ELSE coalesce(two, 'error: no such file') END FROM b WHERE n % 5 <> 0 AND (one IS NULL OR n % 3 <> 0)),
 r AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY batch) AS k FROM o)
 SELECT r.uri, batch, phase, 0::BIGINT AS seq, CASE WHEN phase = 'write' THEN 'written' WHEN f.uri IS NULL OR k > 1 THEN 'failed' ELSE 'deleted' END AS outcome, CASE WHEN phase = 'delete' AND (f.uri IS NULL OR k > 1) THEN 'no such file' END AS message, NULL AS content FROM r LEFT JOIN f ON f.uri = r.uri
 UNION ALL SELECT uri, NULL, 'file', NULL, 'kept', NULL, content FROM f WHERE uri NOT IN (SELECT uri FROM o)
 UNION ALL SELECT uri, NULL, 'file', NULL, 'kept', NULL, max_by(content, batch) FROM o WHERE phase = 'write' GROUP BY uri""")
def model_rounds(spark, sf):
    """Talks that a stand-in model turns into edits, after files it asks for in up to three rounds."""
    c = T.load(spark, sf, "customer")
    files = c.select(F.format_string("ctx://user/%d.md", "c_custkey").alias("uri"), F.concat("c_name", F.expr("repeat('x', CAST(c_custkey % 50 AS INT))")).alias("content"))
    turns = T.load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    talk = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit(": "), x.text)), "\n")
    sessions = turns.select(F.col("conv_id").alias("session"), F.array(F.struct(F.lit("user").alias("role"), talk.alias("content"))).alias("messages"))
    return X.apply_operations(files, O.extract(sessions, files, _stand_in), {})


@query("""WITH c AS (SELECT 'ctx://user/' || user_id || '/memories/profile.md' AS uri, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 p AS (SELECT 'ctx://user/' || c_custkey || '/memories/profile.md' AS uri, CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS content FROM customer),
 m AS (SELECT c.*, p.content AS old FROM c LEFT JOIN p ON p.uri = c.uri), x AS (SELECT *, coalesce(trim(old), '') = '' AS blank FROM m),
 g AS (SELECT uri, count(*) FILTER (t <> 'error' AND NOT (blank AND k = 1)) AS merged, string_agg(CASE WHEN t <> 'error' AND NOT (blank AND k = 1) THEN ';' || t || event_id END, '' ORDER BY event_id) AS tail, max(CASE WHEN blank AND k = 1 THEN 'is ' || t END) AS first, max(old) AS old, max(blank::INT) AS blank FROM x GROUP BY uri)
 SELECT coalesce(g.uri, p.uri) AS uri, CASE WHEN g.uri IS NULL THEN p.content ELSE CASE WHEN blank = 1 THEN first ELSE g.old END || coalesce(tail, '') END AS content, coalesce(merged, 0) AS merged FROM g FULL JOIN p ON p.uri = g.uri""")
def profile_merges(spark, sf):
    """Events as what is learnt about their user, merged into the profile one after the other."""
    e = T.load(spark, sf, "events")
    found = e.select(F.format_string("ctx://user/%d/memories/profile.md", "user_id").alias("uri"), F.col("event_id").alias("seq"), F.concat("event_type", "event_id").alias("abstract"), F.concat(F.lit("is "), "event_type").alias("content"))
    c = T.load(spark, sf, "customer")
    known = c.select(F.format_string("ctx://user/%d/memories/profile.md", "c_custkey").alias("uri"), F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name")).alias("content"))
    return M.merge_profiles(known, found, lambda profile, abstract, content: None if abstract.startswith("error") else f"{profile};{abstract}")
