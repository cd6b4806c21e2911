"""Queries of sessions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiverlake.functions import templates as TP
from quiverlake.operators import sessions as S
from quiverlake.plans.registry import query
from quiverlake.sources import tables as T


@query("SELECT conv_id AS session_id, string_agg('[' || role || ']: ' || text, chr(10) ORDER BY turn) AS text FROM conversations WHERE text <> '' GROUP BY 1")
def session_transcripts(spark, sf):
    return S.transcripts(T.messages(spark, sf))


@query("SELECT conv_id AS session_id, substr(t, 1, 80) || CASE WHEN length(t) > 80 THEN '...' ELSE '' END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' AND text <> '' GROUP BY 1)")
def session_titles(spark, sf):
    return S.titles(T.messages(spark, sf))


@query("SELECT conv_id AS session_id, turn AS seq FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations) WHERE b <= 3")
def recent_messages(spark, sf):
    return S.recent(T.messages(spark, sf), 3).select("session_id", "seq")


@query("""WITH s AS (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1), st AS (SELECT conv_id, CAST(ceil(strlen(text) / 4.0) AS BIGINT) AS tokens FROM s WHERE text <> '' AND ceil(strlen(text) / 4.0) <= 300),
 m AS (SELECT conv_id, turn, CAST(ceil(strlen((CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END) || text) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations),
 r AS (SELECT m.conv_id, turn, m.tokens, sum(m.tokens) OVER (PARTITION BY m.conv_id ORDER BY turn) + coalesce(st.tokens, 0) AS used FROM m LEFT JOIN st USING (conv_id) WHERE b <= 20)
 SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, 'message' AS kind, tokens FROM r WHERE used <= 300 UNION ALL SELECT conv_id, 0, 'summary', tokens FROM st""")
def budgeted_prompt(spark, sf):
    m = T.messages(spark, sf)
    summaries = m.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "seq").alias("summary"))
    return S.assemble(m, summaries, 300).select("session_id", "place", "kind", "tokens")


@query("SELECT conv_id AS session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, max(turn) AS last_seq, CAST(sum(CAST(ceil(strlen(text) / 4.0) AS BIGINT)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def session_overview(spark, sf):
    return S.session_table(T.messages(spark, sf))


@query("SELECT conv_id AS session_id, 'archive_001' AS archive_id, 'closed' AS summary, count(*) AS messages FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1")
def session_commit(spark, sf):
    m = T.messages(spark, sf)
    none = spark.createDataFrame([], "session_id long, archive_id string, summary string, messages long")
    closed = m.where("session_id % 2 = 0").select("session_id", F.lit("closed").alias("summary")).distinct()
    return S.commit(m, none, closed)[1]


@query("SELECT conv_id AS session_id, turn AS seq, role, text AS first_text, CAST(1 AS INTEGER) AS tools FROM conversations")
def message_parts(spark, sf):
    """Messages with a text part and a tool part through JSON lines and back."""
    m = T.messages(spark, sf)
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"), F.lit(None).cast("string").alias("tool_id")), F.struct(F.lit("tool").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("t1").alias("tool_id")))
    back = S.from_jsonl(S.to_jsonl(m.withColumn("parts", parts)))
    return back.select("session_id", "seq", "role", S.first_text().alias("first_text"), F.size(S.parts_of("tool")).alias("tools"))


_PROMPTS = """
metadata: {id: chat.turn, category: chat}
variables:
  - {name: text, required: true}
  - {name: role, max_length: 4}
  - {name: tongue, default: auto}
  - {name: most, default: 3}
template: |
  {{- /* a turn of a talk */ -}}
  {{if .role}}As {{.role}}{{if eq .role "syst"}} (fixed){{else if and .long (not .first)}} at length{{else}} briefly{{end}}: {{end}}{{.text}}
  {{- if or .first (eq .turn 3 5)}}
  [{{.words}} of {{.most}}{{if .none}}never{{end}}]{{end}} {{.tongue}} {{.gone}}
"""


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS text, CASE WHEN turn % 4 = 3 THEN '' ELSE substr(role, 1, 4) END AS role, length(text) > 120 AS long, turn = 0 AS first, string_split(text, ' ')[1:2] AS words FROM conversations)
 SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN CASE WHEN role <> '' THEN 'As ' || role || CASE WHEN role = 'syst' THEN ' (fixed)' WHEN long AND NOT first THEN ' at length' ELSE ' briefly' END || ': ' ELSE '' END || text
 || CASE WHEN first OR turn IN (3, 5) THEN chr(10) || '[[' || array_to_string(words, ' ') || '] of 3]' ELSE '' END || ' auto <no value>' || chr(10) END AS prompt,
 CASE WHEN text IS NULL THEN 'required variable ''text'' not provided' END AS problem FROM m""")
def prompt_templates(spark, sf):
    """A template with nested conditions, defaults, cut and missing values for every turn of a talk."""
    m = T.load(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 5 != 4, F.col("text")).alias("text"), F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("role")).alias("role"),
        (F.length("text") > 120).alias("long"), (F.col("turn") == 0).alias("first"), F.slice(F.split("text", " "), 1, 2).alias("words"))
    prompts = TP.Prompts()
    prompts.add(_PROMPTS, "chat", "turn.yaml")
    text, problem = prompts.render("chat.turn", TP.values_of(m))
    return m.select("conv_id", "turn", text.alias("prompt"), problem.alias("problem"))
