"""Sessions and messages: transcripts, titles, recent turns, token budgets, commits.

Messages are rows ``(session_id, seq, role, content)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import text as X


def _in_order(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("seq", *cols)))


def transcripts(messages: DataFrame) -> DataFrame:
    """``[role]: text`` lines of each session; empty messages are left out."""
    rows = messages.where(F.coalesce("content", F.lit("")) != "").groupBy("session_id").agg(_in_order("role", "content").alias("m"))
    return rows.select("session_id", F.array_join(F.transform("m", lambda x: F.concat(F.lit("["), x.role, F.lit("]: "), x.content)), "\n").alias("text"))


def titles(messages: DataFrame, most: int = 80) -> DataFrame:
    """First user message that isn't empty, cut to ``most`` characters."""
    first = messages.where((F.col("role") == "user") & (F.col("content") != "")).groupBy("session_id").agg(F.min_by("content", "seq").alias("t"))
    return first.select("session_id", X.truncate(F.col("t"), most).alias("title"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` messages of each session."""
    w = Window.partitionBy("session_id").orderBy(F.desc("seq"))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back")


def assemble(messages: DataFrame, summaries: DataFrame, budget: int, last: int = 20) -> DataFrame:
    """Prompt parts within a token budget: ``(session_id, place, kind, text, tokens)``.

    The summary comes first and is left out if it is too big by itself; then the last messages in order,
    up to the first that doesn't fit.
    """
    s = summaries.select("session_id", F.col("summary").alias("text"), X.estimate_tokens(F.col("summary")).alias("tokens")).where((F.col("text") != "") & (F.col("tokens") <= budget))
    m = recent(messages, last).select("session_id", "seq", F.when(F.col("role") == "user", F.concat(F.lit("User: "), "content")).otherwise(F.concat(F.lit("Assistant: "), "content")).alias("text"))
    m = m.withColumn("tokens", X.estimate_tokens(F.col("text"))).join(s.select("session_id", F.col("tokens").alias("taken")), "session_id", "left")
    used = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("seq")) + F.coalesce("taken", F.lit(0))
    fit = m.withColumn("used", used).where(F.col("used") <= budget)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    parts = fit.select("session_id", place.alias("place"), F.lit("message").alias("kind"), "text", "tokens")
    return s.select("session_id", F.lit(0).alias("place"), F.lit("summary").alias("kind"), "text", "tokens").union(parts)


def commit(messages: DataFrame, archives: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Close the sessions that have a summary: their messages go, an archive row is added."""
    n = F.coalesce(F.col("n"), F.lit(0)) + 1
    counts = archives.groupBy("session_id").agg(F.count("*").alias("n"))
    size = messages.groupBy("session_id").agg(F.count("*").alias("messages"))
    new = summaries.join(counts, "session_id", "left").join(size, "session_id").select("session_id", F.format_string("archive_%03d", n).alias("archive_id"), "summary", "messages")
    return messages.join(summaries, "session_id", "left_anti"), archives.unionByName(new)


def session_table(messages: DataFrame) -> DataFrame:
    """Messages by role, span and estimated tokens of each session."""
    return messages.groupBy("session_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.max("seq").alias("last_seq"), F.sum(X.estimate_tokens(F.col("content"))).alias("tokens"),
    )


PART = "struct<type:string,text:string,uri:string,abstract:string,tool_id:string,tool_name:string,input:string,output:string,status:string>"


def to_jsonl(messages: DataFrame) -> DataFrame:
    """Messages with parts as one JSON line each."""
    return messages.select("session_id", "seq", F.to_json(F.struct("role", "parts")).alias("line"))


def from_jsonl(lines: DataFrame) -> DataFrame:
    """Back to parts; a part of unknown type becomes a text part of its raw JSON."""
    raw = F.from_json("line", "struct<role:string,parts:array<string>>")
    known = F.from_json("line", f"struct<role:string,parts:array<{PART}>>")
    fixed = F.zip_with(raw["parts"], known["parts"], lambda r, k: F.when(k["type"].isin("text", "context", "tool"), k).otherwise(F.struct(F.lit("text").alias("type"), r.alias("text"), *[F.lit(None).cast("string").alias(n) for n in ("uri", "abstract", "tool_id", "tool_name", "input", "output", "status")])))
    return lines.select("session_id", "seq", known["role"].alias("role"), fixed.alias("parts"))


def parts_of(kind: str) -> Column:
    return F.filter("parts", lambda p: p["type"] == kind)


def first_text() -> Column:
    return F.coalesce(F.try_element_at(parts_of("text"), F.lit(1))["text"], F.lit(""))


def tool_part(tool_id: Column) -> Column:
    return F.try_element_at(F.filter(parts_of("tool"), lambda p: p["tool_id"] == tool_id), F.lit(1))
