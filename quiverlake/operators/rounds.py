"""Rounds of a model and a table: what a model asks for, for all sessions at once, is answered by a join.

A session is a list of messages.  In each round the model answers every open session; it may call for files or
listings, which are added to the session's messages, or give its final answer.  Calls of all sessions are one
table, each file that is asked for is read once, and no row asks anything by itself.  After the last round,
sessions without an answer have none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import uri as U
from quiverlake.operators.edits import operations_of
from quiverlake.session import materialize

#: Rounds of a session.
ROUNDS = 3
MESSAGES = "array<struct<role: string, content: string>>"
#: Answer of a model: calls of tools by name and URI, and a text.
ANSWER = "struct<calls: array<struct<name: string, uri: string>>, content: string>"

Model = Callable[[Column, int], Column]


def _answers(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Results ``(name, uri, result)`` of the distinct calls ``(name, uri)``."""
    read = calls.where("name = 'read'").join(files.select("uri", "content"), "uri", "left").select("name", "uri", F.coalesce("content", F.lit("error: no such file")).alias("result"))
    listed = files.select(U.parent(F.col("uri")).alias("uri"), U.name(F.col("uri")).alias("entry"))
    names = listed.join(calls.where("name = 'ls'").select("uri"), "uri", "left_semi").groupBy("uri").agg(F.to_json(F.array_sort(F.collect_list("entry"))).alias("result"))
    ls = calls.where("name = 'ls'").join(names, "uri", "left").select("name", "uri", F.coalesce("result", F.lit("error: no such directory")).alias("result"))
    other = F.when(F.col("name") == "search", "search not available in this context").otherwise(F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit(""))))
    return read.unionByName(ls).unionByName(calls.where("name is null or name not in ('read', 'ls')").select("name", "uri", other.alias("result")))


def converse(sessions: DataFrame, files: DataFrame, model: Model, rounds: int = ROUNDS) -> DataFrame:
    """Final answers ``(session, answer)`` of ``sessions (session, messages)``, null where there is none.

    ``model(messages, round)`` is a column of type ``ANSWER``, a pandas UDF over whole batches for instance.  A
    final answer is a JSON object; another text uses up the round and leaves the messages as they are.  Calls of the
    last round are not answered.  ``files (uri, content)`` has a row for each file; sessions have ids of their own.
    """
    open_ = sessions.select("session", F.col("messages").cast(MESSAGES).alias("messages"))
    done: list[DataFrame] = []
    for r in range(rounds):
        last = r == rounds - 1
        said = materialize(open_.withColumn("a", model(F.col("messages"), r).cast(ANSWER)), "round")
        calls = F.lit(False) if last else F.coalesce(F.size("a.calls") > 0, F.lit(False))
        parsed = F.try_parse_json("a.content")
        final = ~calls & F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        done.append(said.where(final).select("session", F.col("a.content").alias("answer")))
        rest = said.where(~final)
        if last:
            done.append(rest.select("session", F.lit(None).cast("string").alias("answer")))
            break
        asked = rest.where(calls).select("session", F.posexplode("a.calls").alias("pos", "c")).select("session", "pos", "c.name", "c.uri")
        found = _answers(asked.select("name", "uri").distinct(), files).toDF("of", "at", "result")
        same = F.col("name").eqNullSafe(F.col("of")) & F.col("uri").eqNullSafe(F.col("at"))
        shown = asked.join(found, same).select("session", "pos", F.struct(F.lit("user").alias("role"), F.concat(F.lit("[tool_result:"), F.coalesce("name", F.lit("")), F.lit("] "), "result").alias("content")).alias("m"))
        results = shown.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x.m).alias("results"))
        reply = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("a.content", F.lit("")).alias("content")))
        more = F.when(F.col("results").isNotNull(), F.concat("messages", reply, "results")).otherwise(F.col("messages"))
        open_ = rest.join(results, "session", "left").select("session", more.alias("messages"))
    return reduce(DataFrame.unionByName, done)


def extract(sessions: DataFrame, files: DataFrame, model: Model, rounds: int = ROUNDS) -> DataFrame:
    """Operations on files that the final answers ask for, a batch for each session."""
    return operations_of(converse(sessions, files, model, rounds).where("answer is not null").withColumnRenamed("session", "batch"))
