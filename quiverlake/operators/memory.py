"""Memories: folding field patches, dedup decisions, archives, tool statistics."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quiverlake.functions import scoring
from quiverlake.functions import uri as U
from quiverlake.operators.search import knn, over_fetch

#: Merge operators by field: patch, sum, immutable; unknown ones act as patch.
OPS = ("patch", "sum", "immutable")


def latest(value: str, seq: str) -> Column:
    """Patch of plain values: the last one that isn't null or empty."""
    return F.max_by(value, F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.col(seq)))


def earliest(value: str, seq: str) -> Column:
    """Immutable: the first one that isn't null or empty."""
    return F.min_by(value, F.when(F.coalesce(F.col(value).cast("string"), F.lit("")) != "", F.col(seq)))


def total(value: str) -> Column:
    """Sum of what reads as a number."""
    return F.coalesce(F.sum(F.col(value).try_cast("double")), F.lit(0.0))


def fold_fields(patches: DataFrame, key: str, seq: str, ops: dict[str, str]) -> DataFrame:
    """Merge the rows of each key in order of ``seq``, one operator for each field; map-side combined."""
    make = {"patch": latest, "immutable": earliest}
    return patches.groupBy(key).agg(*[(total(f) if op == "sum" else make.get(op, latest)(f, seq)).alias(f) for f, op in ops.items()])


def apply_blocks(current: str, blocks: list[tuple[str, str]]) -> str:
    """Search/replace blocks in order: the first occurrence is replaced, a missing one is passed over, an
    empty search appends a line."""
    for find, put in blocks:
        if find == "":
            current = f"{current}\n{put}" if current else put
        elif find in current:
            current = current.replace(find, put, 1)
    return current


_BLOCK = re.compile(r"<{3,} SEARCH\n(.*?)\n?={3,}\n(.*?)\n?>{3,} REPLACE", re.S)


def parse_blocks(patch: str) -> list[tuple[str, str]]:
    return [(m[1], m[2]) for m in _BLOCK.finditer(patch)]


def fold_text(patches: DataFrame, key: str, seq: str, field: str) -> DataFrame:
    """String patches in order: blocks are applied, other texts replace, empty ones keep.

    Patches stream by in order of key and ``seq``; a task holds the running text of one key, never its
    patches.  Patches of one ``seq`` follow each other in order of their text; a null key is a key.
    """

    kind = patches.select(key, field).schema

    def run(batches):
        schema = to_arrow_schema(kind)
        at, text, begun = None, "", False
        for b in batches:
            keys, texts = [], []
            for k, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if begun and k != at:
                    keys.append(at)
                    texts.append(text)
                    text = ""
                at, begun = k, True
                if p:
                    blocks = parse_blocks(p)
                    text = apply_blocks(text, blocks) if blocks else p
            yield pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), pa.array(texts, schema.field(1).type)], schema=schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([at], schema.field(0).type), pa.array([text], schema.field(1).type)], schema=schema)

    ordered = patches.select(key, seq, field).repartition(F.col(key)).sortWithinPartitions(key, seq, field)
    return ordered.mapInArrow(run, kind)


def decide(decisions: DataFrame, actions: DataFrame) -> DataFrame:
    """Normalise dedup answers: ``(candidate, decision, actions array<struct<uri, action>>)``.

    ``decisions (candidate, decision)``, ``actions (candidate, pos, uri, action)``.  Merge reads as none, an
    unknown decision as create.  Repeated actions on a URI count once, contrary ones cancel (a further one
    counts again); skip has no actions; create with a merge becomes none; create keeps deletes alone.
    """
    known = actions.where(F.lower(F.trim("action")).isin("merge", "delete")).withColumn("action", F.lower(F.trim("action")))

    def settle(acc, x):
        # acc: action that stands for the URI now, or empty
        return F.when(acc == "", x).when(acc == x, acc).otherwise(F.lit(""))

    ordered = known.groupBy("candidate", "uri").agg(F.array_sort(F.collect_list(F.struct("pos", "action"))).alias("a"))
    stands = ordered.select("candidate", "uri", F.element_at("a.pos", 1).alias("pos"), F.aggregate("a.action", F.lit(""), settle).alias("action")).where("action <> ''")
    listed = stands.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("pos", "uri", "action"))).alias("acts"))
    word = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    base = F.when(word == "skip", "skip").when(word.isin("none", "merge"), "none").otherwise("create")
    acts = F.coalesce("acts", F.array().cast("array<struct<pos:bigint,uri:string,action:string>>"))
    joined = decisions.join(listed, "candidate", "left").withColumn("base", base).withColumn("acts", acts)
    merges = F.exists(F.col("acts"), lambda a: a.action == "merge")
    final = F.when((F.col("base") == "create") & merges, "none").otherwise(F.col("base"))
    kept = F.when(F.col("base") == "skip", F.slice("acts", 1, 0)).when(final == "create", F.filter("acts", lambda a: a.action == "delete")).otherwise(F.col("acts"))
    return joined.select("candidate", final.alias("decision"), F.transform(kept, lambda a: F.struct(a.uri.alias("uri"), a.action.alias("action"))).alias("actions"))


def dispatch(candidates: DataFrame, existing: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply settled decisions to memories ``(uri, content)``: the new table and counts of what was done.

    Candidates ``(candidate, uri, content)`` of profile, tools and skills are always created.
    """
    always = U.category(F.col("uri")).isin("profile", "tools", "skills")
    c = candidates.join(settled, "candidate", "left").withColumn("decision", F.when(always, "create").otherwise(F.coalesce("decision", F.lit("create"))))
    acts = c.where("decision <> 'skip'").select("candidate", "content", F.explode("actions").alias("a")).select("candidate", "content", "a.uri", "a.action")
    gone = acts.where("action = 'delete'").select("uri").distinct()
    merged = acts.where("action = 'merge'").groupBy("uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("candidate", "content"))), lambda x: x.content), "\n\n---\n\n").alias("more"))
    kept = existing.join(gone, "uri", "left_anti").join(merged, "uri", "left")
    kept = kept.select("uri", F.when(F.col("more").isNotNull(), F.concat_ws("\n\n---\n\n", "content", "more")).otherwise(F.col("content")).alias("content"))
    made = c.where("decision = 'create'").select("uri", "content")
    counts = c.agg(F.count_if(F.col("decision") == "create").alias("created"), F.count_if(F.col("decision") == "skip").alias("skipped")).crossJoin(
        acts.agg(F.count_if(F.col("action") == "merge").alias("merged"), F.count_if(F.col("action") == "delete").alias("deleted"))
    )
    return kept.unionByName(made), counts


def archive_candidates(contexts: DataFrame, as_of: Column, half_life_days: float = 7.0) -> DataFrame:
    """Cold memories that aren't archived yet, with their score and archive URI."""
    score = scoring.archive_score(F.col("active_count"), F.col("updated_at"), as_of, half_life_days)
    rows = contexts.where((F.col("context_type") == "memory") & ~F.col("uri").contains("/_archive/")).withColumn("score", score)
    return rows.where(scoring.is_cold(F.col("score"), F.col("updated_at"), as_of)).withColumn("archive_uri", U.archive(F.col("uri")))


def restore(contexts: DataFrame, uris: DataFrame, as_of: Column) -> DataFrame:
    """Bring archived rows back where no active row has their URI; they count as used once more."""
    back = contexts.join(uris.select("uri"), "uri", "left_semi").withColumn("active_uri", U.restore(F.col("uri")))
    free = back.join(contexts.select(F.col("uri").alias("active_uri")), "active_uri", "left_anti")
    touched = free.withColumn("uri", F.col("active_uri")).withColumn("parent_uri", U.parent(F.col("active_uri"))).withColumn("active_count", F.col("active_count") + 1).withColumn("updated_at", as_of)
    rest = contexts.join(free.select("uri"), "uri", "left_anti")
    return rest.unionByName(touched.select(*contexts.columns))


def merge_tool_stats(stats: DataFrame, tool: str = "tool", seq: str = "seq") -> DataFrame:
    """Counters add up; the last use is that of the newest record, even if it is older."""
    return stats.groupBy(tool).agg(F.sum("calls").alias("calls"), F.sum("success").alias("success"), F.sum("failure").alias("failure"), F.sum("total_ms").alias("total_ms"), F.max_by("last_used", seq).alias("last_used"))


def merge_guidelines(rows: DataFrame, key: str, text: str, seq: str) -> DataFrame:
    """Guidelines of each key in order, each text once."""
    first = rows.groupBy(key, text).agg(F.min(seq).alias("first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", text))), lambda x: x[text]).alias("guidelines"))


def similar_memories(candidates: DataFrame, vectors: DataFrame, contexts: DataFrame, limit: int = 10) -> DataFrame:
    """Nearest memories of the candidate's category prefix and owner: ``(query_id, id, score, place)``.

    ``candidates (query_id, vector, prefix, owner_space)``; an empty prefix (profile) finds nothing.
    """
    near = knn(candidates.select("query_id", "vector"), vectors, over_fetch(limit)).join(contexts.select("id", "uri", F.col("owner_space").alias("owner")), "id")
    own = near.join(candidates.select("query_id", "prefix", "owner_space"), "query_id").where((F.col("prefix") != "") & F.expr("startswith(uri, prefix)") & (F.col("owner") == F.col("owner_space")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "ord"))
    return own.withColumn("place", place).where(F.col("place") <= limit).select("query_id", "id", (1 - F.col("distance")).alias("score"), "place")


def to_file(fields: Column, body: Column) -> Column:
    """Memory file: a comment with the fields as JSON, then the text."""
    return F.concat(F.lit("<!-- MEMORY_FIELDS "), F.to_json(fields), F.lit(" -->\n"), body)


def from_file(text: Column, schema: str) -> tuple[Column, Column]:
    """Fields and text of a memory file; files without the comment are all text."""
    head = F.regexp_extract(text, r"^<!-- MEMORY_FIELDS (.*?) -->\n", 1)
    return F.from_json(head, schema), F.regexp_replace(text, r"^<!-- MEMORY_FIELDS .*? -->\n", "")


def json_object(text: str) -> str | None:
    """First balanced ``{...}`` of a model's answer, code fences stripped; braces in strings don't count."""
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    body = fenced[1] if fenced else text
    start = body.find("{")
    while start >= 0:
        try:
            return json.dumps(json.JSONDecoder().raw_decode(body[start:])[0], ensure_ascii=False)
        except ValueError:
            start = body.find("{", start + 1)
    return None


def parse_candidates(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Candidate memories in model answers: ``{"memories": [{category, abstract, overview, content}]}``.

    Unknown categories become patterns; entries without abstract and content are left out.
    """

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json_object(t or ""))

    kind = "struct<memories:array<struct<category:string,abstract:string,overview:string,content:string>>>"
    rows = answers.select("session_id", F.posexplode(F.from_json(extract(F.col(text)), kind)["memories"]).alias("pos", "m"))
    known = ("profile", "preferences", "entities", "events", "cases", "patterns", "tools", "skills")
    out = rows.select("session_id", "pos", F.when(F.col("m.category").isin(*known), F.col("m.category")).otherwise("patterns").alias("category"), *[F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("abstract", "overview", "content")])
    return out.where("abstract <> '' or content <> ''")


def parse_query_plan(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Typed queries of an intent answer: type resource by default, priority 1 to 5 (3 if unset)."""

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(lambda t: json_object(t or ""))

    kind = "struct<queries:array<struct<query:string,context_type:string,priority:int>>>"
    rows = answers.select("session_id", F.posexplode(F.from_json(extract(F.col(text)), kind)["queries"]).alias("pos", "q"))
    kinds = F.when(F.col("q.context_type").isin("memory", "skill", "resource"), F.col("q.context_type")).otherwise("resource")
    return rows.select("session_id", "pos", "q.query", kinds.alias("context_type"), F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce("q.priority", F.lit(3)))).alias("priority")).where("query <> ''")


def extract_memories(sessions: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """Ask a model for memories: ``complete`` turns a conversation text into an answer, one call a row."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"session_id": pdf["session_id"], "answer": [complete(t) for t in pdf["text"]]})

    kind = sessions.schema["session_id"].dataType.simpleString()
    return parse_candidates(sessions.select("session_id", "text").mapInPandas(run, f"session_id {kind}, answer string"))


def merge_profiles(profiles: DataFrame, candidates: DataFrame, merge: Callable[[str, str, str], str | None]) -> DataFrame:
    """Profiles ``(uri, content, merged)`` after ``candidates (uri, seq, abstract, content)``, each in order.

    A candidate of a blank or missing profile becomes it; otherwise ``merge(profile, abstract, content)`` gives the
    new text, and null leaves it.  The rows of a profile stream by behind its text, which is all that a task
    holds; a profile is changed by one task, since each answer reads the one before.  Of several rows of one
    profile the greatest text counts; null contents are empty; profiles without candidates stay as they are.
    """
    kind = "uri string, content string, merged long"
    given = profiles.select("uri", F.lit(None).cast("long").alias("seq"), F.lit("").alias("abstract"), F.coalesce("content", F.lit("")).alias("content"), F.lit(0).alias("kind"))
    asked = candidates.select("uri", F.col("seq").cast("long").alias("seq"), F.coalesce("abstract", F.lit("")).alias("abstract"), F.coalesce("content", F.lit("")).alias("content"), F.lit(1).alias("kind"))
    ordered = given.union(asked).repartition(F.col("uri")).sortWithinPartitions("uri", "kind", "seq", "abstract", "content")

    def run(batches):
        at, text, merged, begun = None, "", 0, False
        for b in batches:
            done = []
            for uri, abstract, content, is_new in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if not begun or uri != at:
                    if begun:
                        done.append((at, text, merged))
                    at, text, merged, begun = uri, "", 0, True
                if not is_new or not text.strip():
                    text = content
                elif (answer := merge(text, abstract, content)) is not None:
                    text, merged = answer, merged + 1
            yield _profile_rows(done)
        if begun:
            yield _profile_rows([(at, text, merged)])

    return ordered.mapInArrow(run, kind)


def _profile_rows(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["uri", "content", "merged"])
