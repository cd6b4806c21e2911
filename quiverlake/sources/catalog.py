"""Definitions and small files: memory schemas, prompts, skills, datasets, preset directories."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, LongType, StringType, StructField, StructType

from quiverlake.operators import parsing

#: Field types of memory schemas (fixed values); dates are kept as text.
TYPES = {"string": StringType(), "int64": LongType(), "int": LongType(), "float32": FloatType(), "float64": DoubleType(), "bool": BooleanType()}


def memory_schema(path: str) -> tuple[StructType, dict[str, str]]:
    """Columns and merge operators of a memory type in YAML; ``type`` and ``field_type`` both name types."""
    with open(path, encoding="utf-8") as f:
        spec = yaml.safe_load(f) or {}
    fields = spec.get("fields") or []
    kind = lambda f: TYPES.get(f.get("field_type") or f.get("type") or "string", StringType())
    op = lambda f: f.get("merge_op") if f.get("merge_op") in ("patch", "sum", "immutable") else "patch"
    return StructType([StructField(f["name"], kind(f)) for f in fields]), {f["name"]: op(f) for f in fields}


def render(template: str, values: dict) -> str:
    """Fill in ``{{ .name }}``; missing names are empty."""
    return re.sub(r"\{\{-?\s*\.(\w+)\s*-?\}\}", lambda m: str(values.get(m[1], "")), template)


def skills(files: DataFrame) -> DataFrame:
    """Skill files ``(path, content)``: name, description and sections by heading."""
    head, body = parsing.front_matter(F.col("content"))
    value = lambda name: F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ ]*(.*)$", 1))
    parts = parsing.skill_sections(parsing.sections(files.select(F.col("path").alias("doc_id"), body.alias("text"))))
    named = parts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("sections"))
    return files.select("path", value("name").alias("name"), value("description").alias("description")).join(named.withColumnRenamed("doc_id", "path"), "path", "left")


def skill_markdown(skill_rows: DataFrame) -> DataFrame:
    """Skill rows back to files: front matter, then the sections by name."""
    entries = F.array_sort(F.map_entries("sections"))
    body = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("## "), e.key, F.lit("\n\n"), e.value)), "\n\n")
    return skill_rows.select("path", F.concat(F.lit("---\nname: "), "name", F.lit("\ndescription: "), "description", F.lit("\n---\n\n"), body, F.lit("\n")).alias("content"))


def render_column(template: str, values: dict[str, Column]) -> Column:
    """The same with columns: the template's text and the values in turn, so that values are never looked into."""
    parts = re.split(r"\{\{-?\s*\.(\w+)\s*-?\}\}", template)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("") for k, p in enumerate(parts)])


SAMPLE = "id string, query string, expected_docs array<string>, ground_truth string, retrieved_docs array<string>, retrieved_texts array<string>, retrieved_scores array<double>, generated_answer string"
RECORDED = "id string, query string, timestamp string, retrieved_uris array<string>, retrieved_texts array<string>, scores array<double>, latency_ms long, session_id string"


def dataset(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Samples of evaluation files, each an object with ``samples``; or, not ``whole_files``, such an object a line."""
    return spark.read.schema(f"name string, samples array<struct<{SAMPLE}>>").option("multiLine", str(whole_files).lower()).json(path).select(F.inline("samples"))


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """Queries of recording files, each an object with ``queries``."""
    return spark.read.schema(f"queries array<struct<{RECORDED}>>").option("multiLine", "true").json(path).select(F.posexplode("queries").alias("seq", "q")).select("seq", "q.*")


def sessions(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Messages of session files ``(session_id, seq, role, content)``; unreadable files are left out.

    A session is a file of its own, or, not ``whole_files``, a line.
    """
    schema = "info struct<id:string,title:string>, messages array<struct<role:string,content:string,timestamp:string>>"
    rows = spark.read.schema(schema).option("multiLine", str(whole_files).lower()).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.col("info.id").alias("session_id"), F.posexplode("messages").alias("seq", "m")).select("session_id", "seq", "m.role", "m.content")


#: Preset directories below the scopes: path, abstract; ``{user}`` and ``{agent}`` are spaces.
PRESET = [
    ("resources", "Shared documents"), ("user", "User scope"), ("agent", "Agent scope"), ("session", "Sessions"),
    ("user/{user}/memories", "What is known about the user"), ("user/{user}/memories/preferences", "Preferences"),
    ("user/{user}/memories/entities", "Entities"), ("user/{user}/memories/events", "Events"),
    ("agent/{agent}/memories/cases", "Cases"), ("agent/{agent}/memories/patterns", "Patterns"), ("agent/{agent}/skills", "Skills"),
]


def bootstrap(spark: SparkSession, scheme: str, user: str, agent: str, existing: DataFrame) -> DataFrame:
    """Rows of preset directories, levels 0 and 1, that ``existing (uri, level)`` lacks."""
    rows = [(f"{scheme}://{p.format(user=user, agent=agent)}", lv, t) for p, t in PRESET for lv in (0, 1)]
    return spark.createDataFrame(rows, "uri string, level int, abstract string").join(existing.select("uri", "level"), ["uri", "level"], "left_anti")


def save_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
