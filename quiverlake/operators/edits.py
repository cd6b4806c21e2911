"""Applying the edits that a model asks for to memory files.

Operations come in batches (one answer of a model each); within a batch all writes come first, then edits, edits
of overviews and deletions, each in its own order.  The rows of a file stream by in order, behind the row of the
file as it is; a task holds the text of one file and nothing else.  A file is changed by one task, since each
operation reads what the one before has left; files are independent of each other.

One bad operation leaves the others alone: it gives a row with the reason and changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quiverlake.operators.memory import apply_blocks

#: Phases of a batch in their order, with what a success is called (fixed values).
PHASES = {"write": "written", "edit": "edited", "overview": "edited", "delete": "deleted"}
#: Comment that holds the fields at the head of a memory file (fixed values).
HEAD, TAIL = "<!-- MEMORY_FIELDS", "-->"

#: Fields of a memory type: name to (kind, merge operator).
Schema = dict[str, tuple[str, str]]

_ROWS = 512


def dump(fields: dict) -> str:
    """Fields as JSON in order of their names; signs that could end the comment are escaped."""
    text = json.dumps(fields, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return text.replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")


def join_file(fields: dict, body: str) -> str:
    return f"{HEAD} {dump(fields)} {TAIL}\n{body}" if fields else body


def split_file(text: str) -> tuple[dict, str]:
    """Fields and body; a file whose comment has no end is all body, fields that are no JSON are lost."""
    end = text.find(TAIL)
    if not text.startswith(HEAD) or end < 0:
        return {}, text
    try:
        fields = json.loads(text[len(HEAD) : end])
    except ValueError:
        fields = {}
    return fields if isinstance(fields, dict) else {}, text[end + len(TAIL) :].removeprefix("\n")


def _shown(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def patch_text(current: str, patch) -> str:
    """Search and replace blocks change the text, other values replace it, empty ones leave it."""
    if patch is None or patch == "":
        return current
    if isinstance(patch, dict) and isinstance(patch.get("blocks"), list):
        blocks = [b for b in patch["blocks"] if isinstance(b, dict)]
        word = lambda b, k: b[k] if isinstance(b.get(k), str) else ""
        return apply_blocks(current, [(word(b, "search"), word(b, "replace")) for b in blocks])
    return _shown(patch)


def _number(value) -> float | int | None:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value
    try:
        return float(value) if isinstance(value, str) else None
    except ValueError:
        return None


def merge_value(op: str, kind: str, current, patch):
    """One field: ``immutable`` keeps what is set, ``sum`` adds numbers, ``patch`` replaces or edits texts."""
    if op == "immutable":
        return patch if current is None or current == "" else current
    if op == "sum":
        if patch is None or patch == "":
            return current
        if current is None:
            return patch
        a, b = _number(current), _number(patch)
        return current if a is None or b is None else a + b
    return patch_text(current if isinstance(current, str) else "", patch) if kind == "string" else patch


class _File:
    """The text of one file, or None, under operations."""

    def __init__(self, text: str | None, schemas: dict[str, Schema]):
        self.text = text
        self.schemas = schemas

    def apply(self, phase: str, memory_type: str | None, content: str | None, fields: dict) -> None:
        schema = self.schemas.get(memory_type or "", {})
        if phase == "delete":
            if self.text is None:
                raise ValueError("no such file")
            self.text = None
        elif phase == "overview":
            if "overview" in fields:
                self.text = patch_text(self.text or "", fields["overview"])
        elif phase == "write" or self.text is None:  # an edit of a missing file is a write
            named = schema if memory_type else {f: None for f in fields if f != "content"}
            self.text = join_file({f: fields[f] for f in named if f in fields}, content or "")
        else:
            head, body = split_file(self.text)
            for f, (kind, op) in schema.items():
                if f in fields and f == "content":
                    merged = merge_value(op, kind, body, fields[f])
                    body = merged if isinstance(merged, str) else ""
                elif f in fields:
                    head[f] = merge_value(op, kind, head.get(f), fields[f])
            if "content" in fields and "content" not in schema:
                body = patch_text(body, fields["content"])
            self.text = join_file(head, body)


def _fields(text: str | None) -> dict:
    if not text:
        return {}
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if not isinstance(found, dict):
        raise ValueError("fields are no JSON object")
    return found


_OUT = "uri string, batch long, phase string, seq long, outcome string, message string, content string"


def apply_operations(files: DataFrame, operations: DataFrame, schemas: dict[str, Schema], allowed: Column | None = None) -> DataFrame:
    """``operations (batch, phase, seq, uri, memory_type, content, fields)`` on ``files (uri, content)``.

    ``fields`` is a JSON object; ``schemas`` has the fields of each memory type, and ``allowed`` says of each
    operation whether its caller may change that file.  The result has a row for each operation, with its
    ``outcome`` (written, edited, deleted, failed) and a message where it failed, and a row of phase ``file``
    with the text of each file that is there at the end.

    A write keeps the fields that the schema of its type knows, or all of them without a type; an edit of a missing file
    is a write; an unknown phase fails.  Repeated rows are applied as often as they occur; rows of one batch,
    phase and ``seq`` follow each other in order of their content and fields; a null batch comes first; a null
    URI is a file of its own; of several rows of one file the greatest text counts.
    """
    kind = _parse_datatype_string(_OUT)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PHASES)), F.col("phase")), F.lit(0))
    may = F.coalesce(allowed, F.lit(False)) if allowed is not None else F.lit(True)
    given = files.select("uri", F.lit(None).cast("long").alias("batch"), F.lit("").alias("phase"), F.lit(None).cast("long").alias("seq"), F.lit("").alias("memory_type"), "content", F.lit("").alias("fields"), F.lit(True).alias("may"), F.lit(0).alias("kind"), F.lit(0).alias("rank"))
    asked = operations.select("uri", F.col("batch").cast("long").alias("batch"), "phase", F.col("seq").cast("long").alias("seq"), "memory_type", "content", "fields", may.alias("may"), F.lit(1).alias("kind"), rank.cast("int").alias("rank"))
    ordered = given.union(asked).repartition(F.col("uri")).sortWithinPartitions("uri", "kind", "batch", "rank", "seq", "content", "fields")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(kind)
        at, file, begun = None, _File(None, schemas), False
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def close() -> None:
            if begun and file.text is not None:
                out.append((at, None, "file", None, "kept", None, file.text))

        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                for r in whole.slice(k, _ROWS).to_pylist():
                    if not begun or r["uri"] != at:
                        close()
                        at, file, begun = r["uri"], _File(None, schemas), True
                    if r["kind"] == 0:
                        file.text = r["content"] if r["content"] is not None else file.text
                        continue
                    outcome, message = PHASES.get(r["phase"], "failed"), None
                    try:
                        if outcome == "failed":
                            raise ValueError("unknown phase")
                        if not r["may"]:
                            raise ValueError("permission denied")
                        file.apply(r["phase"], r["memory_type"], r["content"], _fields(r["fields"]))
                    except ValueError as e:
                        outcome, message = "failed", str(e)
                    out.append((at, r["batch"], r["phase"], r["seq"], outcome, message, None))
                yield flush()
        close()
        yield flush()

    return ordered.mapInArrow(run, kind)


def files_of(applied: DataFrame) -> DataFrame:
    """The files that are there after :func:`apply_operations`."""
    return applied.where("phase = 'file'").select("uri", "content")


def batch_report(applied: DataFrame) -> DataFrame:
    """Operations of each batch by outcome, and whether it changed anything; map-side counts."""
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    counted = applied.where("phase <> 'file'").groupBy("batch").agg(*map(count, ("written", "edited", "deleted", "failed")))
    return counted.withColumn("changed", F.col("written") + F.col("edited") + F.col("deleted") > 0)


def operations_of(answers: DataFrame, batch: str = "batch", answer: str = "answer") -> DataFrame:
    """Operations of models' answers: JSON objects with ``write_ops``, ``edit_ops``, ``edit_overview_ops`` and
    ``delete_uris``; an answer that isn't one asks for nothing."""
    op = "array<struct<uri: string, memory_type: string, content: string, fields: string>>"
    read = answers.select(F.col(batch).alias("batch"), F.from_json(answer, f"write_ops {op}, edit_ops {op}, edit_overview_ops {op}, delete_uris array<string>").alias("a"))
    lists = {"write": "write_ops", "edit": "edit_ops", "overview": "edit_overview_ops"}
    entry = lambda phase, name: F.transform(F.coalesce(F.col(f"a.{name}"), F.array().cast(op)), lambda x, i: F.struct(F.lit(phase).alias("phase"), i.cast("long").alias("seq"), x.uri.alias("uri"), x.memory_type.alias("memory_type"), x.content.alias("content"), x.fields.alias("fields")))
    gone = F.transform(F.coalesce(F.col("a.delete_uris"), F.array().cast("array<string>")), lambda u, i: F.struct(F.lit("delete").alias("phase"), i.cast("long").alias("seq"), u.alias("uri"), F.lit(None).cast("string").alias("memory_type"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("fields")))
    return read.select("batch", F.inline(F.concat(*[entry(p, n) for p, n in lists.items()], gone)))
