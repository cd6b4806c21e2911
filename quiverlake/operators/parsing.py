"""Text parsing as DataFrame programs: markdown sections, front matter, chunks, block lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiverlake.functions import text as X
from quiverlake.operators.skeletons import skeletons  # noqa: F401  part of parsing


#: White space inside a line, for patterns (fixed value).
_BLANK = r"[ \t\r\x0b\x0c]"


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections ``(key, section, level, heading, content)``: a line that begins with one to three ``#`` and
    a space starts one; what stands before the first has level 0 and no heading.

    Each text is cut inside its row before the lines that are headings, so nothing is shuffled and rows with
    equal keys stay apart.
    """
    head = rf"{_BLANK}*#{{1,3}} [^\n]*[^ \t\r\x0b\x0c\n]"
    parts = F.split(F.col(text), rf"\n(?={head})")
    cut = docs.select(key, F.rlike(F.col(text), F.lit(f"^{head}")).cast("int").alias("begins"), F.posexplode(parts).alias("pos", "part"))
    titled = (F.col("pos") > 0) | (F.col("begins") == 1)
    line = X.strip(F.substring_index("part", "\n", 1))
    level = F.when(titled, F.length(F.regexp_extract(line, "^#+", 0))).otherwise(0)
    heading = F.when(titled, F.regexp_replace(line, r"^#+\s+", "")).otherwise("")
    rest = F.when(titled, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part"))
    out = cut.select(key, (F.col("pos") + F.col("begins")).alias("section"), level.alias("level"), heading.alias("heading"), X.strip(rest).alias("content"))
    return out.where((F.col("level") > 0) | (F.col("content") != ""))


def front_matter(text: Column) -> tuple[Column, Column]:
    """YAML block between ``---`` lines at the start, and the rest."""
    head = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---\n?", 1)
    return head, F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n?", "")


def skill_sections(sections_table: DataFrame, key: str = "doc_id") -> DataFrame:
    """Sections of levels one and two by lower-case heading; later ones of a name win."""
    named = sections_table.where(F.col("level").isin(1, 2))
    return named.groupBy(key, F.lower("heading").alias("name")).agg(F.max_by("content", "section").alias("content"))


def chunks(docs: DataFrame, size: int, overlap: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Overlapping chunks ``(key, chunk, start, content)`` of at most ``size`` characters.

    A chunk ends behind the last blank line of its second half, if there is one, and is stripped; blank chunks
    are left out.  The next chunk begins ``overlap`` characters before that end, the last one reaches the end
    of the text.  Null texts have no chunks.  ``overlap`` is less than half of ``size``.
    """
    if not 0 <= 2 * overlap < size:
        raise ValueError("overlap must be less than half of size")

    @F.pandas_udf("array<struct<start:int,content:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        def pieces(t: str) -> list[dict]:
            out, at = [], 0
            while at < len(t):
                end = at + size
                if end < len(t):
                    blank = t.rfind("\n\n", at, end) - at
                    end = at + blank + 2 if blank > size // 2 else end
                if body := t[at:end].strip(_SPACES):
                    out.append({"start": at, "content": body})
                if end >= len(t):
                    break
                at = end - overlap
            return out

        return texts.map(lambda t: pieces(t or ""))

    rows = docs.select(key, F.posexplode(cut(F.col(text))).alias("chunk", "c"))
    return rows.select(key, "chunk", "c.start", "c.content")


_SPACES = " \t\n\r\x0b\x0c"

def code_abstract(files: DataFrame) -> DataFrame:
    """One line for a source file: ``name (ext, n lines, f funcs, t types)``."""
    c = X.code_counts(F.col("content"))
    name, ext = F.substring_index("path", "/", -1), F.regexp_extract("path", r"\.([^./]*)$", 1)
    return files.select("path", F.format_string("%s (%s, %d lines, %d funcs, %d types)", name, ext, c["lines"], c["functions"], c["types"]).alias("abstract"))


def block_list_markdown(blocks: DataFrame) -> DataFrame:
    """Block lists ``(doc_id, pos, kind, level, text)`` to markdown.

    Ordered items are numbered from 1 and start anew after any other block; headings below six are left out.
    A todo is done where its level is 1, an image has its token as text; a blank line parts blocks.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    island = F.sum((F.col("kind") != "ordered").cast("int")).over(w)
    marked = blocks.withColumn("island", island)
    n = F.sum((F.col("kind") == "ordered").cast("int")).over(Window.partitionBy("doc_id", "island").orderBy("pos"))
    line = (
        F.when((F.col("kind") == "heading") & (F.col("level") <= 6), F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("text")))
        .when(F.col("kind") == "heading", F.lit(None))
        .when(F.col("kind") == "bullet", F.concat(F.lit("- "), F.col("text")))
        .when(F.col("kind") == "ordered", F.concat(n.cast("string"), F.lit(". "), F.col("text")))
        .when(F.col("kind") == "code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("kind") == "quote", F.concat(F.lit("> "), F.col("text")))
        .when(F.col("kind") == "todo", F.concat(F.when(F.col("level") == 1, "- [x] ").otherwise("- [ ] "), F.col("text")))
        .when(F.col("kind") == "image", F.concat(F.lit("!["), F.when(F.col("text") == "", "image").otherwise(F.col("text")), F.lit("](image/"), F.col("text"), F.lit(")")))
        .when(F.col("kind") == "divider", F.lit("---"))
        .otherwise(F.col("text"))
    )
    rows = marked.withColumn("line", line).where("line is not null")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n\n").alias("markdown"))
