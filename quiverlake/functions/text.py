"""Text columns: truncation, abstracts, tokens, language, facet keys, sizes and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the evaluation tokens leave out (fixed value).
STOP_WORDS = (
    "the is at which on a an and or but in of to for with it this that are was be has have had not by from as do does"
).split()

#: Extension to language (fixed value).
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".rs": "rust", ".rb": "ruby", ".php": "php", ".go": "go", ".c": "c", ".cpp": "cpp",
    ".cc": "cpp", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".kt": "kotlin", ".swift": "swift",
}

#: Parts of error messages (fixed values); permanent ones are tested first.
PERMANENT = ("400", "401", "403", "Forbidden", "Unauthorized", "AccountOverdue")
TRANSIENT = (
    "429", "500", "502", "503", "504", "TooManyRequests", "RateLimit", "RequestBurstTooFast",
    "timeout", "Timeout", "ConnectionError", "Connection refused", "Connection reset",
)

_TRIM = " \t\n\r\x0b\x0c"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_TRIM))


def truncate(text: Column, most: int, suffix: str = "...") -> Column:
    """The first ``most`` characters, with the suffix where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(suffix))).otherwise(text)


def truncate_bytes(text: Column, most: int, suffix: str = "...") -> Column:
    """The same by UTF-8 bytes; a character cut in two becomes U+FFFD."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(head, F.lit(suffix))).otherwise(text)


def first_line(text: Column, lines: int | None = None) -> Column:
    """First line that isn't blank, of the first ``lines`` lines, stripped; null if there is none."""
    rows = F.split(text, "\n")
    rows = F.slice(rows, 1, lines) if lines else rows
    return F.try_element_at(F.filter(F.transform(rows, strip), lambda r: r != ""), F.lit(1))


def abstract(text: Column, lines: int | None = 20, most: int = 200) -> Column:
    """Heading text of the first line, or the line cut to ``most`` characters; empty if all is blank."""
    line = first_line(text, lines)
    return F.coalesce(F.when(F.startswith(line, F.lit("# ")), strip(F.substring(line, 3, 1 << 30))).otherwise(truncate(line, most)), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case words of a-z, 0-9 and non-ASCII signs, of two bytes or more, without stop words."""
    words = F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+")
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def language(text: Column) -> Column:
    """Korean, Russian or Arabic with two signs and a tenth of all; else Japanese, Chinese, English."""
    count = lambda r: F.regexp_count(text, F.lit(r))
    ko, ru, ar = count(r"[\x{AC00}-\x{D7AF}]"), count(r"[\x{0400}-\x{04FF}]"), count(r"[\x{0600}-\x{06FF}]")
    most = F.greatest(ko, ru, ar)
    total = F.length(F.regexp_replace(text, r"\s+", ""))
    script = F.when(ko == most, "ko").when(ru == most, "ru").otherwise("ar")
    return (
        F.when((most >= 2) & (most >= 0.1 * total), script)
        .when(count(r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]") > 0, "ja")
        .when(count(r"[\x{4E00}-\x{9FFF}]") > 0, "zh-CN")
        .otherwise("en")
    )


def facet_key(text: Column) -> Column:
    """What stands before the first separator, else the first words up to 24 characters."""
    flat = F.lower(strip(F.regexp_replace(text, r"\s+", " ")))
    before = [F.when(flat.contains(s) & (strip(F.substring_index(flat, s, 1)) != ""), strip(F.substring_index(flat, s, 1))) for s in ("：", ":", "-", "—")]
    words = strip(F.regexp_extract(flat, r"^(.{1,24})\s", 1))
    return F.coalesce(*before, F.when(words != "", words), F.substring(flat, 1, 24))


def human_size(size: Column) -> Column:
    """1024-based size with one decimal."""
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1 << 20, F.format_string("%.1f KB", F.bround(size / 1024.0, 1)))
        .when(size < 1 << 30, F.format_string("%.1f MB", F.bround(size / float(1 << 20), 1)))
        .otherwise(F.format_string("%.1f GB", F.bround(size / float(1 << 30), 1)))
    )


def language_of_extension(ext: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext), F.lit(""))


def error_class(message: Column) -> Column:
    has = lambda words: F.reduce(F.array(*[message.contains(w) for w in words]), F.lit(False), lambda a, x: a | x)
    return F.when(has(PERMANENT), "permanent").when(has(TRANSIENT), "transient").otherwise("unknown")


def backoff(attempt: Column, base: float = 0.5, most: float = 5.0) -> Column:
    """Seconds before a retry, without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def code_counts(text: Column) -> dict[str, Column]:
    """Lines, and lines that begin like a function or a type."""
    rows = F.transform(F.split(text, "\n"), strip)
    starts = lambda *words: F.size(F.filter(rows, lambda r: F.reduce(F.array(*[F.startswith(r, F.lit(w)) for w in words]), F.lit(False), lambda a, x: a | x)))
    return {"lines": F.size(rows), "functions": starts("def ", "func ", "fn ", "function "), "types": starts("class ", "type ", "struct ", "interface ")}


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")
