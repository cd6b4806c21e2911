"""Document parsers: files to markdown, abstract and children.

``parse`` routes rows ``(path, content binary)`` by extension; a parser is a small function from bytes to
``[(part, title, markdown)]`` that one pass over the partitions applies to each file.  Text formats that
DataFrame functions can express are in :mod:`quiverlake.operators.parsing`.
"""

from __future__ import annotations

import html as entities
import io
import re
import tarfile
import zipfile
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlake.functions import uri as U
from quiverlake.sources.pdf import page_texts

#: Elements whose text isn't content (fixed values).
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "noscript"}
DROPPED_PLAIN = {"script", "style", "nav", "footer"}
_VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "table"}
_OPEN = {"pre": "\n```\n", "code": "`", "strong": "**", "b": "**", "em": "*", "i": "*", "li": "\n- ", "tr": "\n| "}
_CLOSE = {"pre": "\n```\n", "code": "`", "strong": "**", "b": "**", "em": "*", "i": "*", "td": " | ", "th": " | "}


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.stack: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.hidden += 1
        if tag not in _VOID:
            self.stack.append(tag)
        if self.hidden:
            return
        if re.fullmatch(r"h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in _BLOCKS or tag == "br":
            self.out.append("\n")
        elif tag == "img" and dict(attrs).get("alt"):
            self.out.append(f"[image: {dict(attrs)['alt']}]")
        else:
            self.out.append(_OPEN.get(tag, ""))

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:  # unclosed elements end with the one around them
            t = self.stack.pop()
            if t in DROPPED:
                self.hidden -= 1
            elif not self.hidden:
                self.out.append("\n" if t in _BLOCKS or re.fullmatch(r"h[1-6]", t) else _CLOSE.get(t, ""))
            if t == tag:
                break

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data.strip() if "pre" not in self.stack else data)


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in DROPPED_PLAIN

    def handle_endtag(self, tag):
        self.hidden -= tag in DROPPED_PLAIN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(data.strip())


def html_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip()


def html_plain(html: str) -> str:
    p = _Plain()
    p.feed(html or "")
    p.close()
    return " ".join(p.out)


def html_to_markdown(pages: DataFrame, key: str) -> DataFrame:
    """Columns ``title``, ``markdown`` and ``plain`` for rows with ``html``."""

    @F.pandas_udf("markdown string, plain string")
    def convert(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"markdown": html.map(html_markdown), "plain": html.map(html_plain)})

    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select(key, F.trim(title).alias("title"), convert("html").alias("c")).select(key, "title", "c.markdown", "c.plain")


# -- zip based formats ------------------------------------------------------------------------------

_TAG = re.compile(r"<[^>]+>")


def _lines(xml: str) -> str:
    text = entities.unescape(_TAG.sub("", re.sub(r"</w:p>|</w:tr>", "\n", xml)))
    return "\n".join(x.strip() for x in text.split("\n") if x.strip())


def docx(data: bytes) -> list[tuple[str, str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [("document", "", _lines(z.read("word/document.xml").decode("utf-8", "replace")))]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xlsx(data: bytes) -> list[tuple[str, str, str]]:
    """A table for each sheet, with a rule under its first row."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"] if "xl/workbook.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0]))
        for k, n in enumerate(sheets):
            rows = []
            for row in (r for r in ElementTree.fromstring(z.read(n)).iter() if _local(r.tag) == "row"):
                cells = []
                for c in row:
                    value = next((v.text or "" for v in c.iter() if _local(v.tag) in ("v", "t")), "")
                    cells.append((shared[int(value)] if c.get("t") == "s" and value else value).replace("|", "\\|"))
                rows.append("| " + " | ".join(cells) + " |")
                if len(rows) == 1:
                    rows.append("|" + " --- |" * len(cells))
            title = titles[k] if k < len(titles) else f"Sheet{k + 1}"
            out.append((f"sheet{k + 1}", title, f"## {title}\n\n" + "\n".join(rows)))
    return out


def epub(data: bytes) -> list[tuple[str, str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        chapters = [i for i in z.infolist() if re.search(r"\.x?html?$", i.filename, re.I) and not re.search("nav|toc", i.filename, re.I) and i.file_size <= 5 << 20]
        return [(i.filename, "", html_markdown(z.read(i).decode("utf-8", "replace"))) for i in chapters]


def pptx(data: bytes) -> list[tuple[str, str, str]]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0]))
        for k, n in enumerate(slides, 1):
            title, body = "", []
            for shape in (s for s in ElementTree.fromstring(z.read(n)).iter() if _local(s.tag) == "sp"):
                kind = next((p.get("type", "") for p in shape.iter() if _local(p.tag) == "ph"), "")
                text = "\n".join(t for p in shape.iter() if _local(p.tag) == "p" and (t := "".join(r.text or "" for r in p.iter() if _local(r.tag) == "t")))
                if kind in ("title", "ctrTitle") and not title:
                    title = text
                elif text:
                    body.append(text)
            out.append((f"slide{k}", title, f"## Slide {k}{': ' + title if title else ''}\n\n" + "\n".join(body)))
    return out


def archive_listing(data: bytes) -> list[tuple[str, str, str]]:
    """Entries of a zip archive and their number by extension, most first."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        files = [i for i in z.infolist() if not i.is_dir()]
    kinds = Counter(m[0].lower() if (m := re.search(r"\.[^./]+$", i.filename)) else "(none)" for i in files)
    by = "\n".join(f"- {k}: {n}" for k, n in sorted(kinds.items(), key=lambda x: (-x[1], x[0])))
    return [("listing", "", f"{len(files)} files\n\n{by}\n\n" + "\n".join(f"- {i.filename} ({i.file_size} B)" for i in files))]


def old_word(data: bytes) -> list[tuple[str, str, str]]:
    """Readable runs of an OLE2 file: UTF-16 runs, else ASCII runs."""
    if not data.startswith(bytes.fromhex("d0cf11e0a1b11ae1")):
        raise ValueError("not an OLE2 file")
    wide = [m[0].decode("utf-16-le") for m in re.finditer(rb"(?:[\x09\x0a\x0d\x20-\x7e\xa0-\xff]\x00){4,}", data[512:])]
    runs = wide or [m[0].decode("ascii") for m in re.finditer(rb"[\x09\x0a\x0d\x20-\x7e]{6,}", data[512:])]
    return [("document", "", re.sub(r"\n{3,}", "\n\n\n", "\n".join(r.replace("\r", "\n").strip() for r in runs)))]


def pdf(data: bytes) -> list[tuple[str, str, str]]:
    """Text of the pages, each under a heading with its number."""
    pages = page_texts(data)
    if not pages:
        raise ValueError("no page shows text")
    return [("document", "", "\n\n---\n\n".join(f"## Page {k}\n\n{t}" for k, t in pages))]


def plain_text(data: bytes) -> list[tuple[str, str, str]]:
    return [("document", "", data.decode("utf-8", "replace"))]


def html_file(data: bytes) -> list[tuple[str, str, str]]:
    return [("document", "", html_markdown(data.decode("utf-8", "replace")))]


def media(data: bytes) -> list[tuple[str, str, str]]:
    """Images, audio and video without a model: a fixed text with the size."""
    return [("document", "", f"[media file, {len(data)} bytes]")]


#: Extension to parser; later entries replace earlier ones (extensions are fixed values).
PARSERS: dict[str, Callable[[bytes], list[tuple[str, str, str]]]] = {
    **dict.fromkeys((".md", ".markdown", ".txt", ".text", ".rst", ".log", ".csv", ".tsv", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".env"), plain_text),
    **dict.fromkeys((".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".rs", ".rb", ".php", ".go", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".kt", ".swift", ".sh", ".sql"), plain_text),
    **dict.fromkeys((".html", ".htm", ".xhtml"), html_file),
    ".docx": docx, ".xlsx": xlsx, ".epub": epub, ".pptx": pptx, ".zip": archive_listing, ".doc": old_word, ".pdf": pdf,
    **dict.fromkeys((".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".svg", ".mp3", ".wav", ".m4a", ".flac", ".ogg", ".mp4", ".mov", ".avi", ".mkv", ".webm"), media),
}


def parse(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Rows ``(path, part, title, markdown, error)`` of files ``(path, content binary)``.

    Files without a parser are left out; a file that can't be read gives one row with its error.
    """
    table = PARSERS if parsers is None else PARSERS | parsers

    def run(batches):
        for pdf_ in batches:
            rows = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                read = table[re.search(r"\.[^./]*$", path)[0].lower()]
                try:
                    rows += [(path, *r, None) for r in read(bytes(data))]
                except Exception as e:  # noqa: BLE001  a broken file must not end the job
                    rows.append((path, "", "", "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "part", "title", "markdown", "error"])

    known = files.where(U.extension(F.col("path")).isin(*table)).select("path", "content")
    return known.mapInPandas(run, "path string, part string, title string, markdown string, error string")


def scan(spark, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as ``(path, length, modificationTime, content)``; any file system of Spark's."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


# -- packs ------------------------------------------------------------------------------------------


#: Bytes of files that one pack holds, more or less.
PACK_BYTES = 64 << 20


def pack(files: DataFrame, parts: int | None = None) -> DataFrame:
    """Tar.gz packs ``(pack, content binary)`` of files ``(path, content binary)``, one for each hash part.

    Without ``parts`` their number follows from the bytes of all files, so that a pack fits in a task.
    """
    parts = parts or 1 + (files.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // PACK_BYTES

    def build(pdf_: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode="w:gz") as t:
            for path, data in sorted(zip(pdf_["path"], pdf_["content"])):
                info = tarfile.TarInfo(path)
                info.size = len(data)
                t.addfile(info, io.BytesIO(bytes(data)))
        return pd.DataFrame({"pack": [int(pdf_["pack"].iloc[0])], "content": [buffer.getvalue()]})

    return files.withColumn("pack", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")).groupBy("pack").applyInPandas(build, "pack int, content binary")


def unpack(packs: DataFrame, existing: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Files of packs ``(content binary)``; paths that leave the folder are refused, manifests left out.

    Without ``force`` files that exist stay as they are.
    """

    def run(batches):
        for pdf_ in batches:
            rows = []
            for data in pdf_["content"]:
                with tarfile.open(fileobj=io.BytesIO(bytes(data)), mode="r:gz") as t:
                    for m in t.getmembers():
                        inside = not m.name.startswith("/") and ".." not in m.name.split("/")
                        if m.isfile() and inside and not m.name.endswith(".manifest.json"):
                            rows.append((m.name, t.extractfile(m).read()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    out = packs.select("content").mapInPandas(run, "path string, content binary")
    return out if force or existing is None else out.join(existing.select("path"), "path", "left_anti")
