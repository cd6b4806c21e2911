"""Queries that write benchmark items in the formats of office programs and archives, and import them again."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from html import escape

from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quiverlake.plans.registry import query
from quiverlake.session import work_folder
from quiverlake.sources import catalog as C
from quiverlake.sources import documents as D
from quiverlake.sources import tables as T

_WORDS = "SELECT item_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark"


def _zip(files: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return buffer.getvalue()


def _files(spark, sf, ext: str, build: Callable[[str], bytes]):
    make = F.pandas_udf(lambda texts: texts.map(build), BinaryType())
    items = T.load(spark, sf, "benchmark")
    return items.select(F.concat("item_id", F.lit(ext)).alias("path"), make("text").alias("content"))


def _sheets(text: str) -> bytes:
    """Two sheets of three columns; cells are shared strings and inline ones in turn."""
    words = text.split()
    half = (len(words) + 1) // 2
    shared: dict[str, int] = {}
    sheets = {}
    for k, part in enumerate((words[:half], words[half:]), 1):
        rows = []
        for at in range(0, len(part), 3):
            cells = [f'<c t="s"><v>{shared.setdefault(w, len(shared))}</v></c>' if j % 2 == 0 else f'<c t="inlineStr"><is><t>{escape(w)}</t></is></c>' for j, w in enumerate(part[at : at + 3])]
            rows.append(f"<row>{''.join(cells)}</row>")
        sheets[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{''.join(rows)}</sheetData></worksheet>"
    strings = "".join(f"<si><t>{escape(w)}</t></si>" for w in shared)
    return _zip({"xl/workbook.xml": '<workbook><sheets><sheet name="Front"/><sheet name="Back"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst>{strings}</sst>", **sheets})


_CELL = "replace(x, '|', chr(92) || '|')"


@query(f"""WITH s AS (SELECT item_id, k, CASE k WHEN 1 THEN w[1:(len(w) + 1) // 2] ELSE w[(len(w) + 1) // 2 + 1:] END AS w FROM ({_WORDS}), range(1, 3) t(k)),
 r AS (SELECT item_id, k, len(w) AS n, w, unnest(range(greatest(1, (len(w) + 2) // 3))) AS row FROM s),
 l AS (SELECT item_id, k, row, n, '| ' || array_to_string(list_transform(w[row * 3 + 1:row * 3 + 3], lambda x: {_CELL}), ' | ') || ' |' || CASE WHEN row = 0 THEN chr(10) || '|' || repeat(' --- |', least(n, 3)::INT) ELSE '' END AS line FROM r)
 SELECT item_id || '.xlsx' AS path, 'sheet' || k AS part, CASE k WHEN 1 THEN 'Front' ELSE 'Back' END AS title, '## ' || CASE k WHEN 1 THEN 'Front' ELSE 'Back' END || chr(10) || chr(10) || coalesce(string_agg(CASE WHEN n > 0 THEN line END, chr(10) ORDER BY row), '') AS markdown FROM l GROUP BY item_id, k""")
def sheet_files(spark, sf):
    """Workbooks of two sheets as tables in markdown."""
    return D.parse(_files(spark, sf, ".xlsx", _sheets)).select("path", "part", "title", "markdown")


def _slides(text: str) -> bytes:
    words = text.split()
    slides = {}
    for k in range(0, max(1, len(words)), 12):
        part = words[k : k + 12]
        shape = lambda kind, lines: f'<p:sp>{kind}<p:txBody>{"".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)}</p:txBody></p:sp>'
        title = shape('<p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr>', [" ".join(part[:3])])
        body = shape("", [" ".join(part[j : j + 5]) for j in range(3, len(part), 5)])
        slides[f"ppt/slides/slide{k // 12 + 1}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a">{title}{body}</p:sld>'
    return _zip(dict(reversed(slides.items())))  # in no order of their own


@query(f"""WITH s AS (SELECT item_id, unnest(range((len(w) + 11) // 12)) AS k, w FROM ({_WORDS})), p AS (SELECT item_id, k, w[k * 12 + 1:k * 12 + 12] AS w FROM s)
 SELECT item_id || '.pptx' AS path, 'slide' || (k + 1) AS part, '## Slide ' || (k + 1) || ': ' || array_to_string(w[1:3], ' ') || chr(10) || chr(10) || array_to_string(list_filter([array_to_string(w[4:8], ' '), array_to_string(w[9:12], ' ')], lambda x: x <> ''), chr(10)) AS markdown FROM p""")
def slide_files(spark, sf):
    """Presentations, a slide for each twelve words, title and body."""
    return D.parse(_files(spark, sf, ".pptx", _slides)).select("path", "part", "markdown")


def _book(text: str) -> bytes:
    page = lambda head, body: f"<html><head><style>p {{}}</style></head><body><nav>menu</nav><h1>{head}</h1><p>{escape(body)}</p></body></html>"
    words = text.split()
    half = len(words) // 2
    return _zip({"META-INF/container.xml": "<container/>", "OEBPS/one.xhtml": page("One", " ".join(words[:half])), "OEBPS/two.html": page("Two", " ".join(words[half:])), "OEBPS/nav.xhtml": page("Nav", "x"), "OEBPS/toc.html": page("Toc", "x")})


@query(f"""SELECT item_id || '.epub' AS path, part, trim('# ' || head || chr(10) || chr(10) || body, ' ' || chr(10)) AS markdown FROM (SELECT item_id, 'OEBPS/one.xhtml' AS part, 'One' AS head, array_to_string(w[1:len(w) // 2], ' ') AS body FROM ({_WORDS}) UNION ALL SELECT item_id, 'OEBPS/two.html', 'Two', array_to_string(w[len(w) // 2 + 1:], ' ') FROM ({_WORDS}))""")
def book_files(spark, sf):
    """Electronic books: chapters in order, without navigation pages."""
    return D.parse(_files(spark, sf, ".epub", _book)).select("path", "part", "markdown")


def _archive(text: str) -> bytes:
    words = text.split()
    return _zip({"docs/": "", "docs/all.md": text, "first.TXT": words[0], "b/c.md": words[-1], "noext": "", "x.py": "pass"})


@query(f"""SELECT item_id || '.zip' AS path, '5 files' || chr(10) || chr(10) || '- .md: 2' || chr(10) || '- (none): 1' || chr(10) || '- .py: 1' || chr(10) || '- .txt: 1' || chr(10) || chr(10) || '- docs/all.md (' || strlen(text) || ' B)' || chr(10) || '- first.TXT (' || strlen(w[1]) || ' B)' || chr(10)
 || '- b/c.md (' || strlen(w[-1]) || ' B)' || chr(10) || '- noext (0 B)' || chr(10) || '- x.py (4 B)' AS markdown FROM ({_WORDS})""")
def archive_files(spark, sf):
    """Archives: their entries, and how many there are of each kind."""
    return D.parse(_files(spark, sf, ".zip", _archive)).select("path", "markdown")


def _old_word(text: str) -> bytes:
    plain = "".join(c if " " <= c <= "~" else "?" for c in text)
    return bytes.fromhex("d0cf11e0a1b11ae1") + bytes(600) + plain.encode("utf-16-le") + b"\x00\x00\x01\x02" + "\r\rLast line".encode("utf-16-le") + bytes(8)


@query("SELECT item_id || '.doc' AS path, trim(regexp_replace(text, '[^ -~]', '?', 'g')) || chr(10) || 'Last line' AS markdown FROM benchmark")
def old_word_files(spark, sf):
    """Old word-processor files: readable runs of their bytes."""
    return D.parse(_files(spark, sf, ".doc", _old_word)).select("path", "markdown")


@query("""SELECT d.doc_id || k.ext AS path, CASE k.ext WHEN '.docx' THEN '' ELSE 'document' END AS part, CASE k.ext WHEN '.md' THEN text WHEN '.png' THEN '[media file, ' || strlen(text) || ' bytes]' ELSE '' END AS markdown,
 CASE k.ext WHEN '.docx' THEN 'BadZipFile: File is not a zip file' END AS error FROM documents d, (VALUES ('.md'), ('.png'), ('.docx')) k(ext)""")
def imported_files(spark, sf):
    """A folder of texts, media, files that can't be read and files of unknown kinds: a row or an error for each."""
    exts = F.explode(F.array(*map(F.lit, (".md", ".png", ".docx", ".unknown", ""))))
    files = T.load(spark, sf, "documents").select(F.col("doc_id"), F.col("text").cast("binary").alias("content"), exts.alias("ext"))
    return D.parse(files.select(F.concat("doc_id", "ext").alias("path"), "content")).select("path", "part", "markdown", "error")


@query("SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY ALL")
def saved_reports(spark, sf):
    """A report saved as JSON lines, one for each row, and read back."""
    out = work_folder(spark, "report")
    rows = T.load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("double").alias("quantity"))
    C.save_report(rows, out)
    return spark.read.schema("flag string, status string, lines long, quantity double").json(out)
