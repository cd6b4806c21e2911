"""Queries that write files in the formats of the sources and read them back."""

from __future__ import annotations

import io
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quiverlake.operators import parsing as P
from quiverlake.plans.registry import query
from quiverlake.session import work_folder
from quiverlake.sources import catalog as C
from quiverlake.sources import documents as D
from quiverlake.sources import tables as T


@query("SELECT 'd/' || CAST(doc_id AS VARCHAR) || '.md' AS path, sha256(text) AS hash FROM documents")
def packed_files(spark, sf):
    """Documents into packs and out of them again."""
    files = T.load(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").cast("binary").alias("content"))
    return D.unpack(D.pack(files)).select("path", F.sha2("content", 256).alias("hash"))


@query("SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, role, text AS content FROM conversations")
def session_files(spark, sf):
    """Talks as session files, one JSON object each."""
    out = work_folder(spark, "files")
    m = T.messages(spark, sf).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "content"))).alias("m"))
    info = F.struct(F.col("session_id").cast("string").alias("id"), F.lit("").alias("title")).alias("info")
    m.select(info, F.transform("m", lambda x: F.struct(x.role.alias("role"), x.content.alias("content"), F.lit("").alias("timestamp"))).alias("messages")).write.json(out)
    read = C.sessions(spark, out, whole_files=False)
    return read.select(F.col("session_id").cast("long").alias("session_id"), "seq", "role", "content")


@query("SELECT 'skills/' || CAST(page_id AS VARCHAR) AS path, 'page ' || CAST(page_id AS VARCHAR) AS name, url AS description, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def skill_files(spark, sf):
    """Pages as skill files: front matter and one section, read by name."""
    p = T.load(spark, sf, "pages").select(F.concat(F.lit("skills/"), "page_id").alias("path"), F.concat(F.lit("page "), "page_id").alias("name"), F.col("url").alias("description"), F.create_map(F.lit("title"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("sections"))
    read = C.skills(C.skill_markdown(p))
    return read.select("path", "name", "description", F.coalesce(F.try_element_at("sections", F.lit("title")), F.lit("")).alias("title"))


@query("SELECT doc_id, 'id: ' || CAST(doc_id AS VARCHAR) AS head, text AS body FROM documents")
def front_matters(spark, sf):
    t = T.load(spark, sf, "documents").select("doc_id", F.concat(F.lit("---\nid: "), "doc_id", F.lit("\n---\n"), "text").alias("text"))
    head, body = P.front_matter(F.col("text"))
    return t.select("doc_id", head.alias("head"), body.alias("body"))


@query("SELECT item_id AS id, text AS query, text AS ground_truth, CAST(length(text) % 3 AS INTEGER) AS retrieved FROM benchmark")
def dataset_files(spark, sf):
    """Benchmark items as an evaluation file, one sample each."""
    out = work_folder(spark, "files")
    docs = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.concat(F.lit("d"), k))
    sample = F.struct(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), F.array().cast("array<string>").alias("expected_docs"), F.col("text").alias("ground_truth"), F.slice(docs, F.lit(1), (F.length("text") % 3).cast("int")).alias("retrieved_docs"))
    T.load(spark, sf, "benchmark").select(F.lit("b").alias("name"), F.array(sample).alias("samples")).write.json(out)
    read = C.dataset(spark, out, whole_files=False)
    return read.select(F.col("id").cast("long").alias("id"), "query", "ground_truth", F.size("retrieved_docs").alias("retrieved"))


@query("SELECT conv_id, turn, 'As ' || role || ': ' || text || ' / ' AS prompt FROM conversations")
def prompts(spark, sf):
    """A prompt template filled from columns; a name without a value is empty."""
    filled = C.render_column("As {{ .role }}: {{.text}} / {{ .missing }}", {"role": F.col("role"), "text": F.col("text")})
    return T.load(spark, sf, "conversations").select("conv_id", "turn", filled.alias("prompt"))


@F.pandas_udf(BinaryType())
def _word_file(texts: pd.Series) -> pd.Series:
    """The smallest file of a word processor that holds the text, a paragraph a line."""

    def build(text: str) -> bytes:
        body = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{x.replace('&', '&amp;').replace('<', '&lt;')}</w:t></w:r></w:p>" for x in text.split("\n"))
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        return buffer.getvalue()

    return texts.map(build)


@query("SELECT CAST(item_id AS VARCHAR) || '.docx' AS path, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM benchmark")
def word_files(spark, sf):
    """Benchmark items as word-processor files, parsed again."""
    files = T.load(spark, sf, "benchmark").select(F.concat("item_id", F.lit(".docx")).alias("path"), _word_file(F.col("text")).alias("content"))
    words = F.size(F.filter(F.split("markdown", r"\s+"), lambda w: w != ""))
    return D.parse(files).groupBy("path").agg(F.sum(words).cast("long").alias("words"))


#: Words of a line and lines of a page of the files that are written below.
_LINE, _PAGE = 8, 5


def _pdf_bytes(text: str) -> bytes:
    """A file with compressed objects: pages in a tree of two levels, their numbers falling, and two fonts; every
    second line has codes of two bytes that only a map explains."""
    words = text.split()
    lines = [" ".join(words[k : k + _LINE]) for k in range(0, len(words), _LINE)]
    pages = [lines[k : k + _PAGE] for k in range(0, len(lines), _PAGE)]
    signs = sorted(set("".join(lines)))
    code = {c: k + 1 for k, c in enumerate(signs)}
    maps = "".join(f"<{k:04x}> <{c.encode('utf-16-be').hex()}>\n" for c, k in code.items())
    cmap = f"begincmap\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n{len(code)} beginbfchar\n{maps}endbfchar\nendcmap".encode()

    def shown(k: int, line: str) -> bytes:
        plain = all(ord(c) < 256 and not 127 <= ord(c) < 160 for c in line)
        if k % 2 == 0 and plain:
            raw = line.encode("cp1252").replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)")
            return b"/F1 12 Tf (" + raw + b") Tj T*"
        return b"/F2 12 Tf <" + "".join(f"{code[c]:04x}" for c in line).encode() + b"> Tj T*"

    n = len(pages)
    page, content = (lambda k: 10 + 2 * (n - k)), (lambda k: 11 + 2 * (n - k))
    half = (n + 1) // 2
    refs = lambda a, b: " ".join(f"{page(k)} 0 R" for k in range(a, b))
    held = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {n} /Kids [3 0 R 4 0 R] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
            3: f"<< /Type /Pages /Parent 2 0 R /Kids [{refs(0, half)}] >>", 4: f"<< /Type /Pages /Parent 2 0 R /Kids [{refs(half, n)}] >>",
            5: "<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>", 6: "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R >>"}
    held |= {page(k): f"<< /Type /Page /Parent 2 0 R /Contents {content(k)} 0 R >>" for k in range(n)}
    streams = {7: cmap} | {content(k): b"BT\n" + b"\n".join(shown(j, x) for j, x in enumerate(p)) + b"\nET" for k, p in enumerate(pages)}
    body, heads = b"", []
    for number, value in held.items():
        heads.append(f"{number} {len(body)}")
        body += value.encode() + b" "
    head = " ".join(heads).encode() + b" "
    out, places = bytearray(b"%PDF-1.5\n"), {}

    def put(number: int, extra: str, data: bytes) -> None:
        packed = zlib.compress(data)
        places[number] = len(out)
        out.extend(f"{number} 0 obj\n<< /Length {len(packed)} /Filter /FlateDecode {extra}>>\nstream\n".encode() + packed + b"\nendstream\nendobj\n")

    for number, data in streams.items():
        put(number, "", data)
    put(8, f"/Type /ObjStm /N {len(held)} /First {len(head)} ", head + body)
    order, size = list(held), 12 + 2 * n
    places[9] = len(out)
    rows = [(2, 8, order.index(k)) if k in held else (1, places[k], 0) if k in places else (0, 0, 0) for k in range(size)]
    before, table = bytes(7), b""
    for kind, a, b in rows:  # rows as differences to the row above
        row = bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
        table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before))
        before = row
    put(9, f"/Type /XRef /Size {size} /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >> ", table)
    return bytes(out) + f"startxref\n{places[9]}\n%%EOF".encode()


@F.pandas_udf(BinaryType())
def _pdf_file(texts: pd.Series) -> pd.Series:
    return texts.map(_pdf_bytes)


_PAGES = f"""SELECT item_id, k // {_PAGE} AS page, string_agg(line, chr(10) ORDER BY k) AS body FROM (SELECT item_id, k, array_to_string(w[k * {_LINE} + 1:k * {_LINE} + {_LINE}], ' ') AS line
 FROM (SELECT item_id, w, unnest(range((len(w) + {_LINE - 1}) // {_LINE})) AS k FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM benchmark))) GROUP BY 1, 2"""


@query(f"SELECT CAST(item_id AS VARCHAR) || '.pdf' AS path, string_agg('## Page ' || (page + 1) || chr(10) || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page) AS markdown FROM ({_PAGES}) GROUP BY 1")
def pdf_files(spark, sf):
    """Benchmark items as PDF files with compressed objects and two-byte fonts, read back whole."""
    files = T.load(spark, sf, "benchmark").select(F.concat("item_id", F.lit(".pdf")).alias("path"), _pdf_file(F.col("text")).alias("content"))
    return D.parse(files).select("path", "markdown")
