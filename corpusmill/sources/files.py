"""Files as sources: recursive scans, types by suffix, conversion to Markdown inside tasks.

Conversion runs on Arrow batches of binaryFile rows with the standard library alone; a file that
fails becomes a placeholder row of quality ``failed``. Nothing is fetched from a network.
"""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from .tables import html_to_markdown  # noqa: F401  for HTML bodies as Columns

# Source types by suffix.
TYPES = {
    "md": "markdown", "markdown": "markdown", "txt": "plain_text", "text": "plain_text", "pdf": "pdf", "docx": "docx", "doc": "doc", "csv": "spreadsheet", "xls": "spreadsheet", "xlsx": "spreadsheet", "ppt": "presentation", "pptx": "presentation",
    "html": "html", "htm": "html", "json": "structured_text", "xml": "structured_text", "yaml": "structured_text", "yml": "structured_text", "zip": "archive", "epub": "ebook", "ipynb": "notebook", "eml": "email", "msg": "email", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image",
}
CONVERTED = "text string, extraction_method string, extraction_quality string, warnings array<string>"


def source_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))[suffix], F.lit("unknown"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, source_type, source_hash, content) of files below a root, none under a dot name."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = T.sub("path", r"^[a-z]+:/*(?=/)")
    below = T.sub(path, r"^.*?" + re.escape(root.split(":")[-1].strip("/")) + "/*")
    return rows.where(~below.rlike(r"(?:^|/)\.")).select(F.concat(F.lit("raw/"), below).alias("source_path"), source_type(F.col("path")).alias("source_type"), F.sha2("content", 256).alias("source_hash"), "content")


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a padded Markdown table, the first as its head."""
    rows = [[str(c).replace("|", "/").replace("\n", " ").strip() for c in r] for r in rows if any(str(c).strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * width, *rows[1:]])


def _decode(data: bytes) -> str:
    for code in ("utf-8-sig", "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "gb18030"):
        try:
            return data.decode(code)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def from_csv(data: bytes) -> str:
    return table_markdown(list(csv.reader(io.StringIO(_decode(data)))))


def from_docx(data: bytes) -> str:
    """Paragraphs, headings by style, and tables of a Word file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{w}body")
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body:
        if e.tag == f"{w}tbl":
            out.append(table_markdown([[words(c) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]))
        elif e.tag == f"{w}p" and words(e):
            style = e.find(f"{w}pPr/{w}pStyle")
            level = re.search(r"(?:heading|标题)\s*(\d)", style.get(f"{w}val", ""), re.I) if style is not None else None
            out.append("#" * int(level[1]) + " " + words(e) if level else words(e))
    return "\n\n".join(x for x in out if x)


def from_xlsx(data: bytes) -> str:
    """One section per sheet, with its cells as a table."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(data))
    names = z.namelist()
    shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    out = []
    for k, name in enumerate(sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), 1):
        rows = []
        for r in ElementTree.fromstring(z.read(name)).iter(f"{m}row"):
            cells: dict[int, str] = {}
            for c in r.iter(f"{m}c"):
                column = 0
                for ch in re.match("[A-Z]*", c.get("r", "A"))[0]:
                    column = column * 26 + ord(ch) - 64
                v = c.find(f"{m}v")
                value = "".join(t.text or "" for t in c.iter(f"{m}t")) if v is None else v.text or ""
                cells[column] = shared[int(value)] if c.get("t") == "s" and value else value
            rows.append([cells.get(i, "") for i in range(1, max(cells, default=0) + 1)])
        out.append(f"## 工作表 {k}\n\n{table_markdown(rows)}")
    return "\n\n".join(out)


def snippets(data: bytes, limit: int = 20, least: int = 6) -> list[str]:
    """Distinct readable runs of a binary file, ASCII and UTF-16, in order."""
    found = [m[0].decode() for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]
    found += [m[0].decode("utf-16-le", "ignore") for m in re.finditer(rb"(?:[\x20-\x7e]\x00|[\x00-\xff][\x4e-\x9f]){%d,}" % least, data)]
    seen: dict[str, str] = {}
    for s in (re.sub(r"\s+", " ", x).strip() for x in found):
        if len(s) >= least and any(c.isalpha() for c in s):
            seen.setdefault(s.lower(), s)
    return list(seen.values())[:limit]


def from_pdf(data: bytes) -> str:
    """Literal strings of a PDF's text objects, plain and deflated, by page count."""
    streams = [data]
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            streams.append(zlib.decompress(m[1]))
        except zlib.error:
            continue
    said = [re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1").strip() for part in streams for block in re.findall(rb"BT(.*?)ET", part, re.S) for s in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", block)]
    pages = len(re.findall(rb"/Type\s*/Page\b", data))
    return f"## 第 1-{max(pages, 1)} 页\n\n" + "\n".join(dict.fromkeys(s for s in said if s)) if said else ""


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height of a PNG, JPEG or WEBP."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    return None


def from_notebook(data: bytes) -> str:
    cells = json.loads(_decode(data)).get("cells", [])
    join = lambda s: "".join(s) if isinstance(s, list) else s
    return "\n\n".join(join(c["source"]) if c.get("cell_type") == "markdown" else f"```\n{join(c['source'])}\n```" for c in cells)


def convert(path: str, kind: str, data: bytes) -> tuple[str, str, str, list[str]]:
    """(text, method, quality, warnings) of one file."""
    name = path.rsplit("/", 1)[-1]
    try:
        if kind in ("markdown", "plain_text", "structured_text", "html", "email"):
            text, method = _decode(data), "text"
        elif kind == "image":
            size = image_size(data)
            return f"# {name}\n\nImage of {size[0]} x {size[1]}\n" if size else f"# {name}\n\nImage\n", "image_header", "partial" if size else "poor", []
        elif kind == "notebook":
            text, method = from_notebook(data), "ipynb"
        elif kind == "docx":
            text, method = from_docx(data), "docx_xml"
        elif kind == "pdf":
            text, method = from_pdf(data), "pdf_strings"
        elif kind == "spreadsheet" and data[:2] == b"PK":
            text, method = from_xlsx(data), "xlsx_xml"
        elif kind == "spreadsheet" and not path.lower().endswith(".xls"):
            text, method = from_csv(data), "csv"
        elif kind == "unknown":
            return f"# {name}\n\nUnknown type.\n", "placeholder", "poor", ["unknown_source_type"]
        else:
            found = snippets(data)
            return f"# {name}\n\n" + "\n".join(f"- {s}" for s in found), "snippets", "partial" if found else "poor", ["snippets_only"]
        return text, method, "good" if text.strip() else "poor", [] if text.strip() else ["empty_text"]
    except Exception as e:  # a broken file must not end the job
        return f"# {name}\n\nNot converted.\n", "placeholder", "failed", [f"conversion_failed:{type(e).__name__}"]


def converted(files: DataFrame) -> DataFrame:
    """Source rows of scanned files, with how their text was got; HTML becomes Markdown as a Column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [convert(p, k, bytes(c)) for p, k, c in zip(b["source_path"], b["source_type"], b["content"])]
            yield pd.concat([b[["source_path", "source_type", "source_hash"]].reset_index(drop=True), pd.DataFrame(got, columns=["text", "extraction_method", "extraction_quality", "warnings"])], axis=1)

    rows = files.mapInPandas(run, f"source_path string, source_type string, source_hash string, {CONVERTED}")
    text = F.when(F.col("source_type") == "html", html_to_markdown(F.col("text"))).otherwise(F.col("text"))
    title = F.coalesce(F.nullif(F.regexp_extract("text", r"(?m)^#\s+([^\n]+)$", 1), F.lit("")), T.sub("source_path", "^.*/"))
    return rows.select(ids.source_id(F.col("source_path"), F.col("source_hash")).alias("source_id"), "source_path", "source_type", F.xxhash64("source_path").alias("ord"), title.alias("title"), "source_hash", T.normalize_document(text).alias("text"), "extraction_method", "extraction_quality", "warnings")


def embedded_images(sources: DataFrame, assets: DataFrame) -> DataFrame:
    """(source_id, pos, alt, target, found): images that texts embed, joined to scanned assets by path."""
    each = sources.select("source_id", "source_path", F.posexplode(T.images("text")).alias("pos", "i"))
    path = F.concat(T.sub("source_path", "[^/]*$"), T.sub("i.target", r"^\./"))
    each = each.select("source_id", "pos", "i.alt", "i.target", path.alias("asset"))
    return each.join(assets.select(F.col("source_path").alias("asset"), F.lit(True).alias("found")), "asset", "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("asset")
