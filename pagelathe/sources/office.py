"""Spreadsheets and text documents as Office Open XML, read and written with the standard library.

Files are one archive each, so one task writes or reads one file; a table becomes as many files as it has keys.
Paths are of a file system that all executors see.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.shipping import in_pandas

_SHEET_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Fills by confidence: under 50, under 70, else.
FILLS = ("F4CCCC", "FFF2CC", "D9EAD3")
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _text(v: object) -> str:
    return escape(_CONTROL.sub("", str(v)))


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def _package(main: str, kind: str, body: str, more: dict[str, tuple[str, str, str]]) -> bytes:
    """An archive with one main part and related parts: name to (content type, relation, XML)."""
    folder = main.split("/")[0]
    types = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in [(main, kind), *((n, m[0]) for n, m in more.items())])
    rels = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/{m[1]}" Target="{n.split("/", 1)[1]}"/>' for i, (n, m) in enumerate(more.items(), 1))
    return _archive(
        {
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="{main}"/></Relationships>',
            main: body,
            f"{folder}/_rels/{main.split('/')[1]}.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{rels}</Relationships>',
            **{n: m[2] for n, m in more.items()},
        }
    )


def column_name(i: int) -> str:
    name = ""
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def xlsx(header: list[str], rows: Iterable[tuple], widths: list[int] | None = None, percent: int | None = None, sheet: str = "Extraction") -> bytes:
    """A workbook of one sheet: bold frozen header with a filter; the column ``percent`` is filled by its value."""

    def cell(r: int, c: int, v: object, style: int) -> str:
        at = f'r="{column_name(c)}{r}" s="{style}"'
        if v is None:
            return f"<c {at}/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c {at}><v>{v}</v></c>"
        return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{_text(v)}</t></is></c>'

    def band(c: int, v: object) -> int:
        return 0 if percent != c - 1 or not isinstance(v, (int, float)) else 2 if v < 50 else 3 if v < 70 else 4

    lines = ["".join(cell(1, c, h, 1) for c, h in enumerate(header, 1))]
    for r, row in enumerate(rows, 2):
        lines.append("".join(cell(r, c, v, band(c, v)) for c, v in enumerate(row, 1)))
    data = "".join(f'<row r="{r}">{x}</row>' for r, x in enumerate(lines, 1))
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths or [20] * len(header), 1))
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    body = f'<worksheet xmlns="{_SHEET_NS}">{view}<cols>{cols}</cols><sheetData>{data}</sheetData><autoFilter ref="A1:{column_name(len(header))}{len(lines)}"/></worksheet>'
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{x}"/></patternFill></fill>' for x in FILLS)
    styles = (
        f'<styleSheet xmlns="{_SHEET_NS}"><fonts count="2"><font/><font><b/></font></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>' + "".join(f'<xf fillId="{i}" applyFill="1"/>' for i in (2, 3, 4)) + "</cellXfs></styleSheet>"
    )
    book = f'<workbook xmlns="{_SHEET_NS}" xmlns:r="{_REL}"><sheets><sheet name="{_text(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>'
    return _package("xl/workbook.xml", "spreadsheetml.sheet.main", book, {"xl/worksheets/sheet1.xml": ("spreadsheetml.worksheet", "worksheet", body), "xl/styles.xml": ("spreadsheetml.styles", "styles", styles)})


def read_xlsx(content: bytes) -> list[list[str | None]]:
    """Cells of the first sheet as strings, shared or inline; gaps are null."""
    ns = f"{{{_SHEET_NS}}}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))))
    out = []
    for row in sheet.iter(f"{ns}row"):
        cells: dict[int, str | None] = {}
        for at, c in enumerate(row.iter(f"{ns}c")):
            letters = re.sub("[^A-Z]", "", c.get("r") or column_name(at + 1))
            i = 0
            for x in letters:
                i = i * 26 + ord(x) - 64
            v = c.find(f"{ns}v")
            inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            cells[i] = inline if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
        out.append([cells.get(i) for i in range(1, max(cells, default=0) + 1)])
    return out


def docx(pages: Iterable[tuple[int, str, list[str]]]) -> bytes:
    """(number, text, words of low confidence) of each page: a heading, paragraphs at blank lines, a break between pages."""

    def runs(text: str, low: list[str]) -> str:
        pattern = "|".join(re.escape(w) for w in sorted(set(filter(None, low)), key=len, reverse=True))
        parts = re.split(rf"(?<!\w)({pattern})(?!\w)", text) if pattern else [text]
        red = '<w:rPr><w:color w:val="FF0000"/></w:rPr>'
        return "".join(f'<w:r>{red * (i % 2)}<w:t xml:space="preserve">{_text(p)}</w:t></w:r>' for i, p in enumerate(parts) if p)

    body = []
    for k, (number, text, low) in enumerate(pages):
        body += ['<w:p><w:r><w:br w:type="page"/></w:r></w:p>'] * bool(k)
        body.append(f'<w:p><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>--- Page {number} ---</w:t></w:r></w:p>')
        body += [f"<w:p>{runs(p, low)}</w:p>" for p in re.split(r"\n\s*\n", text or "") if p.strip()]
    return _package("word/document.xml", "wordprocessingml.document.main", f'<w:document xmlns:w="{_WORD_NS}"><w:body>{"".join(body)}</w:body></w:document>', {})


def read_docx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        doc = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{{{_WORD_NS}}}t")) for p in doc.iter(f"{{{_WORD_NS}}}p")]


def _put(path: str, content: bytes) -> None:
    """All or nothing, so that a task that is run again leaves whole files."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(content)
    os.replace(part, path)


def write_files(df: DataFrame, folder: str, make: str, extension: str) -> DataFrame:
    """Write a file for each row (name, items array of struct): (name, path). Nothing is written before an action."""
    os.makedirs(folder, exist_ok=True)

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            paths = []
            for name, items in zip(f["name"], f["items"], strict=True):
                path = os.path.join(folder, re.sub(r"[^\w.\-]", "_", str(name)) + extension)
                rows = [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in items]
                if make == "docx":
                    content = docx((r[0], r[1], list(r[2]) if len(r) > 2 and r[2] is not None else []) for r in rows)
                else:
                    content = xlsx(list(items[0].keys()) if len(items) else [], rows)
                _put(path, content)
                paths.append(path)
            yield pd.DataFrame({"name": f["name"], "path": paths})

    return in_pandas(df.select(F.col("name").cast("string").alias("name"), "items"), batch, "name string, path string")


def write_docx(pages: DataFrame, folder: str) -> DataFrame:
    """A document for each ``doc`` of (doc, page, text, low_words)."""
    items = F.sort_array(F.collect_list(F.struct("page", "text", "low_words")))
    return write_files(pages.groupBy(F.col("doc").alias("name")).agg(items.alias("items")), folder, "docx", ".docx")


def write_xlsx(rows: DataFrame, key: str, columns: list[str], folder: str) -> DataFrame:
    """A workbook for each ``key`` with ``columns``, in their order."""
    items = F.sort_array(F.collect_list(F.struct(*columns)))
    return write_files(rows.groupBy(F.col(key).alias("name")).agg(items.alias("items")), folder, "xlsx", ".xlsx")


def read_workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, row, cells) of the first sheet of every workbook; unreadable files give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(folder)

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    out += [(path, i, cells) for i, cells in enumerate(read_xlsx(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError):
                    continue
            yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return in_pandas(files.select("path", "content"), batch, "path string, row int, cells array<string>")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, place, line) of the paragraphs of every document; unreadable files give no row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(folder)

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    out += [(path, i, line) for i, line in enumerate(read_docx(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError):
                    continue
            yield pd.DataFrame(out, columns=["path", "place", "line"])

    return in_pandas(files.select("path", "content"), batch, "path string, place int, line string")
