"""PDF files as tables of pages and placed spans, and pages with a text layer as PDF files; with the standard library only.

The reader takes what digital files and searchable scans have: Flate or plain streams, object streams, page trees, the text
operators, fonts of one byte or with a ToUnicode map. It knows no font's widths, so a span's right edge is an estimate of half the
size a sign. The writer lays text invisibly over an image, as recognition does. Decoding of other filters, of
encrypted files, and painting of pages stay outside: such files are rows with an error.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import text as T
from pagelathe.operators import layout
from pagelathe.shipping import in_pandas
from pagelathe.sources import files

Span = tuple[float, float, float, float, str]
SPANS = "array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"


class Corrupt(ValueError):
    """No PDF, or one whose pages cannot be found."""


class Encrypted(ValueError):
    """A PDF that needs a key."""


class Empty(ValueError):
    """A PDF without pages."""


@dataclass
class Page:
    width: float
    height: float
    spans: list[Span] = field(default_factory=list)
    #: Width, height and grey bytes of the page's first image.
    image: tuple[int, int, bytes] | None = None

    @property
    def has_text(self) -> bool:
        return any(s[4].strip() for s in self.spans)


# --- reading -----------------------------------------------------------------------------------
_OBJECT = re.compile(rb"(?s)(\d+)\s+\d+\s+obj\b(.*?)\bendobj")
_STREAM = re.compile(rb"(?s)^(.*?)\bstream\r?\n(.*?)\r?\n?endstream")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _objects(content: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """By number each object's dictionary and its decoded stream, if it has one that can be decoded."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    for m in _OBJECT.finditer(content):
        parts = _STREAM.match(m[2])
        out[int(m[1])] = (parts[1], _decoded(parts[1], parts[2])) if parts else (m[2], None)
    for head, body in list(out.values()):
        if b"/ObjStm" in head and body:
            first, n = int(_value(head, b"First") or 0), int(_value(head, b"N") or 0)
            numbers = [int(x) for x in body[:first].split()[: 2 * n]]
            places = [*numbers[1::2], len(body) - first]
            for number, a, b in zip(numbers[::2], places, places[1:], strict=False):
                out.setdefault(number, (body[first + a : first + b], None))
    return out


def _decoded(head: bytes, raw: bytes) -> bytes | None:
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(raw)
        except zlib.error:
            return None
    return None if b"/Filter" in head else raw


def _value(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"/" + name + rb"\s*(\d+\s+\d+\s+R|[-+\d.]+|/[^\s/<>\[\]()]+|\[[^\]]*\]|<<.*?>>)", head, re.S)
    return m[1] if m else None


def _followed(objects: dict, head: bytes, name: bytes) -> bytes:
    """A dictionary's entry, through a reference if it is one."""
    m = re.search(rb"/" + name + rb"\s*(\d+)\s+\d+\s+R", head)
    if m:
        return objects.get(int(m[1]), (b"", None))[0]
    at = re.search(rb"/" + name + rb"\s*<<", head)
    if not at:
        return b""
    depth, i = 1, at.end()
    while depth and i < len(head):
        step = {b"<<": 1, b">>": -1}.get(head[i : i + 2], 0)
        depth, i = depth + step, i + (2 if step else 1)
    return head[at.end() : i - 2]


def _unicode_map(body: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"(?s)beginbfchar(.*?)endbfchar", body):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"(?s)beginbfrange(.*?)endbfrange", body):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = int(c, 16)
            out |= {code: chr(first + code - int(a, 16)) for code in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)}
    return out


@dataclass
class _Font:
    wide: bool = False
    codes: dict[int, str] = field(default_factory=dict)

    def text(self, raw: bytes) -> str:
        if self.wide:
            codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)]
            return "".join(self.codes.get(c, "�") for c in codes)
        return "".join(self.codes.get(c) or bytes([c]).decode("cp1252", "replace") for c in raw)


def _fonts(objects: dict, resources: bytes) -> dict[bytes, _Font]:
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", _followed(objects, resources, b"Font")):
        head = objects.get(int(number), (b"", None))[0]
        m = re.search(rb"/ToUnicode\s+(\d+)", head)
        body = objects.get(int(m[1]), (b"", None))[1] if m else None
        out[name] = _Font(b"/Type0" in head, _unicode_map(body) if body else {})
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    take = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r\n") else m[1])
    return re.sub(rb"(?s)\\([0-7]{1,3}|\r\n|.)", take, token[1:-1])


def _spans(body: bytes, fonts: dict[bytes, _Font], height: float) -> list[Span]:
    """Shown strings with their boxes; y runs down from the page's top."""
    out: list[Span] = []
    stack: list = []
    font, size, lead = _Font(), 12.0, 0.0
    line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    move = lambda m, x, y: (*m[:4], m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])

    def show(text: str) -> None:
        nonlocal at
        scale = abs(at[3]) or abs(at[1]) or 1.0
        if text:
            wide = 0.5 * size * len(text)
            out.append((at[4], height - at[5] - size * scale, at[4] + wide * (abs(at[0]) or scale), height - at[5], text))
            at = move(at, wide, 0)

    for m in _TOKEN.finditer(body):
        t = m[0]
        kind = t[:1]
        if kind in b"(<" and kind:
            stack.append(_string(t))
        elif kind == b"/":
            stack.append(t)
        elif kind in (b"[", b"]"):
            stack.append(t)
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", t):
            stack.append(float(t))
        else:
            numbers = [x for x in stack if isinstance(x, float)]
            strings = [x for x in stack if isinstance(x, bytes) and x[:1] != b"/" and x not in (b"[", b"]")]
            if t == b"BT":
                line = at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
            elif t == b"Tf" and numbers:
                names = [x for x in stack if isinstance(x, bytes) and x[:1] == b"/"]
                font, size = fonts.get(names[-1][1:], _Font()) if names else _Font(), numbers[-1]
            elif t == b"TL" and numbers:
                lead = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) >= 2:
                lead = -numbers[-1] if t == b"TD" else lead
                line = at = move(line, numbers[-2], numbers[-1])
            elif t == b"Tm" and len(numbers) >= 6:
                line = at = tuple(numbers[-6:])
            elif t == b"T*" or t in (b"'", b'"'):
                line = at = move(line, 0, -lead)
            if t in (b"Tj", b"TJ", b"'", b'"'):
                show("".join(font.text(x) for x in strings))
            stack = []
    return out


def pages_of(content: bytes) -> list[Page]:
    """Pages in order. Raises Corrupt, Encrypted or Empty."""
    if content[:1024].find(b"%PDF-") < 0:
        raise Corrupt("no header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        raise Encrypted("encrypted")
    objects = _objects(content)
    root = next((h for h, _ in objects.values() if re.search(rb"/Type\s*/Catalog", h)), None)
    top = re.search(rb"/Pages\s+(\d+)", root) if root else None
    if not top:
        raise Corrupt("no catalog")
    out: list[Page] = []
    todo, seen = [(int(top[1]), b"", b"")], set()
    while todo:
        number, box, resources = todo.pop(0)
        if number in seen or number not in objects:
            continue
        seen.add(number)
        head, _ = objects[number]
        box = _value(head, b"MediaBox") or box
        resources = _followed(objects, head, b"Resources") or resources
        kids = re.search(rb"/Kids\s*\[([^\]]*)\]", head)
        if kids:
            todo = [(int(k), box, resources) for k in _REF.findall(kids[1])] + todo
            continue
        edges = [float(x) for x in re.findall(rb"[-+\d.]+", box)] or [0.0, 0.0, 595.0, 842.0]
        page = Page(edges[2] - edges[0], edges[3] - edges[1])
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        fonts = _fonts(objects, resources)
        for ref in _REF.findall(contents[1]) if contents else []:
            page.spans += _spans(objects.get(int(ref), (b"", None))[1] or b"", fonts, page.height)
        for ref in _REF.findall(_followed(objects, resources, b"XObject")):
            picture, data = objects.get(int(ref), (b"", None))
            w, h = (int(_value(picture, k) or 0) for k in (b"Width", b"Height"))
            if b"/Image" in picture and b"/DeviceGray" in picture and data is not None and len(data) >= w * h > 0:
                page.image = page.image or (w, h, data[: w * h])
        out.append(page)
    if not out:
        raise Empty("no pages")
    return out


# --- writing -----------------------------------------------------------------------------------
def pdf(pages: list[Page]) -> bytes:
    """A file of pages: the image, if there is one, over the whole page, and the spans as an invisible layer of text."""
    signs = sorted({c for p in pages for s in p.spans for c in s[4]})
    code = {c: i + 1 for i, c in enumerate(signs)}
    pairs = [f"<{i:04x}> <{c.encode('utf-16-be').hex()}>" for c, i in code.items()]
    blocks = "".join(f"{len(pairs[i : i + 100])} beginbfchar\n" + "\n".join(pairs[i : i + 100]) + "\nendbfchar\n" for i in range(0, len(pairs), 100))
    cmap = f"/CIDInit /ProcSet findresource begin\nbegincmap\n1 begincodespacerange\n<0000> <ffff>\nendcodespacerange\n{blocks}endcmap\n"
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 4 0 R >>", _stream(b"", cmap.encode()), b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> >>"]
    kids = []
    for p in pages:
        lines, pictures = [], b""
        if p.image:
            w, h, data = p.image
            objects.append(_stream(f"/Type /XObject /Subtype /Image /Width {w} /Height {h} /ColorSpace /DeviceGray /BitsPerComponent 8 ".encode(), data))
            pictures = b" /XObject << /I %d 0 R >>" % len(objects)
            lines.append(f"q {p.width:.2f} 0 0 {p.height:.2f} 0 0 cm /I Do Q")
        for x0, y0, _, y1, text in p.spans:
            shown = "".join(f"{code[c]:04x}" for c in text)
            lines.append(f"BT 3 Tr /F {max(y1 - y0, 1.0):.2f} Tf 1 0 0 1 {x0:.2f} {p.height - y1:.2f} Tm <{shown}> Tj ET")
        objects.append(_stream(b"", "\n".join(lines).encode()))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Resources << /Font << /F 3 0 R >>%s >> /Contents %d 0 R >>" % (p.width, p.height, pictures, len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, places = bytearray(b"%PDF-1.5\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % at for at in places)
    out += b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table, len(objects) + 1, len(out))
    return bytes(out)


def _stream(head: bytes, body: bytes) -> bytes:
    packed = zlib.compress(body)
    return b"<< %s/Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(packed), packed)


def placed(text: str, width: float = 595.0, height: float = 842.0, size: float = 10.0) -> list[Span]:
    """Lines of a text down a page."""
    return [(40.0, 40.0 + 1.4 * size * i, 40.0 + 0.5 * size * len(x), 40.0 + 1.4 * size * i + size, x) for i, x in enumerate(text.split("\n")) if x]


# --- tables ------------------------------------------------------------------------------------
def write(pages: DataFrame, folder: str) -> DataFrame:
    """A file for each ``doc`` of (doc, page, text): (doc, path). A document's pages are one row; files are whole or not there."""
    os.makedirs(folder, exist_ok=True)
    docs = pages.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            paths = []
            for doc, items in zip(f["doc"], f["pages"], strict=True):
                path = os.path.join(folder, re.sub(r"[^\w.\-]", "_", doc) + ".pdf")
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(pdf([Page(595.0, 842.0, placed(x["text"])) for x in items]))
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"doc": f["doc"], "path": paths})

    return in_pandas(docs, batch, "doc string, path string")


def assemble(images: DataFrame, folder: str, dpi: int = 300) -> DataFrame:
    """A file for each ``doc`` of (doc, page, height, width, data), grey bytes: (doc, path). A pixel is 72 / ``dpi`` points."""
    os.makedirs(folder, exist_ok=True)
    docs = images.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.sort_array(F.collect_list(F.struct("page", "height", "width", "data"))).alias("pages"))

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            paths = []
            for doc, items in zip(f["doc"], f["pages"], strict=True):
                path = os.path.join(folder, re.sub(r"[^\w.\-]", "_", doc) + ".pdf")
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as out:
                    out.write(pdf([Page(x["width"] * 72 / dpi, x["height"] * 72 / dpi, image=(x["width"], x["height"], bytes(x["data"]))) for x in items]))
                os.replace(part, path)
                paths.append(path)
            yield pd.DataFrame({"doc": f["doc"], "path": paths})

    return in_pandas(docs, batch, "doc string, path string")


def rasters(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page, height, width, data) of pages that are one grey image, as scans are; others have null data."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(folder)

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, i, p.image[1], p.image[0], p.image[2]) if p.image else (path, i, 0, 0, None) for i, p in enumerate(pages_of(content), 1)]
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "page", "height", "width", "data"])

    return in_pandas(found.select("path", "content"), batch, "path string, page int, height int, width int, data binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(path, page, width, height, has_text, spans, error): a row a page; of a file that cannot be read one row, with the kind of error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", True).load(folder)

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    rows += [(path, i, p.width, p.height, p.has_text, [dict(zip(("x0", "y0", "x1", "y1", "text"), s, strict=True)) for s in p.spans], None) for i, p in enumerate(pages_of(content), 1)]
                except Exception as e:  # noqa: BLE001  one file must not end a scan
                    rows.append((path, None, None, None, False, [], type(e).__name__))
            out = pd.DataFrame(rows, columns=["path", "page", "width", "height", "has_text", "spans", "error"])
            yield out.astype({"page": "Int32", "width": "Float64", "height": "Float64"})

    return in_pandas(found.select("path", "content"), batch, f"path string, page int, width double, height double, has_text boolean, spans {SPANS}, error string")


def plain(spans: Column) -> Column:
    """Strings in the file's own order, a new line where the height changes."""
    def step(s: Column, x: Column) -> Column:
        gap = F.when(s["text"] == "", F.lit("")).when(F.abs(s["y"] - x["y0"]) > 1, F.lit("\n")).otherwise(F.lit(" "))
        return F.struct(F.concat(s["text"], gap, x["text"]).alias("text"), x["y0"].alias("y"))

    return F.aggregate(spans, F.struct(F.lit("").alias("text"), F.lit(0.0).alias("y")), step, lambda s: s["text"])


def blocks(spans: Column) -> Column:
    """Strings by height and then place, each a block, parted by blank lines."""
    return F.array_join(F.transform(F.sort_array(F.transform(spans, lambda x: F.struct(x["y0"].alias("y"), x["x0"].alias("x"), x["text"].alias("t")))), lambda x: x["t"]), "\n\n")


def spans(pages: DataFrame) -> DataFrame:
    """(doc, page, page_width, x0, y0, x1, y1, text) of each page's spans that are not blank."""
    rows = pages.select(F.col("path").alias("doc"), "page", F.col("width").alias("page_width"), F.explode("spans").alias("s"))
    return rows.select("doc", "page", "page_width", "s.*").where(F.trim("text") != "")


def best_texts(pages: DataFrame) -> DataFrame:
    """(path, text): of each page the best of its three readings, pages parted by form feeds; (path, page) of errors give none."""
    good = pages.where("error is null")
    laid = layout.page_texts(spans(good)).select(F.col("doc").alias("path"), "page", F.col("text").alias("laid"))
    each = good.join(laid, ["path", "page"], "left").select("path", "page", files.best_text(plain(F.col("spans")), blocks(F.col("spans")), F.coalesce("laid", F.lit(""))).alias("text"))
    return each.groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text")))["text"], "\f").alias("text"))


def raw_texts(pages: DataFrame) -> DataFrame:
    return best_texts(pages).select("path", T.normalize(F.col("text")).alias("text"))


def with_sidecars(pdfs: DataFrame, texts: DataFrame) -> DataFrame:
    """(path, text) of read files, from a text file (stem, text) of the same name where there is one."""
    name = F.regexp_extract("path", r"([^/]+)\.[pP][dD][fF]$", 1)
    own = texts.select("stem", F.col("text").alias("beside"))
    return pdfs.withColumn("stem", name).join(own, "stem", "left").select("path", F.coalesce("beside", "text").alias("text"))


def copy(files_: DataFrame) -> DataFrame:
    """Copy (path, target) of a searchable file, nothing if they are one: (target, bytes)."""

    def batch(frames: Iterator) -> Iterator:
        import shutil

        import pandas as pd

        for f in frames:
            sizes = []
            for path, target in zip(f["path"], f["target"], strict=True):
                path = re.sub(r"^file:/*", "/", path)
                if os.path.realpath(path) != os.path.realpath(target):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    shutil.copyfile(path, part)
                    os.replace(part, target)
                sizes.append(os.path.getsize(target))
            yield pd.DataFrame({"target": f["target"], "bytes": sizes})

    return in_pandas(files_.select("path", "target"), batch, "target string, bytes long")
