"""PDF files written and read again, and files of other makers' kinds."""

from __future__ import annotations

import zlib

import pytest

from pagelathe.sources import files, pdf

CLASSIC = b"""%PDF-1.4
1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj
2 0 obj << /Type /Pages /Kids [3 0 R 6 0 R] /Count 2 /MediaBox [0 0 200 100] /Resources << /Font << /F1 5 0 R >> >> >> endobj
3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj
4 0 obj << /Length 99 >>
stream
BT /F1 10 Tf 14 TL 20 80 Td (Hello \\(big\\) w\\157rld) Tj T* [(kern) -250 (ed)] TJ 0 -14 Td <48 69> Tj (next) ' ET
endstream
endobj
5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj
6 0 obj << /Type /Page /Parent 2 0 R >> endobj
trailer << /Root 1 0 R >>"""


def test_written_pages_read_alike():
    grey = bytes(range(200)) * 3
    pages = [pdf.Page(300, 200, pdf.placed("Груз № 5\nline <two>\n\nvier ß"), (30, 20, grey)), pdf.Page(300, 200)]
    back = pdf.pages_of(pdf.pdf(pages))
    assert [s[4] for s in back[0].spans] == ["Груз № 5", "line <two>", "vier ß"] and back[0].image == (30, 20, grey)
    assert (back[1].width, back[1].height, back[1].has_text, back[1].image) == (300, 200, False, None)
    for a, b in zip(pages[0].spans, back[0].spans, strict=True):
        assert a[:2] == pytest.approx(b[:2], abs=0.02) and a[3] == pytest.approx(b[3], abs=0.02)


def test_other_makers_files():
    first, second = pdf.pages_of(CLASSIC)
    assert [s[4] for s in first.spans] == ["Hello (big) world", "kerned", "Hi", "next"]
    assert [round(s[3]) for s in first.spans] == [20, 34, 48, 62] and (first.width, first.height) == (200, 100) and not second.has_text
    packed = zlib.compress(b"2 0 3 60 << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 9 9] >>      << /Type /Page /Parent 2 0 R >>")
    streams = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length 1 >>\nstream\n" + packed + b"\nendstream endobj"
    assert len(pdf.pages_of(streams)) == 1
    for content, kind in ((b"no", pdf.Corrupt), (b"%PDF-1.4 x", pdf.Corrupt), (CLASSIC + b" /Encrypt 7 0 R", pdf.Encrypted), (CLASSIC.replace(b"[3 0 R 6 0 R]", b"[]"), pdf.Empty)):
        with pytest.raises(kind):
            pdf.pages_of(content)


def test_tables(spark, tmp_path):
    rows = [(1, 1, "Первая\nстраница"), (1, 2, None), (2, 1, "other")]
    folder = str(tmp_path / "p")
    assert pdf.write(spark.createDataFrame(rows, "doc long, page long, text string"), folder).count() == 2
    (tmp_path / "p" / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "p" / "2.txt").write_text("beside")
    pages = pdf.read(spark, folder)
    got = {(r.path.rsplit("/", 1)[1], r.page): (r.has_text, r.error) for r in pages.collect()}
    assert got == {("1.pdf", 1): (True, None), ("1.pdf", 2): (False, None), ("2.pdf", 1): (True, None), ("bad.pdf", None): (False, "Corrupt")}
    texts = pdf.with_sidecars(pdf.best_texts(pages), files.texts(spark, folder))
    assert {r.path.rsplit("/", 1)[1]: r.text for r in texts.collect()} == {"1.pdf": "Первая\nстраница\f", "2.pdf": "beside"}
    copies = pages.where("page = 1").selectExpr("path", f"concat('{tmp_path}/c/', regexp_extract(path, '[^/]+$', 0)) AS target")
    assert all(r.bytes > 100 for r in pdf.copy(copies).collect()) and pdf.read(spark, str(tmp_path / "c")).count() == 3
