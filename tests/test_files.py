"""Sources and sinks: round trips and small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelathe.sources import files, office


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x <&> я", 40.5), ("a", 2, None, 80.0), ("b", 1, "", 60.0)], "k string, n int, v string, c double")
    out = office.write_xlsx(df, "k", ["n", "v", "c"], str(tmp_path)).collect()
    assert {r["name"] for r in out} == {"a", "b"}
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    got = {(r["path"][-6:-5], r["row"]): r["cells"] for r in office.read_workbooks(spark, str(tmp_path)).collect()}
    assert got[("a", 0)] == ["n", "v", "c"] and got[("a", 1)] == ["1", "x <&> я", "40.5"] and got[("a", 2)][1] is None and len(got) == 5
    assert office.column_name(28) == "AB"


def test_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d", 2, "two", None), ("d", 1, "a bad day\n\nnext", ["bad"])], "doc string, page int, text string, low_words array<string>")
    path = office.write_docx(df, str(tmp_path)).collect()[0]["path"]
    content = open(path, "rb").read()
    assert [p for p in office.read_docx(content) if p] == ["--- Page 1 ---", "a bad day", "next", "--- Page 2 ---", "two"]


def test_scans(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "s" / "b.PDF").write_bytes(b"none")
    (tmp_path / "e.pdf").write_bytes(b"")
    (tmp_path / "a.txt").write_text("line\nnext")
    (tmp_path / "s" / "c + d%20.txt").write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: r["is_pdf"] for r in files.discover(spark, [str(tmp_path)]).collect()}
    assert got == {"a.pdf": True, "b.PDF": False}
    assert {(r["stem"], r["text"]) for r in files.texts(spark, str(tmp_path)).collect()} == {("a", "line\nnext"), ("c + d%20", "x")}
    assert sorted(r["word"] for r in files.word_list(spark, str(tmp_path / "a.txt")).collect()) == ["line", "next"]


def test_corrections(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([("s", "date", "a", "b", 0.5, "fix", "t", 2, "c")], files.CORRECTION)
    files.append_corrections(row, path)
    files.append_corrections(row, path)
    (tmp_path / "log" / "bad.json").write_text("{no\n")
    assert files.corrections(spark, path).count() == 2


def test_text_export(spark):
    df = spark.createDataFrame([("d", 2, None, "broken"), ("d", 1, "one  ", None)], "doc string, page int, text string, error string")
    assert files.export_text(df).collect()[0]["text"] == "--- Page 1 ---\n\none  \n\n--- Page 2 ---\n\n[ERROR: broken]\n"
    s = spark.createDataFrame([(5, "x/a.pdf"), (2048, "b"), (-3 * 1024**2, "c.d/e")], "n long, p string")
    assert [tuple(r) for r in s.select(files.human_bytes(F.col("n")), files.output_path(F.col("p"))).collect()] == [("5 B", "x/a_ocr.pdf"), ("2.00 KB", "b_ocr"), ("-3.00 MB", "c.d/e_ocr")]
