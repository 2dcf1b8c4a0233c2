"""Files as tables: scans of documents, texts and corrections, and their sinks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelathe.functions import repair as R
from pagelathe.shipping import in_arrow

#: The fields of a logged correction.
CORRECTION = "source string, field string, original string, corrected string, original_confidence double, kind string, timestamp string, excel_row int, context string"


def discover(spark: SparkSession, roots: list[str], recursive: bool = True) -> DataFrame:
    """(path, length, is_pdf) of the PDF files under ``roots``, each once, empty ones left out.

    Files are listed without their content; ``is_pdf`` is their first five bytes, read through the file system
    that the path names, so a file's size does not matter.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[pP][dD][fF]").load(roots)
    listed = found.where("length > 0").select("path", "length").dropDuplicates(["path"])

    def heads(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_head(p) == b"%PDF-" for p in b.column(0).to_pylist()])], names=["path", "length", "is_pdf"])

    return in_arrow(listed, heads, "path string, length long, is_pdf boolean")


def _head(path: str, n: int = 5) -> bytes:
    from pyarrow import fs

    try:
        system, place = fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)
        with system.open_input_file(place) as f:
            return f.read(n)
    except (OSError, ValueError):
        return b""


def stem(extension: str) -> Column:
    """The read file's name without its ending; paths come percent-encoded."""
    path = F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(path, rf"([^/]+?)\.{extension}$", 1)


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, stem, text): every text file whole."""
    t = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    return t.select(F.input_file_name().alias("path"), stem("txt").alias("stem"), F.col("value").alias("text"))


def best_text(plain: Column, blocks: Column, layout: Column) -> Column:
    """Of three readings of a page that with the most letters and digits, the first on ties."""
    score = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))
    a, b, c = score(plain), score(blocks), score(layout)
    return F.when((a >= b) & (a >= c), plain).when(b >= c, blocks).otherwise(layout)


def preferred(files: DataFrame, base: Column, rank: Column) -> DataFrame:
    """One row a base name, by rank and then path."""
    return files.withColumn("__k", F.row_number().over(Window.partitionBy(base).orderBy(rank, "path"))).where("__k = 1").drop("__k")


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """Logged corrections, one JSON a line; lines that do not parse are passed by."""
    return spark.read.schema(CORRECTION).option("mode", "DROPMALFORMED").json(path)


def append_corrections(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list with one on each line, stripped, blanks left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def page_text(page: Column, text: Column, error: Column, low_words: Column | None = None) -> Column:
    """A page under its heading: its text, low words in marks if given, or its error."""
    body = F.coalesce(text, F.lit("")) if low_words is None else R.mark_low_words(F.coalesce(text, F.lit("")), low_words)
    shown = F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("[ERROR: "), error, F.lit("]"))).otherwise(body)
    return F.concat(F.lit("--- Page "), page.cast("string"), F.lit(" ---\n\n"), shown, F.lit("\n"))


def export_text(pages: DataFrame) -> DataFrame:
    """(doc, text) of (doc, page, text, error): pages in order, one newline at the end. Texts of one document are one row."""
    p = pages.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", page_text(F.col("page"), F.col("text"), F.col("error")).alias("t")))).alias("ps"))
    return p.select("doc", F.concat(F.regexp_replace(F.array_join(F.col("ps.t"), "\n"), r"(?U)\s+$", ""), F.lit("\n")).alias("text"))


def human_bytes(size: Column) -> Column:
    """A size with its unit by powers of 1024; bytes whole, others with two places."""
    out, v = None, F.abs(size.cast("double"))
    sign = F.when(size < 0, "-").otherwise("")
    for i, unit in enumerate(("B", "KB", "MB", "GB", "TB", "PB")):
        scaled = v / float(1024**i)
        shown = F.concat(sign, F.format_string("%.0f" if i == 0 else "%.2f", scaled), F.lit(f" {unit}"))
        fits = (scaled < 1024) | F.lit(unit == "PB")
        out = F.when(fits, shown) if out is None else out.when(fits, shown)
    return out


def output_path(path: Column, suffix: str = "_ocr", extension: str | None = None) -> Column:
    """``<stem>_ocr<ext>`` beside the input."""
    return F.regexp_replace(path, r"(?s)^(.*?)(\.[^./]+)?$", f"$1{suffix}{extension}" if extension else f"$1{suffix}$2")


def dictionary(spark: SparkSession, path: str | None) -> DataFrame | None:
    """(entry, pos) of a list of words, each once at its first place; None without a list."""
    if path is None:
        return None
    try:
        lines = spark.read.text(path).select(F.trim("value").alias("entry"), F.monotonically_increasing_id().alias("pos")).where("entry <> ''")
    except Exception as e:  # noqa: BLE001  Spark names missing paths in several ways
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return lines.groupBy("entry").agg(F.min("pos").alias("pos"))
