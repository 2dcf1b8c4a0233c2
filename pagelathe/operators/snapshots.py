"""Parsed rows as JSON, as sheets and as snapshots to hold corrections against; sinks that do not fail on a taken path."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.operators.forms import FIELDS, MISSING

#: Columns of a sheet, in order, and what a snapshot is.
SHEET = ("waybill", "date", "number", "shipper", "consignee", "cargo", "volume", "driver", "vehicle", "reception", "source", "note")
VERSION = 1
_JSON = "source string, waybill string, note string, " + ", ".join(f"{f} string" for f in FIELDS) + ", confidence struct<" + ", ".join(f"{f}:double" for f in FIELDS) + ">, overall_confidence double"


def to_json(rows: DataFrame) -> DataFrame:
    """(source, json) of parsed rows: fields by name, their confidences nested, the overall one beside."""
    confidence = F.struct(*[F.col(f"{f}_conf").alias(f) for f in FIELDS]).alias("confidence")
    whole = F.struct("source", "waybill", "note", *FIELDS, confidence, F.col("overall").alias("overall_confidence"))
    return rows.select("source", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    """Parsed rows of (json); keys that it lacks are null, MISSING for fields and 0 for confidences; overall is their mean."""
    r = texts.select(F.from_json("json", _JSON).alias("r")).where("r is not null").select("r.*")
    confs = [F.coalesce(F.col(f"confidence.{f}"), F.lit(0.0)) for f in FIELDS]
    overall = F.round(sum(confs[1:], confs[0]) / len(FIELDS), 2)
    return r.select("source", "waybill", "note", overall.alias("overall"), *[F.coalesce(f, F.lit(MISSING)).alias(f) for f in FIELDS], *[c.alias(f"{f}_conf") for f, c in zip(FIELDS, confs, strict=True)])


def sheet(rows: DataFrame) -> DataFrame:
    return rows.select(*SHEET)


def missing(sources: DataFrame, note: str = "") -> DataFrame:
    """A row of MISSING fields for each of (source)."""
    values = [F.lit(MISSING).alias(f) for f in FIELDS]
    return sources.select("source", F.lit("Транспортная накладная").alias("waybill"), F.lit(note).alias("note"), F.lit(0.0).alias("overall"), *values, *[F.lit(0.0).alias(f"{f}_conf") for f in FIELDS])


def snapshot(rows: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """Rows as a snapshot keeps them: source, each field with its confidence, overall, waybill, note; version and time beside."""
    pairs = [F.col(c) for f in FIELDS for c in (f, f"{f}_conf")]
    when = F.current_timestamp() if generated_at is None else generated_at
    return rows.select(F.lit(VERSION).alias("schema_version"), when.alias("generated_at"), "source", *pairs, F.col("overall").alias("overall_confidence"), "waybill", "note")


def save_snapshot(rows: DataFrame, path: str) -> None:
    """A snapshot as JSON, one row a line in as many files as tasks: nothing is gathered."""
    snapshot(rows).write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """A snapshot's rows; None if there is none, or none that can be read."""
    try:
        schema = spark.createDataFrame([], _FLAT).schema
        found = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        return None if found.where("source is not null").isEmpty() else found
    except Exception as e:  # noqa: BLE001  Spark names missing paths in several ways
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


_FLAT = "schema_version int, generated_at timestamp, source string, " + ", ".join(f"{f} string, {f}_conf double" for f in FIELDS) + ", overall_confidence double, waybill string, note string"


def write_csv(cells: DataFrame, path: str) -> None:
    """Cells of an evaluation as CSV with a heading."""
    cells.select("document", "profile", "dpi", "cer", "wer", "mean_conf", "elapsed_sec", "error").write.mode("overwrite").option("header", True).csv(path)


def write_safe(write: Callable[[str], None], path: str, now: datetime.datetime | None = None) -> str:
    """Write to ``path``; if that is refused, beside it under the time's name. The path that took it."""
    try:
        write(path)
    except Exception:  # noqa: BLE001  a locked, read-only or taken path shows in many ways
        stamp = (now or datetime.datetime.now()).strftime("%Y%m%d_%H%M%S")
        head, dot, end = path.rpartition(".")
        path = f"{head}_{stamp}.{end}" if dot and "/" not in end else f"{path}_{stamp}"
        write(path)
    return path


def write_sheet_safe(rows: DataFrame, write: Callable[[DataFrame, str], None], path: str) -> str:
    """A sheet by ``write``, and its snapshot beside it, wherever the sheet went."""
    taken = write_safe(lambda p: write(sheet(rows), p), path)
    save_snapshot(rows, f"{taken}.snapshot.json")
    return taken


def write_log_safe(lines: DataFrame, path: str) -> str:
    """Lines (pos, line) of a report, in order, as text."""
    return write_safe(lambda p: lines.orderBy("pos").select("line").coalesce(1).write.mode("errorifexists").text(p), path)
