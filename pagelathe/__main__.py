"""``python -m pagelathe``: parse texts, score them against annotations, keep contracts, tell of corrections, run a query."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import repair as R
from pagelathe.operators import annotations as A
from pagelathe.operators import evaluation as E
from pagelathe.operators import reports as P
from pagelathe.operators import waybills as B
from pagelathe.plans import catalog
from pagelathe.sources import files, office


def _parsed(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    texts = files.texts(spark, a.inputs)
    rows = B.parse(texts.select(F.col("stem").alias("source"), R.normalize_cyrillic(F.col("text")).alias("text")), a.today)
    number = F.regexp_extract("source", "#([0-9]+)$", 1)
    return rows.withColumn("stem", F.regexp_replace("source", "#[0-9]+$", "")).withColumn("row", F.coalesce(number.try_cast("int"), F.lit(1)))


def parse(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rows of the texts of a folder, as JSON lines, or as a workbook a source."""
    rows = _parsed(spark, a).drop("stem", "row")
    if a.workbooks:
        return office.write_xlsx(rows, "source", ["source", "waybill", *B.FIELDS, "overall", "note"], a.output)
    rows.write.mode("overwrite").json(a.output)
    return E.report(spark.read.schema(B.SCHEMA).json(a.output))


def score(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return A.totals(A.score(_parsed(spark, a), A.annotations(spark, a.expected))).orderBy("field")


def update(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Contracts of what is read now, as Parquet in a new folder; those of ``--held`` stay."""
    fresh = A.contracts(_parsed(spark, a))
    (A.merged_contracts(spark.read.parquet(a.held), fresh) if a.held else fresh).write.parquet(a.output)
    return spark.read.parquet(a.output).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def verify(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Contracts that are broken."""
    return A.broken_contracts(_parsed(spark, a), spark.read.parquet(a.held))


def stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    log = files.corrections(spark, a.log)
    return P.common_corrections(log, a.top) if a.top else E.feedback_stats(log)


def query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return catalog.queries()[a.name](spark, a.tables)


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pagelathe", description=__doc__)
    sub = p.add_subparsers(required=True)

    def command(f, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(f.__name__, help=f.__doc__)
        for name, more in options:
            c.add_argument(name, **more)
        c.set_defaults(run=f)

    need = {"required": True}
    inputs = (("--inputs", need), ("--today", {"required": True, "help": "YYYY-MM-DD"}))
    command(parse, *inputs, ("--output", need), ("--workbooks", {"action": "store_true"}))
    command(score, *inputs, ("--expected", need))
    command(update, *inputs, ("--output", need), ("--held", {}))
    command(verify, *inputs, ("--held", need))
    command(stats, ("--log", need), ("--top", {"type": int, "default": 0}))
    command(query, ("name", {"choices": sorted(catalog.queries()), "metavar": "NAME"}), ("--tables", need))
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Prints JSON lines; 1 if contracts are broken."""
    a = arguments().parse_args(argv)
    from pagelathe.shipping import ship

    out = a.run(ship(spark or SparkSession.builder.appName("pagelathe").getOrCreate()), a)
    n = 0
    for n, line in enumerate(out.toJSON().toLocalIterator(), 1):  # noqa: B007
        print(line)
    return int(a.run is verify and n > 0)


if __name__ == "__main__":
    sys.exit(main())
