"""Totals of corrections and of recognition against a known text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feedback_stats(corrections: DataFrame) -> DataFrame:
    """Per field: corrections by kind and the mean confidence of what was wrong."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("fix", "fill", "clear")]
    return corrections.groupBy("field").agg(F.count(F.lit(1)).alias("total"), *kinds, F.round(F.avg("original_confidence"), 4).alias("mean_conf"))


def confident_errors(corrections: DataFrame, least: float = 0.8) -> DataFrame:
    return corrections.where((F.col("kind") == "fix") & (F.col("original_confidence") >= least))


def char_errors(truth: Column, read: Column) -> Column:
    """Edit distance over the truth's length, both with single spaces; 0 for two empty texts, 1 for one."""
    a, b = (F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")) for c in (truth, read))
    return F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.round(F.levenshtein(a, b) / F.length(a), 4))


def outcomes(scored: DataFrame) -> DataFrame:
    """Per field of (field, ok), and in a row TOTAL: n_ok, n_fail, n_skip, and the whole percentage of those with an expectation."""
    ok, fail = F.count_if(F.col("ok")), F.count_if(~F.col("ok"))
    counts = scored.rollup("field").agg(ok.alias("n_ok"), fail.alias("n_fail"), F.count_if(F.col("ok").isNull()).alias("n_skip"), F.when(ok + fail > 0, F.floor(ok * 100 / (ok + fail))).alias("percent"), F.grouping("field").alias("__all"))
    return counts.withColumn("field", F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("field"))).drop("__all")


def word_errors(truth: Column, read: Column) -> Column:
    """Edit distance over words divided by the truth's words; each row's distance is one fold, in memory of one row of the table."""
    a, b = (F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: w != "") for c in (truth, read))
    first = F.sequence(F.lit(0), F.size(b))

    def line(row: Column, word: Column) -> Column:
        costs = F.zip_with(F.slice(row, 1, F.size(b)), F.zip_with(F.slice(row, 2, F.size(b)), b, lambda up, w: F.struct(up.alias("up"), (w != word).cast("int").alias("d"))), lambda diag, s: F.least(diag + s["d"], s["up"] + 1))
        start = F.array(F.get(row, F.lit(0)) + 1)
        return F.aggregate(costs, start, lambda out, c: F.concat(out, F.array(F.least(c, F.element_at(out, -1) + 1))))

    edits = F.element_at(F.aggregate(a, first, line), -1)
    return F.when(F.size(a) == 0, F.when(F.size(b) == 0, 0.0).otherwise(1.0)).when(F.size(b) == 0, 1.0).otherwise(edits / F.size(a))


def report(rows: DataFrame) -> DataFrame:
    """One row: files, files that failed, rows."""
    failed = F.col("note").startswith("ERROR")
    return rows.agg(F.count_distinct("source").alias("n_files"), F.count_distinct(F.when(failed, F.col("source"))).alias("n_failed"), F.count(F.lit(1)).alias("n_rows"))
