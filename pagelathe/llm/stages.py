"""The stages of the training-data pipeline: each takes (spark, docs, sf_dir) and gives rows of ``docs``' columns, the last one pieces.

All stages take null ids, null and empty texts, repeated rows, empty tables and other columns of any name,
and leave kept rows' other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import decontaminate, langid, near_copies, packing, pii
from pagelathe.llm.graph import quoted
from pagelathe.llm.queries import PII_KEY

#: A prediction stands out if its score is at least so many times a share of equal parts.
STANDS_OUT = 1.2


def _columns(names: list[str]) -> list:
    return [F.col(quoted(n)) for n in names]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language go; a null ``lang`` becomes the predicted one.

    Of no language are null texts, texts without a letter, and those whose prediction's score does not
    stand out from an equal share of the learned languages. If nothing can be learned (no text with a language), all go.
    """
    names = docs.columns
    model = langid.fit(docs.where(~langid.held_out()))
    told, score = (next(f"{n}{i}" for i in range(len(names) + 1) if f"{n}{i}" not in names) for n in ("told", "score"))
    out = langid.predict(docs, model, tuple(names), (told, score))
    out = out.where((F.col(told) != langid.UNDETERMINED) & (F.col(score) * max(len(model.languages), 1) >= min(STANDS_OUT, len(model.languages))))
    return out.select(*[F.coalesce("lang", told).alias("lang") if n == "lang" else F.col(quoted(n)) for n in names])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five-word shingles, Jaccard similarity 0.8 or more): the smallest id's.

    SimHash cannot give this: sets of similarity 0.8 differ in 9.7 of 64 bits on average, for which a covering would
    need thousands of tables. MinHash bands propose the pairs instead, and the whole sets decide; see ``near_copies``.
    """
    return near_copies.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go, each row by its own text. Null and empty texts stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms; ``n_chars`` follows the text. All rows stay; null text stays null."""
    names = docs.columns
    out = pii.pseudonymize(docs, PII_KEY)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*_columns(names))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of every row; a null text is its separator alone."""
    return packing.pack(docs)
