"""Steps whose cost on larger tables shows in their plans, or in what they call: one test for each finding of a round."""

from __future__ import annotations

import datetime
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelathe.operators import annotations as A
from pagelathe.operators import images as I
from pagelathe.operators import lookups as L
from pagelathe.operators import waybills as B
from pagelathe.plans import catalog, catalog_pages

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def parsed(spark):
    other = ", ".join(f"'{f}' {f}" for f in A.CONTRACT if f not in ("number", "cargo"))
    return spark.sql(f"SELECT * FROM VALUES ('a', '1', 'x', 0.9D), ('b', '2', 'y', 0.1D), ('c', '3', NULL, 0.5D) AS t(source, number, cargo, overall), (SELECT {other})")


def test_contracts_meet_whole_rows_without_a_broadcast(spark, parsed):
    """rows parsed of a small file are many times its size; Spark took them for small, and the driver for a broadcast."""
    held = spark.sql(
        """SELECT * FROM VALUES ('a', 'number', '1', array('1'), NULL, 0.5D), ('a', 'cargo', 'z', NULL, NULL, NULL), ('b', 'number', '2', NULL, NULL, 0.5D), ('b', 'cargo', NULL, NULL, array('y'), NULL),
        ('c', 'cargo', 'x', NULL, NULL, NULL), ('d', 'number', '4', NULL, NULL, NULL), ('a', 'colour', NULL, NULL, NULL, 0.99D), ('d', 'date', NULL, NULL, NULL, 0.99D), (NULL, 'number', '1', NULL, NULL, NULL)
        AS t(source, field, equals, contains, not_contains, conf_min)"""
    )
    out = A.broken_contracts(parsed, held)
    assert "BroadcastHashJoin" not in plan(out)
    want = {("a", "cargo", "x"), ("b", "number", "2"), ("b", "cargo", "y"), ("c", "cargo", None), ("d", "number", None), (None, "number", None)}
    assert {tuple(r) for r in out.collect()} == want and out.count() == len(want)


def test_images_are_spread(spark):
    """parts come in one file of one block, which one task worked on."""
    assert catalog_pages._images(spark, DATA, "line").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1


def test_skew_is_the_exact_one():
    """all turns at once, by whole numbers; rounding of np.var parted turns that are equally sharp, as in the first image."""

    def exact(gray, degrees):
        ys, xs = np.nonzero(gray < 128)
        a = np.deg2rad(degrees)
        rows = np.rint(ys * np.cos(a) - xs * np.sin(a)).astype(int)
        ink = np.bincount(rows - rows.min()).tolist()
        return Fraction(sum(c * c for c in ink), len(ink)) - Fraction(sum(ink), len(ink)) ** 2

    def skew(gray):
        best = max(np.arange(-15, 16), key=lambda d: (exact(gray, d), -abs(d)))
        return round(float(max(np.arange(best - 1, best + 1.01, 0.1), key=lambda d: (exact(gray, d), -abs(d)))), 1)

    tied = [[203, 203, 93, 177, 49, 45, 163, 6], [124, 141, 230, 38, 98, 75, 61, 121], [187, 64, 106, 238, 111, 82, 223, 143], [123, 249, 232, 171, 170, 98, 231, 192], [58, 49, 120, 26, 171, 9, 108, 170], [166, 168, 11, 171, 196, 172, 227, 149]]
    images = [np.array(tied, np.uint8), *(np.random.default_rng(k).integers(0, 256, (6 + k, 8)).astype(np.uint8) for k in range(20))]
    assert [I.skew(g) for g in images] == [skew(g) for g in images]


def test_stacked_images_are_as_single_ones():
    """small images of one shape are averaged together; pages and odd shapes between them are no different."""
    rng = np.random.default_rng(0)
    grays = [rng.integers(0, 256, shape).astype(np.uint8) for shape in [(6, 8)] * 5 + [(1, 1), (2, 3), (40, 700), (6, 8), (40, 700)]]
    options = {"h": 10, "patch": 3, "search": 5}
    assert all(np.array_equal(a, I.nonlocal_means(b, **options)) for a, b in zip(I._step("nlm", grays, options), grays, strict=True))


def test_steps_over_orders_are_spread(spark):
    """Texts made of orders come from one file of one block, which one task read in Python."""
    for name in ("flt12_noise_rows", "jn06_nearest_role", "ext10_party_lines", "spl01_documents"):
        assert catalog.queries()[name](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


BUNDLE = "\n".join(f"Транспортная накладная\n№ {n}/К от 0{n}.02.2024\n1. Грузоотправитель: ООО «Икс», ИНН 7707083893\n3. Груз\nНаименование: плита\n7. Транспортное средство\nMAN А12{n}ВС77\nПодписи сторон, печати и прочее" for n in (1, 2))
TEXTS = [BUNDLE, BUNDLE[: len(BUNDLE) // 2], BUNDLE + "\nТранспортная накладная\n" + "слово " * 30, "", "Транспортная накладная " * 9]


@pytest.mark.parametrize("only", [[], ["number"], ["vehicle", "cargo"], ["volume", "driver"], list(B.FIELDS)])
def test_fields_alone_are_as_among_all(only):
    """Only what a query reads is looked for, in bundles too."""
    day = datetime.date(2024, 6, 1)
    seen = lambda rows: [[r["source"], *(r[k] for f in only for k in (f, f"{f}_conf"))] for r in rows]
    for text in TEXTS:
        assert seen(B.rows_of(text, "s", day, only)) == seen(B.rows_of(text, "s", day))


def test_fields_alone_leave_the_others(monkeypatch):
    """number and date look for no vehicle."""
    monkeypatch.setitem(B.RECIPES, "vehicle", [B.Recipe(lambda s: 1 / 0, 1.0)])
    assert B.rows_of(TEXTS[1], "s", datetime.date(2024, 6, 1), ["number", "date"])[0]["number"] == "1/К"


def test_long_texts_are_not_kept():
    """What is kept for printed lines is kept for short ones alone."""
    before = B.line_role.__wrapped__, B.first_mark
    long = ["ООО " + "слово" * 20_000 + str(i) for i in range(3)]
    assert not hasattr(before[1], "cache_info")
    assert [B.line_value(x) for x in long] == long


def test_rare_signs_match_as_patterns_do():
    """A search for literal words comes before patterns of any case, which take some rare signs for others."""
    assert B.split_documents("Транᲃпортная накладная\n" * 9) and B.folded("тᲁ") is None and B.folded("İ") is None
    header = "Транᲃпортная накладная\n№ 7/К от 03.02.2024\n".replace("ᲃ", "ᲃ")
    assert B.rows_of(header + "строка " * 30, "s", datetime.date(2024, 6, 1))[0]["number"] == "7/К"


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    """keys exploded of a small table were broadcast by Spark, which knew the table's size only."""
    tokens = spark.sql("SELECT * FROM VALUES ('7000000010'), ('700000001'), (NULL) AS t(token)")
    catalog_ = spark.sql("SELECT * FROM VALUES ('7000000010'), ('7000000000') AS t(value)")
    want = sorted((r["token"], r["fixed"]) for r in L.catalog_fix(tokens, catalog_).where("token is not null").collect())
    monkeypatch.setattr(L, "BROADCAST_BYTES", 10)
    out = L.catalog_fix(tokens, catalog_)
    assert "BroadcastHashJoin [key" not in plan(out) and "SortMergeJoin [key" in plan(out)
    assert sorted((r["token"], r["fixed"]) for r in out.where("token is not null").collect()) == want


def test_streams_take_tables_of_many_files(spark, tmp_path):
    """a filter by name left out the files of a table that is a folder; no batch came, and what it would have written was not found."""
    for name in ("conversations", "events"):
        spark.read.parquet(f"{DATA}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("snk13_autosaved_pages", "str02_latest_status_stream"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == catalog.queries()[name](spark, DATA).count() > 0


def test_documents_are_cleaned_once_for_tokens(spark):
    """numbers of both sizes are looked for at once, in documents that are dealt once: each branch cleaned all texts anew, four times in all."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.concat(F.upper("text"), F.lit(" 7700000001 102770013219 1027700132195")).alias("text"))
    values = spark.sql("SELECT * FROM VALUES ('7700000011'), ('1027700132194'), ('102770013218') AS t(value)")
    out = L.fix_identifiers(docs, values, "doc_id")
    assert out.where("text like '% 7700000011 %'").count() == docs.count()
    out.collect()
    assert plan(out).split("Initial Plan")[0].count("FileScan") <= 2


def test_kinds_of_values_do_not_meet(spark):
    """a number of 13 digits is no neighbour of one of 12 by a deletion, as before both were looked for at once."""
    docs = spark.sql("SELECT 1 AS doc_id, 'x 1234567890128 y' AS text")
    assert L.fix_identifiers(docs, spark.sql("SELECT '123456789012' AS value"), "doc_id").first()["text"] == "x 1234567890128 y"


def test_slow_rows_are_spread(spark):
    """a customer's number takes a millisecond; one file's few blocks were as few tasks."""
    assert catalog.queries()["val14_fix_ogrn"](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
