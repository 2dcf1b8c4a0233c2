"""Layout, engines, profiles and identifier repair on small cases."""

from __future__ import annotations

from pagelathe.operators import engines, layout, lookups
from pagelathe.plans import profiles


def test_layout(spark):
    rows = [("d", 1, 600.0, *map(float, (x, y, x + w, y + 9)), t) for x, y, w, t in [(10, 10, 100, "L1"), (400, 12, 100, "R1"), (10, 30, 90, "L2"), (400, 31, 80, "R2"), (10, 50, 9, "L3"), (1, 1, 1, " ")]]
    rows += [("d", 2, 600.0, 10.0, 10.0, 40.0, 19.0, "a"), ("d", 2, 600.0, 50.0, 13.5, 60.0, 19.0, "c"), ("d", 2, 600.0, 45.0, 10.0, 49.0, 19.0, "b")]
    df = spark.createDataFrame(rows, "doc string, page int, page_width double, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r["page"]: r["text"] for r in layout.page_texts(df).collect()}
    assert got == {1: "L1\nL2\nL3\n\nR1\nR2", 2: "a b\nc"}
    assert layout.render([], 10) == ""


def test_engines(spark):
    class Picky(engines.FixedEngine):
        def read(self, image, config):
            if config["dpi"] > 200:
                raise ValueError("too fine")
            return super().read(image, config)

    df = spark.createDataFrame([("p", 1, bytearray(b"x")), ("p", 2, bytearray(b"y")), ("p", 3, None)], "path string, page int, data binary")
    got = {r["page"]: r for r in engines.recognise(df, engines.FixedEngine({b"x": ("text", 90.0)}), [{}]).collect()}
    assert (got[1]["text"], got[1]["tier"], got[1]["error"]) == ("text", 0, None)
    assert got[2]["error"].startswith("KeyError") and got[2]["tier"] is None and got[3]["error"] == "no image"
    assert engines.get("fixed").available()[0]


def test_filler(spark):
    df = spark.createDataFrame([("t", "none", 0.0, 0.1), ("t", "none", 0.0, 0.9), ("t", "kept", 0.5, 0.1)], "text string, number string, number_conf double, overall double")
    got = engines.fill(df, "text", "text", ["number"], ("none",), lambda text, want: dict.fromkeys(want, " 7 ")).collect()
    assert sorted((r["number"], r["number_conf"]) for r in got) == [("7", 0.6), ("kept", 0.5), ("none", 0.0)]
    assert engines.fill(df, "text", "text", ["number"], (), None) is df


def test_profiles():
    old = {"name": "a", "ocr": {"tesseract_timeout": 120, "engine": "other"}, "extract": {"llm_fallback": {"enabled": True}}}
    new = profiles.migrate(old)
    assert new["schema_version"] == 11 and new["ocr"]["tesseract_timeout"] == 300 and new["ocr"]["engine"] == "other" and "schema_version" not in old
    assert new["extract"]["llm_fallback"] == {"enabled": True, "min_confidence": 0.4, "max_text_chars": 20_000} and profiles.migrate(new) == new
    assert profiles.migrate({"schema_version": 99, "x": 1}) == {"schema_version": 11, "x": 1}
    assert [p.get("v") for p in profiles.merged([{"name": "b"}, {"name": "a"}], [{"name": "b", "v": 1}, {"name": "0", "v": 2}])] == [None, 1, 2]


def test_fix_identifiers(spark):
    docs = spark.createDataFrame([(1, "ИНН 7707083894, 77070838931."), (2, "7707083893 и 1027700132196"), (3, None), (4, "нет")], "k int, text string")
    catalog = spark.createDataFrame([("7707083893",), ("1027700132195",), ("12",)], "value string")
    got = {r["k"]: r["text"] for r in lookups.fix_identifiers(docs, catalog, "k").collect()}
    assert got == {1: "ИНН 7707083893, 7707083893.", 2: "7707083893 и 1027700132195", 3: None, 4: "нет"}
