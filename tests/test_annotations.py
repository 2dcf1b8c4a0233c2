"""Harvest, expectations and scoring on small annotations of both layouts."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from pagelathe.operators import annotations as A
from pagelathe.operators import lookups as L
from pagelathe.operators.waybills import FIELDS

INN, OTHER = "7707083893", "7736050003"
OLD = {
    "inn": "1234567890",
    "documents": [
        "UPD",
        {
            "type": "TN", "number": "12-А", "date": "2022-08-29",
            "parties": [
                {"role": "shipper", "name": "Весна-3, склад", "inn": INN, "kpp": "770701001"},
                {"role": "carrier", "driver": {"short_name": "", "full_name": "Петров Иван"}},
            ],
            "transport": {"vehicle_make": "MAN", "vehicle_reg_plate": "А 123 ВС 77"},
            "cargo_header": {"description": "Груз: плитка белая", "places_count": 12, "volume_m3": 1.5},
            "loading": {"infrastructure_owner": {"name": "Склад", "inn": INN}},
            "unloading": {"infrastructure_owner": {"name": "Порт", "inn": OTHER}},
        },
    ],
}
NEW = {"documents": ["UPD"], "pages": [{"document_type": "TTN", "structured_fields": {"order_number": "7", "ttn_date": "20.10.22", "consignor": {"name": "Иней", "inn": OTHER}, "loading_point": {"loader_inn": OTHER}}}]}
GOT = {"number": "12-A", "date": "29.08.2022", "shipper": f"ООО Весна-З ИНН {INN}", "consignee": "x", "cargo": "Плитка", "volume": "1,5 м3", "driver": "Петров И. И.", "vehicle": "MAN А123ВС77", "reception": "отсутствует"}


@pytest.fixture(scope="module")
def files(spark):
    rows = [("b", json.dumps(OLD)), ("c", json.dumps(NEW)), ("d", "{no"), ("e", None), ("f", "[]"), ("a", json.dumps({"documents": [{"parties": [{"inn": f" {OTHER} ", "name": "Первый"}, {"inn": "5"}, 3]}]}))]
    return spark.createDataFrame(rows, "stem string, text string")


def test_harvest(files):
    got = {(r["kind"], r["value"]) for r in A.identifiers(files).collect()}
    assert {v for k, v in got if k == "inn"} == {INN, OTHER} and ("kpp", "770701001") in got and ("name", "Порт") in got
    orgs = {r["inn"]: (r["name"], r["source"]) for r in A.organisations(files).collect()}
    assert orgs == {INN: ("Весна-3, склад", "b"), OTHER: ("Первый", "a")}
    empty = A.identifiers(files.where("stem = 'd'"))
    assert A.first_not_empty(empty, A.identifiers(files)).count() == len(got) and A.first_not_empty(empty, empty).isEmpty()


def test_expectations(files):
    got = {(r["stem"], r["field"]): r["wanted"] for r in A.expectations(files).collect()}
    assert {s for s, _ in got} == {"b", "c"} and len(got) == 18
    assert got["b", "date"] == {"value": "29.08.2022"} and got["c", "date"] == {"value": "20.10.2022"} and got["c", "number"] == {"value": "7"}
    assert got["b", "driver"] == {"value": "Петров Иван"} and got["b", "volume"] == {"places": "12", "volume": "1.5"} and got["b", "consignee"] == {}
    assert got["c", "shipper"] == {"role": "shipper", "inn": OTHER, "name": "Иней"} and got["c", "reception"] == {}


def test_score(spark, files):
    bad = dict.fromkeys(FIELDS, "x")
    rows = [("b ocred", 0, *[GOT[f] for f in FIELDS]), ("b ocred", 1, *bad.values()), ("b", 0, *bad.values()), ("z", 0, *bad.values())]
    parsed = spark.createDataFrame(rows, "stem string, row int, " + ", ".join(f"{f} string" for f in FIELDS))
    scored = A.score(parsed, files)
    assert {r["field"]: r["ok"] for r in scored.collect()} == {**dict.fromkeys(FIELDS, True), "consignee": None, "reception": False}
    t = {r["field"]: (r["n_ok"], r["n_fail"], r["n_skip"], r["percent"]) for r in A.totals(scored).collect()}
    assert t["number"] == (1, 0, 0, 100) and t["consignee"] == (0, 0, 1, None) and t["reception"] == (0, 1, 0, 0)
    cases = [("shipper", {"name": "Бекам"}, "ООО Беком", True), ("shipper", {"name": "Бекам"}, "ООО Ромашка", False), ("driver", {"value": "ab"}, "Иванов", None), ("driver", {"value": "Иванов"}, "ab", False),
             ("cargo", {"value": "груз вес"}, "x", None), ("vehicle", {"make": "MAN"}, "MAN", False), ("volume", {"places": "3"}, "4 шт", False), ("date", {"value": "1"}, None, False), ("date", None, "1", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, field string, wanted map<string,string>, got string, want boolean")
    assert [r["i"] for r in A.check(df).where(~F.col("ok").eqNullSafe(F.col("want"))).collect()] == []


def test_contracts(spark):
    cols = "source string, overall double, " + ", ".join(f"{f} string" for f in FIELDS)
    rows = spark.createDataFrame([("s", 0.9, *[GOT[f] for f in FIELDS])], cols)
    held = A.contracts(rows)
    assert held.count() == len(A.CONTRACT) and A.broken_contracts(rows, held).isEmpty()
    own = spark.createDataFrame([("s", "cargo", None, ["Плит"], ["бел"], 0.95), ("s", "date", None, ["2022"], ["08"], None), ("s", "number", None, ["12"], None, 0.5), ("t", "date", "x", None, None, None)], held.schema)
    assert {(r["source"], r["field"]) for r in A.broken_contracts(rows, own).collect()} == {("s", "cargo"), ("s", "date"), ("t", "date")}
    both = A.merged_contracts(own, held)
    assert both.count() == len(A.CONTRACT) + 1 and both.where("field = 'number' and source = 's'").first()["contains"] == ["12"]


def test_readings(spark):
    df = spark.createDataFrame([("a ocred",), ("a-выход",), ("a",), ("ocred b",)], "s string")
    assert [tuple(r) for r in df.select(A.base_name(F.col("s")), A.reading_rank(F.col("s"))).collect()] == [("a", 0), ("a", 1), ("a", 2), ("ocred b", 2)]


def test_files(spark, tmp_path):
    (tmp_path / "x y.json").write_text(json.dumps(OLD))
    assert [r["stem"] for r in A.annotations(spark, str(tmp_path)).collect()] == ["x y"]


def test_catalog_fix_matches_brute_force(spark):
    tokens = ["1234567890", "123456789", "1234567899", "12345678901", "11", "1a", "", None, "111", "99"]
    values = ["1234567890", "123456789", "1a", "12", "21", "a1", "1234567891", None, ""]

    def brute(t):
        if t is None:
            return None
        near = {t[:i] + d + t[i + 1 :] for i in range(len(t)) for d in "0123456789"} | {t[:i] + t[i + 1 :] for i in range(len(t))}
        near = (near | {t}) & {v for v in values if v is not None}
        return t if t in near else near.pop() if len(near) == 1 else None

    got = L.catalog_fix(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(v,) for v in values], "value string"))
    assert {r["token"]: r["fixed"] for r in got.collect() if r["token"] is not None} == {t: brute(t) for t in tokens if t is not None}
