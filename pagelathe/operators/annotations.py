"""Annotated documents: registries harvested from nested JSON, and fields scored against what was annotated.

An annotation is one JSON text a document, of one of two layouts: documents with parties, or pages
with structured fields. It is parsed behind Arrow, one text a row; everything after is native, but
for the partial ratio of names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagelathe.functions import text as T
from pagelathe.functions import validators as V
from pagelathe.functions.similarity import partial_ratio
from pagelathe.operators import lookups as L
from pagelathe.operators.forms import FIELDS, MISSING
from pagelathe.shipping import in_pandas, ship
from pagelathe.sources import files as sources

#: Endings that mark a reading of a file, and their rank; files without one come last.
READINGS = {" ocred": 0, "-ocred": 0, "_ocred": 0, "-выход": 1, "_выход": 1}
#: Kinds of pages and documents that are waybills.
KINDS = ("TN", "TTN")
#: Where each expectation stands, by layout; ``a=b`` picks the first of a list, ``'x`` is x itself, ``|`` parts alternatives.
_PARTY = {"role": "parties.role={0}.role", "inn": "parties.role={0}.inn", "name": "parties.role={0}.name"}
DOCUMENT = {
    "number": {"value": "number"},
    "date": {"value": "date"},
    "shipper": {k: v.format("shipper") for k, v in _PARTY.items()},
    "consignee": {k: v.format("consignee") for k, v in _PARTY.items()},
    "cargo": {"value": "cargo_header.description"},
    "volume": {"places": "cargo_header.places_count", "net": "cargo_header.net_weight_t", "volume": "cargo_header.volume_m3"},
    "driver": {"value": "parties.role=carrier.driver.short_name|parties.role=carrier.driver.full_name"},
    "vehicle": {"make": "transport.vehicle_make", "plate": "transport.vehicle_reg_plate"},
    "reception": {"inn": "loading.infrastructure_owner.inn", "name": "loading.infrastructure_owner.name"},
}
PAGE = {
    "number": {"value": "ttn_internal_number|order_number"},
    "date": {"value": "ttn_date"},
    "shipper": {"role": "'shipper", "inn": "consignor.inn", "name": "consignor.name"},
    "consignee": {"role": "'consignee", "inn": "consignee.inn", "name": "consignee.name"},
    "cargo": {"value": "cargo.name"},
    "volume": {"places": "cargo.places_count", "net": "cargo.net_weight_t", "volume": "cargo.volume_m3"},
    "driver": {"value": "carrier_driver"},
    "vehicle": {"make": "vehicle.brand", "plate": "vehicle.plate"},
    "reception": {"inn": "loading_point.loader_inn", "name": "loading_point.loader"},
}
#: Words of a cargo's name that say nothing.
VAGUE = ["груз", "груза", "масса", "вес", "брутто", "нетто", "объем", "объём"]
#: An organisation's columns.
ORG = ("inn", "name", "legal_form", "kpp", "ogrn", "address", "phone")
#: The least partial ratio of names that count as one.
NAME_RATIO = 75.0


def at(node: object, paths: str) -> object:
    """The value at the first of ``paths`` that has one."""
    for path in paths.split("|"):
        if path.startswith("'"):
            return path[1:]
        here = node
        for part in path.split("."):
            key, picks, want = part.partition("=")
            if picks:
                here = next((x for x in here if isinstance(x, dict) and x.get(key) == want), None) if isinstance(here, list) else None
            else:
                here = here.get(key) if isinstance(here, dict) else None
        if here not in (None, ""):
            return here
    return None


def scalars_of(node: object) -> Iterator[tuple[str, object]]:
    """(key, value) of every scalar under a name, however deep."""
    todo = [node]
    while todo:
        here = todo.pop()
        if isinstance(here, dict):
            yield from ((k, v) for k, v in here.items() if not isinstance(v, (dict, list)))
            todo.extend(v for v in reversed(here.values()) if isinstance(v, (dict, list)))
        elif isinstance(here, list):
            todo.extend(reversed(here))


def _dicts(node: object, key: str) -> list[dict]:
    found = node.get(key) if isinstance(node, dict) else None
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def wanted_of(annotation: object) -> dict[str, dict[str, str]]:
    """What is expected of the first waybill, by field and part; parts without a value are left out."""
    own = next((d for d in _dicts(annotation, "documents") if d.get("type") == "TN"), None)
    layout = DOCUMENT
    if own is None:
        layout = PAGE
        own = next((p["structured_fields"] for p in _dicts(annotation, "pages") if p.get("document_type") in KINDS and p.get("structured_fields")), None)
    if own is None:
        return {}
    out = {f: {k: str(v) for k, p in parts.items() if (v := at(own, p)) is not None} for f, parts in layout.items()}
    if layout is PAGE and "name" not in out["reception"]:
        out["reception"] = {}
    return out


def _each(files: DataFrame, f: Callable[[object], Iterator[tuple]], schema: str) -> DataFrame:
    """``f``'s rows of each parsed annotation of (stem, text), after its stem; texts that do not parse give none."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for stem, text in zip(frame["stem"], frame["text"], strict=True):
                try:
                    node = json.loads(text) if isinstance(text, str) else None
                except ValueError:
                    node = None
                rows += [(stem, *r) for r in f(node)]
            yield pd.DataFrame(rows, columns=["stem", *names])

    return in_pandas(files.select("stem", "text"), batch, f"stem string, {schema}")


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, text) of the JSON files of a folder, whole."""
    t = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    return t.select(sources.stem("json").alias("stem"), F.col("value").alias("text"))


def scalars(files: DataFrame) -> DataFrame:
    """(stem, key, value) of every named string in (stem, text)."""
    return _each(files, lambda n: ((k, v) for k, v in scalars_of(n) if isinstance(v, str)), "key string, value string")


def identifiers(files: DataFrame) -> DataFrame:
    """(kind, value): the distinct valid tax and state numbers, registration codes, and names of (stem, text)."""
    kind, value = F.lower("key"), T.strip(F.col("value"))
    v = F.col("value")
    good = F.when(F.col("kind") == "inn", V.is_inn(v)).when(F.col("kind") == "ogrn", V.is_ogrn(v)).when(F.col("kind") == "kpp", V.is_kpp(v)).otherwise((F.col("kind") == "name") & (v != ""))
    return scalars(files).select(kind.alias("kind"), value.alias("value")).where(good).distinct()


def first_not_empty(*catalogs: DataFrame) -> DataFrame:
    """The first catalog with a row, else the last."""
    return next((c for c in catalogs[:-1] if not c.isEmpty()), catalogs[-1])


def _organisations_of(node: object) -> Iterator[tuple]:
    place = 0
    for doc in _dicts(node, "documents"):
        owners = [at(doc, f"{side}.infrastructure_owner") for side in ("loading", "unloading")]
        for p in _dicts(doc, "parties") + [o for o in owners if isinstance(o, dict)]:
            yield (place, *(str(p.get(k) or "").strip() if k == "inn" else str(p.get(k) or "") for k in ORG))
            place += 1


def organisations(files: DataFrame) -> DataFrame:
    """One record for each valid tax number of parties and owners: the first by stem and place."""
    rows = _each(files, _organisations_of, "place int, " + ", ".join(f"{c} string" for c in ORG)).where(V.is_inn(F.col("inn")))
    return L.first_by(rows, "inn", ["stem", "place"]).select(*ORG, F.col("stem").alias("source"))


def expectations(files: DataFrame) -> DataFrame:
    """(stem, field, wanted): a map of parts for each of nine fields, empty where nothing is expected; dates as DD.MM.YYYY."""
    rows = _each(files, lambda n: ((f, list(w.items())) for f, w in wanted_of(n).items()), "field string, parts array<struct<k:string,v:string>>")
    parts = F.map_from_entries("parts")
    return rows.select("stem", "field", F.when(F.col("field") == "date", F.transform_values(parts, lambda _, v: _as_date(v))).otherwise(parts).alias("wanted"))


def _as_date(v: Column) -> Column:
    iso = F.regexp_extract(v, r"^(\d{4})-(\d{2})-(\d{2})", 0) != ""
    turned = F.concat_ws(".", F.substring(v, 9, 2), F.substring(v, 6, 2), F.substring(v, 1, 4))
    short = T.strip(v).rlike(r"^\d{2}\.\d{2}\.\d{2}$")
    return F.when(iso, turned).when(short, F.concat(F.left(T.strip(v), F.lit(6)), F.lit("20"), F.right(T.strip(v), F.lit(2)))).otherwise(v)


def base_name(stem: Column) -> Column:
    """A stem without the ending that marks a reading."""
    return F.regexp_replace(stem, "(?:" + "|".join(READINGS) + ")$", "")


def reading_rank(stem: Column) -> Column:
    out = F.lit(2)
    for ending, rank in READINGS.items():
        out = F.when(stem.endswith(ending), rank).otherwise(out)
    return out


def plain_name(c: Column) -> Column:
    """A name without spaces and marks, its Cyrillic look-alikes and misread digits as one sign each."""
    return F.regexp_replace(F.translate(F.lower(c), "ёзоеархсукмтвн", "e30eapxcykmtbh"), r"(?U)[\s\-_.,«»\"'()]+", "")


@F.pandas_udf(DoubleType())
def _ratio(a, b):  # noqa: ANN001, ANN202  type hints would be read as the UDF's kind
    import pandas as pd

    return pd.Series([partial_ratio(x, y) if isinstance(x, str) and isinstance(y, str) else 0.0 for x, y in zip(a, b, strict=True)])


def check(rows: DataFrame) -> DataFrame:
    """(…, ok) of rows with field, wanted and got: null without an expectation, else whether ``got`` meets it.

    Names may differ by look-alikes and a few signs, drivers in all but the surname, cargo in all
    but one of its first three telling words; of a volume one part suffices, of a vehicle the plate.
    """
    ship(rows.sparkSession)
    w = lambda k: F.try_element_at("wanted", F.lit(k))
    got, folded = T.strip(F.coalesce("got", F.lit(""))), F.col("__got")
    has_inn = F.coalesce(F.contains(got, w("inn")), F.lit(True))
    has_name = F.coalesce(F.contains(folded, F.col("__name")) | (F.col("__ratio") >= NAME_RATIO), F.lit(True))
    surname = lambda c: F.nullif(F.regexp_extract(c, "[А-ЯЁ][а-яё]{2,}", 0), F.lit(""))
    plate = lambda c: T.fold_number(F.upper(F.regexp_replace(c, r"(?U)\s+", "")))
    telling = F.slice(F.filter(F.regexp_extract_all(F.lower(w("value")), F.lit("[А-Яа-яёЁA-Za-z]{4,}"), F.lit(0)), lambda x: ~x.isin(VAGUE)), 1, 3)
    comma = lambda c: F.replace(c, F.lit("."), F.lit(","))
    one = F.coalesce(F.contains(got, w("places")), F.lit(False)) | F.coalesce(F.contains(comma(got), comma(w("net"))), F.lit(False)) | F.coalesce(F.contains(comma(got), comma(w("volume"))), F.lit(False))
    f = F.col("field")
    ok = (
        F.when(f == "number", T.fold_number(w("value")) == T.fold_number(got))
        .when(f == "date", w("value") == got)
        .when(f.isin("shipper", "consignee", "reception"), has_inn & has_name)
        .when(f == "driver", F.when(surname(w("value")).isNotNull(), F.coalesce(F.lower(surname(w("value"))) == F.lower(surname(got)), F.lit(False))))
        .when(f == "cargo", F.when(F.size(telling) > 0, F.exists(telling, lambda x: F.contains(F.lower(got), x))))
        .when(f == "volume", one)
        .when(f == "vehicle", F.coalesce((plate(w("plate")) != "") & F.contains(plate(got), plate(w("plate"))), F.lit(False)))
    )
    name = plain_name(F.trim(F.split_part(w("name"), F.lit(","), F.lit(1))))
    named = rows.withColumns({"__name": name, "__got": plain_name(got)})
    named = named.withColumn("__ratio", F.when(F.col("__name").isNotNull(), _ratio("__name", "__got")))
    open_ = F.coalesce(F.size("wanted"), F.lit(0)) <= 0
    return named.withColumn("ok", F.when(open_, None).when((got == "") | (got == MISSING), False).otherwise(ok)).drop("__name", "__got", "__ratio")


def score(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """(base, field, wanted, got, ok): each base name's preferred reading's first row against its annotation.

    ``parsed`` has (stem, row) and the fields as columns; stems are parted from their reading's ending.
    Base names without an annotation, and the other way round, are left out.
    """
    rest = F.struct(reading_rank(F.col("stem")).alias("rank"), "stem", "row", *FIELDS)
    first = parsed.groupBy(base_name(F.col("stem")).alias("base")).agg(F.min(rest).alias("m"))
    long = first.select("base", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"m.{f}").alias("got")) for f in FIELDS])).alias("x")).select("base", "x.*")
    both = long.join(expectations(files).withColumnRenamed("stem", "base"), ["base", "field"])
    return check(both).select("base", "field", "wanted", "got", "ok")


def totals(scored: DataFrame) -> DataFrame:
    """Per field: n_ok, n_fail, n_skip, and the whole percentage of those with an expectation that are met."""
    ok, fail = F.count_if(F.col("ok")), F.count_if(~F.col("ok"))
    return scored.groupBy("field").agg(ok.alias("n_ok"), fail.alias("n_fail"), F.count_if(F.col("ok").isNull()).alias("n_skip"), F.when(ok + fail > 0, F.floor(ok * 100 / (ok + fail))).alias("percent"))


#: Fields that a contract names; a contract is (source, field, equals, contains, not_contains, conf_min).
CONTRACT = tuple(f for f in FIELDS if f != "volume")


def contracts(rows: DataFrame, slack: float = 0.05) -> DataFrame:
    """What parsed rows read now, as contracts that hold exactly: (source, field, equals, contains, not_contains, conf_min)."""
    none = F.lit(None).cast("array<string>")
    one = [F.struct(F.lit(f).alias("field"), F.col(f).alias("equals")) for f in CONTRACT]
    return rows.select("source", F.explode(F.array(*one)).alias("x"), F.round(F.col("overall") - slack, 2).alias("conf_min")).select("source", "x.field", "x.equals", none.alias("contains"), none.alias("not_contains"), "conf_min")


def merged_contracts(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """``held`` with those of ``fresh`` that it has no (source, field) of.

    Both meet by source alone, so rows that are dealt by source before they are taken apart are not dealt again. What is
    parsed or exploded is larger than Spark expects from its files: a broadcast is ruled out.
    """
    taken = held.groupBy("source").agg(F.collect_set("field").alias("__taken"))
    kept = fresh.join(taken.hint("merge"), "source", "left").where(~F.coalesce(F.array_contains("__taken", F.col("field")), F.lit(False)))
    return held.unionByName(kept.drop("__taken"))


def broken_contracts(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(source, field, got) of contracts that parsed rows do not meet; rows meet them by source, whole, and are not broadcast."""
    known = F.map_from_arrays(F.array(*map(F.lit, CONTRACT)), F.array(*[F.col(f) for f in CONTRACT]))
    read = rows.select("source", F.col("overall").alias("__overall"), known.alias("__read"))
    got, overall = F.try_element_at("__read", F.col("field")), F.when(F.col("field").isin(*CONTRACT), F.col("__overall"))
    met = held.join(read.hint("merge"), "source", "left").withColumns({"got": got, "overall": overall})
    got = F.col("got")
    meets = F.coalesce(got == F.col("equals"), F.col("equals").isNull())
    meets &= F.coalesce(F.forall("contains", lambda x: F.contains(got, x)), F.lit(True)) & ~F.coalesce(F.exists("not_contains", lambda x: F.contains(got, x)), F.lit(False))
    meets &= F.coalesce(F.col("overall") >= F.col("conf_min"), F.lit(True))
    return met.where(~F.coalesce(meets, F.lit(False))).select("source", "field", "got")
