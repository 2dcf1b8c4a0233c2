"""Repair functions against brute force in Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from pagelathe.functions import repair as R

TWIN = dict(zip(R.LATIN, R.CYRILLIC, strict=True))


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def confusables(text):
    def one(m):
        cs = list(m.group(0))
        for i, c in enumerate(cs):
            near = cs[i - 1 : i] + cs[i + 1 : i + 2] if i else cs[1:2]
            if c in TWIN and any("Ѐ" <= x <= "ӿ" for x in near):
                cs[i] = TWIN[c]
        return "".join(cs)

    return re.sub(r"[A-Za-zА-Яа-яЁё]+", one, text)


def words(n, signs, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def test_confusables(spark):
    values = [*words(400, "АБоcepHXZq1 -", 1), "Тенsar", "гpуз", "Tpys", None, ""]
    assert column(spark, values, R.fix_confusables) == [None if v is None else confusables(v) for v in values]


def unify(text):
    cyr, lat = (sum(c in s for c in text) for s in (R.ONLY_CYRILLIC, R.ONLY_LATIN))
    major = None if cyr + lat < 3 else "cyr" if cyr >= 3 * lat else "lat" if lat >= 3 * cyr else None
    back = {v: k for k, v in TWIN.items()}

    def one(m):
        w = m.group(0)
        c, x = any(s in R.ONLY_CYRILLIC for s in w), any(s in R.ONLY_LATIN for s in w)
        kind = "cyr" if c and not x else "lat" if x and not c else None
        if kind is None:
            number = re.match(r"[-_/.]?\d", text[m.end() : m.end() + 5]) or re.search(r"\d[-_/.]?$", text[max(0, m.start() - 5) : m.start()])
            kind = "lat" if number else major
        table = {"cyr": TWIN, "lat": back}.get(kind, {})
        return "".join(table.get(s, s) for s in w)

    return re.sub(r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё'’\-]*", one, text)


def test_unify_scripts(spark):
    values = [*words(600, "АоБжcepqHZ12-./ '", 2), "ИНВ-12 Сo груз дом", "СC7 дом шёл", None, ""]
    assert column(spark, values, R.unify_scripts) == [None if v is None else unify(v) for v in values]


def test_rules_against_python(spark):
    values = words(300, "АбоcHb0134О5sSrnclvv |", 3)

    def folded(rules):
        def one(v):
            for p, to in rules:
                v = re.sub(p.replace("(?U)", ""), to, v)
            return v

        return one

    assert column(spark, values, R.autocorrect_russian) == [folded(R.RUSSIAN)(v) for v in values]
    assert column(spark, values, R.autocorrect_english) == [folded(R.ENGLISH)(v) for v in values]


def test_user_rules(spark):
    rules = [R.Rule("a+", "<\\g>", enabled=False), R.Rule("(b)(c)", r"\2\1"), R.Rule("[", "x"), R.Rule("$1", "$2", is_regex=False), R.Rule("zz", "y", case_sensitive=False)]
    assert column(spark, ["bc $1 ZZ aa", None], lambda c: R.apply_rules(c, rules)) == ["cb $2 y aa", None]


@pytest.mark.parametrize(("token", "bad"), [("ООО", False), ("Тенsar", False), ("B30F300", False), ("іі-і", True), ("ав4'", True), ("Бекам'тбд", True), ("—", False), ("...", False), ("'|_", True), ("iЖt", True), ("", True)])
def test_garbage_tokens(spark, token, bad):
    assert column(spark, [token], R.is_garbage_token) == [bad]


def test_lines(spark):
    assert column(spark, ["груз іі ООО", "іі ав4'", ""], R.is_noise_line) == [False, True, True]
    assert column(spark, ["груз іі  ООО", "іі"], R.strip_garbage_tokens) == ["груз ООО", ""]
    assert column(spark, ["Г", "склад номер семь", "11 [3] Т", "7743553262"], R.looks_noisy) == [True, False, True, False]


def test_entities_and_marks(spark):
    assert column(spark, ["от 1.2.24 на 12 345,5 руб", "x"], R.canonical_entities) == ["от 01.02.2024 на 12 345,50", "x"]
    assert column(spark, ["a bad word, bad. badly"], lambda c: R.mark_low_words(c, F.array(F.lit("bad"), F.lit("word")))) == ["a [?bad?] [?word?], [?bad?]. badly"]
    assert column(spark, ["a"], lambda c: R.mark_low_words(c, F.array().cast("array<string>"))) == ["a"]


def test_plates(spark):
    assert column(spark, ["x P814HP152 y", "НН7743553262", None], R.find_plate) == ["Р814НР152", None, None]
    assert column(spark, ["Р814НР152", "АА1234 77", "x"], R.format_plate) == ["Р 814 НР 152", "АА 1234 77", "x"]
