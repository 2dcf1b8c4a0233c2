"""Checksums, dates, amounts, phones and plates as native column expressions; null where nothing fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Checksum weights of ten- and twelve-digit tax numbers.
INN10 = (2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12A = (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
INN12B = (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)
#: Letters that read as digits, the pairs in the same order in both strings.
LOOKALIKE, DIGITS = "OoОоlI|ZzBSsGT", "00001112285567"
#: Letters of plates, Latin and Cyrillic in the same order.
PLATE_LATIN, PLATE_CYRILLIC = "ABEKMHOPCTYX", "АВЕКМНОРСТУХ"
PLATE = "^(?:[АВЕКМНОРСТУХ][0-9]{3}[АВЕКМНОРСТУХ]{2} ?[0-9]{2,3}|[АВЕКМНОРСТУХ]{2}[0-9]{4} ?[0-9]{2,3})$"


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).try_cast("int")


def _check(c: Column, weights: tuple[int, ...]) -> Column:
    total = sum((_digit(c, i) * w for i, w in enumerate(weights)), F.lit(0))
    return total % 11 % 10 == _digit(c, len(weights))


def is_inn(c: Column) -> Column:
    ten = c.rlike("^[0-9]{10}$") & _check(c, INN10)
    twelve = c.rlike("^[0-9]{12}$") & _check(c, INN12A) & _check(c, INN12B)
    return F.coalesce(ten | twelve, F.lit(False))


def is_kpp(c: Column) -> Column:
    return c.rlike("^[0-9]{4}[0-9A-ZА-Я]{2}[0-9]{3}$")


def is_ogrn(c: Column) -> Column:
    short = c.rlike("^[0-9]{13}$") & (F.substring(c, 1, 12).try_cast("long") % 11 % 10 == _digit(c, 12))
    long = c.rlike("^[0-9]{15}$") & (F.substring(c, 1, 14).try_cast("long") % 13 % 10 == _digit(c, 14))
    return F.coalesce(short | long, F.lit(False))


def substitutions(c: Column) -> Column:
    """All strings with one digit of ``c`` replaced by another."""
    at = F.sequence(F.lit(1), F.length(c))
    one = lambda i: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(F.substr(c, F.lit(1), i - 1), d.cast("string"), F.substr(c, i + 1, F.length(c))))
    return F.array_distinct(F.filter(F.flatten(F.transform(at, one)), lambda x: x != c))


def deletions(c: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(c))
    return F.array_distinct(F.transform(at, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1, F.length(c)))))


def fix(c: Column, valid, lengths: tuple[int, int]) -> Column:
    """The one valid neighbour by a substitution or deletion; null if there are none or several, or ``c`` is valid."""
    near = F.array_distinct(F.filter(F.concat(substitutions(c), deletions(c)), valid))
    return F.when(c.rlike(f"^[0-9]{{{lengths[0]},{lengths[1]}}}$") & ~valid(c) & (F.size(near) == 1), F.get(near, F.lit(0)))


def fix_inn(c: Column) -> Column:
    return fix(c, is_inn, (10, 13))


def fix_ogrn(c: Column) -> Column:
    return fix(c, is_ogrn, (13, 16))


def clean_digits(c: Column) -> Column:
    d = F.translate(c, LOOKALIKE, DIGITS)
    return F.when(d.rlike("^[0-9]+$"), d)


def is_date(c: Column, today: Column) -> Column:
    """A calendar date DD.MM.YYYY from ten years before ``today``'s year to one after."""
    d = F.try_to_timestamp(c, F.lit("dd.MM.yyyy")).cast("date")
    return F.coalesce(c.rlike(r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$") & F.year(d).between(F.year(today) - 10, F.year(today) + 1), F.lit(False))


def fix_date(c: Column) -> Column:
    """A loosely written day, month and year as DD.MM.YYYY; two-digit years are of the 2000s."""
    sign = r"[0-9OoОо|lIZzBSsGT]"
    pattern = rf"^\s*({sign}{{1,2}})[.,\s\-/]({sign}{{1,2}})[.,\s\-/]({sign}{{2,4}})\s*$"
    d, m, y = (clean_digits(F.regexp_extract(c, pattern, i)) for i in (1, 2, 3))
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    iso = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    day = F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(d.isNotNull() & m.isNotNull() & y.isNotNull() & F.year(day).between(1900, 2100), F.date_format(day, "dd.MM.yyyy"))


def group_thousands(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=[0-9])(?=([0-9]{3})+$)", " ")


def fix_amount(c: Column) -> Column:
    """``1 234,56``: thousands apart, two places, by padding or cutting."""
    pattern = r"(?iu)^\s*([0-9\sOoОо]+)(?:[,.]([0-9\sOoОо]{1,2}))?(?:\s*(?:руб\.?|коп\.?|р\.|₽))?\s*$"
    whole = clean_digits(F.regexp_replace(F.regexp_extract(c, pattern, 1), r"\s+", ""))
    raw = F.regexp_replace(F.regexp_extract(c, pattern, 2), r"\s+", "")
    frac = F.when(raw == "", "").otherwise(clean_digits(raw))
    return F.when(whole.isNotNull() & frac.isNotNull(), F.concat(group_thousands(whole), F.lit(","), F.rpad(frac, 2, "0")))


def fix_phone(c: Column) -> Column:
    """``+7 (XXX) XXX-XX-XX`` of ten digits, or eleven that start with 7 or 8."""
    d = F.regexp_replace(F.translate(c, LOOKALIKE, DIGITS), "[^0-9]", "")
    d = F.when(F.length(d) == 10, F.concat(F.lit("7"), d)).when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("7"), F.substring(d, 2, 10))).otherwise(d)
    shown = F.concat(F.lit("+7 ("), F.substring(d, 2, 3), F.lit(") "), F.substring(d, 5, 3), F.lit("-"), F.substring(d, 8, 2), F.lit("-"), F.substring(d, 10, 2))
    return F.when(d.rlike("^7[3-9][0-9]{9}$"), shown)


def plate(c: Column) -> Column:
    return F.translate(F.upper(c), PLATE_LATIN, PLATE_CYRILLIC)


def is_plate(c: Column) -> Column:
    return F.trim(F.replace(plate(c), F.lit("  "), F.lit(" "))).rlike(PLATE)


def iso_to_ru(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd")), "dd.MM.yyyy")


def ru_to_iso(c: Column) -> Column:
    return F.date_format(F.try_to_timestamp(c, F.lit("dd.MM.yyyy")), "yyyy-MM-dd")


def check_digit(c: Column, weights: tuple[int, ...]) -> Column:
    """The digit that closes a number whose first digits have ``weights``: their sum modulo 11, modulo 10."""
    total = sum((_digit(c, i) * w for i, w in enumerate(weights)), F.lit(0))
    return F.pmod(F.pmod(total, F.lit(11)), F.lit(10)).cast("int")
