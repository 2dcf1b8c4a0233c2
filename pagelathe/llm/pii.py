"""PII: format-preserving Feistel pseudonyms, in built-in functions only.

One pattern finds mail addresses, IPv4 addresses, card numbers, phone numbers, social security
numbers, bank accounts, dates and credentials. What validates (octets, Luhn, mod 97, calendar,
issued ranges) is permuted within its format by a Feistel network keyed with a secret: numbers
over the product of two moduli, dates over the 400-year cycle of the calendar, letters and digits
sign by sign. A permutation has no collisions, and equal values stay equal across
documents. The rest of the text is untouched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_EDGE, _STOP = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM",
    28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}
_LANDS = "(?:" + "|".join(f"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")" + _STOP
#: A country's length first; else as many groups as there are, up to an account with a country's length.
_IBAN = _LANDS + rf"|[A-Z]{{2}}[0-9]{{2}}(?:(?! {_LANDS}) ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
#: Names that a credential follows, in any case.
_NAMES = "(?i:password|passwd|secret|token|api_key)"
#: In order of preference where two could start at one place.
KINDS = {
    # at most 64 signs before and 253 after the @, as addresses have: no search runs over a whole text from every place
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251}[A-Za-z0-9])?\.[A-Za-z]{2,63}",
    "secret": rf"AKIA[0-9A-Z]{{16}}|{_NAMES}\s{{0,3}}[=:]\s{{0,3}}\"?[A-Za-z0-9_-]{{8,}}",
    "iban": _IBAN,
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": "",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
}
_OTHER = "(?!(?:" + "|".join(f"(?:{KINDS[k]})" for k in ("email", "date", "ip", "ssn", "phone")) + ")" + _STOP + ")"
#: All groups of digits up to another kind; _card finds the cards among them.
KINDS["card"] = rf"(?=[0-9](?:[ -]?[0-9]){{12}}){_OTHER}[0-9]++{_STOP}(?:[ -]{_OTHER}[0-9]++{_STOP})*+"
PATTERN = _EDGE + "(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")" + _STOP
#: What any of the above has in it; texts without it are passed by.
HINT = rf"[0-9@]|AKIA|{_NAMES}\s{{0,3}}[=:]"
_DIGIT_DROP = r"[^0-9]"


def _noise(key: Column, kind: str, turn: Column, value: Column) -> Column:
    """56 keyed bits as a long."""
    digest = F.sha2(F.concat(key, F.lit(f"\x1f{kind}\x1f"), turn.cast("string"), F.lit("\x1f"), value.cast("string"), F.lit("\x1f"), key), 256)
    return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")


def permute(key: Column, kind: str, x: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of 0 .. a*b-1: left and right parts modulo a and b take turns."""

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + _noise(key, kind, i, s["r"]), a)).otherwise(s["l"])
        right = F.when(i % 2 == 1, F.pmod(s["r"] + _noise(key, kind, i, s["l"]), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    start = F.struct(((x - F.pmod(x, b)) / b).cast("long").alias("l"), F.pmod(x, b).alias("r"))
    turns = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(turns, start, turn, lambda s: s["l"] * b + s["r"])


def _power(n: Column) -> Column:
    """10 to the n, as a long, for n up to 18."""
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")


def permute_digits(key: Column, kind: str, digits: Column) -> Column:
    """A keyed permutation of digit strings of one length, up to 18."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    out = permute(key, kind, digits.cast("long"), _power(half), _power(n - half))
    return F.lpad(out.cast("string"), n, "0")


def permute_signs(key: Column, kind: str, text: Column) -> Column:
    """A keyed permutation of strings of one shape: letters keep their case, digits stay digits, the rest stays."""

    def shifted(part: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat(key, F.lit(f"\x1f{kind}\x1f"), i.cast("string"), F.lit("\x1f"), other, F.lit("\x1f"), key), 256)

        def one(c: Column, at: Column) -> Column:
            step = F.conv(F.substr(digest, F.pmod(at, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)

            def turned(low: int, n: int) -> Column:
                return F.chr(F.pmod(code - low + step, F.lit(n)) + low)

            return F.when(c.rlike("^[a-z]$"), turned(97, 26)).when(c.rlike("^[A-Z]$"), turned(65, 26)).when(c.rlike("^[0-9]$"), turned(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.split(part, ""), one), "")

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, shifted(s["l"], s["r"], i)).otherwise(s["l"])
        right = F.when(i % 2 == 1, shifted(s["r"], s["l"], i)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn, lambda s: F.concat(s["l"], s["r"]))


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substr(digits, s["at"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def luhn(body: Column) -> Column:
    """The check digit that closes ``body``."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(1).alias("twice"))

    def step(s: Column, c: Column) -> Column:
        d = c.cast("int") * (s["twice"] + 1)
        return F.struct((s["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (1 - s["twice"]).alias("twice"))

    total = F.aggregate(F.split(F.reverse(body), ""), start, step, lambda s: s["sum"])
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string")


def mod97(text: Column) -> Column:
    """A bank account's remainder: letters count as 10 to 35."""

    def step(s: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97))).otherwise(F.pmod(s * 10 + F.ascii(c) - 48, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


#: Days of the calendar's cycle of 400 years, and two factors of that number.
CYCLE, CYCLE_A, CYCLE_B = 146_097, 189, 773
#: Issued social security numbers: 898 areas (001-899 but 666), 99 groups, 9,999 serials.
SSN_AREAS, SSN_REST = 898, 99 * 9_999


def _email(key: Column, m: Column) -> Column:
    """Both sides by themselves, so that equal domains stay linked; the last label stays."""
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    last = F.substring_index(domain, ".", -1)
    host = F.substr(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    # a short name alone would have few pseudonyms: it is permuted under a key of its domain's
    return F.concat(permute_signs(F.concat(key, F.lit("@"), domain), "email", name), F.lit("@"), permute_signs(key, "domain", host), F.lit("."), last)


def _secret(key: Column, m: Column) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|[A-Za-z_]+\s{0,3}[=:]\s{0,3}\"?)", 0)
    return F.concat(head, permute_signs(key, "secret", F.substr(m, F.length(head) + 1, F.length(m))))


def _ip(key: Column, m: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda o: o.cast("long"))
    ok = F.forall(octets, lambda o: o <= 255)
    x = permute(key, "ip", F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), F.lit(65536).cast("long"), F.lit(65536).cast("long"))
    parts = [F.shiftright(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(ok, F.concat_ws(".", *parts)).otherwise(m)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _card(key: Column, m: Column) -> Column:
    """Of groups of digits, from each on, the most that make a valid number; other groups stay.

    Every group looks at the 19 groups from it on and no more, so long lists of numbers cost their length.
    """
    text = lambda gs, at, n: F.array_join(F.slice(gs, at + 1, n), "")
    digits = lambda t: F.regexp_replace(t, _DIGIT_DROP, "")

    def longest(rest: Column) -> Column:
        """Digits of the longest valid number that ``rest`` begins with and that ends with a group."""
        number = lambda k: F.substr(digits(rest), F.lit(1), F.lit(k))
        fits = lambda k: rest.rlike(rf"^(?:[ -]?[0-9]){{{k}}}(?![0-9])") & (luhn(F.left(number(k), F.lit(k - 1))) == F.right(number(k), F.lit(1)))
        return F.coalesce(*[F.when(fits(k), F.lit(k)) for k in range(19, 12, -1)])

    def moved(t: Column) -> Column:
        d = digits(t)
        new = F.concat(F.substr(d, F.lit(1), F.lit(1)), permute_digits(key, "card", F.substr(d, F.lit(2), F.length(d) - 2)))
        return refill(t, F.concat(new, luhn(new)))

    def numbers(gs: Column) -> Column:
        """Where numbers start and how many groups they have."""

        def step(s: Column, i: Column) -> Column:
            def put(k: Column) -> Column:
                n = F.size(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(gs) - i)), lambda n: F.length(digits(text(gs, i, n))) <= k))
                more = F.concat(s["found"], F.array(F.struct(i.alias("at"), n.alias("n"))))
                return F.when(k.isNull(), s).otherwise(F.struct((i + n).alias("next"), more.alias("found")))

            return _once(F.when(i >= s["next"], _once(text(gs, i, F.lit(19)), longest)), put)

        start = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<struct<at:int,n:int>>)").alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.size(gs) - 1), start, step, lambda s: s["found"])

    def woven(gs: Column) -> Column:
        def of(found: Column) -> Column:
            end = lambda x: F.when(x < 0, F.lit(0)).otherwise(F.get(found, x)["at"] + F.get(found, x)["n"])
            pieces = F.transform(found, lambda p, x: F.concat(text(gs, end(x - 1), p["at"] - end(x - 1)), moved(text(gs, p["at"], p["n"]))))
            last = end(F.size(found) - 1)
            return F.when(F.size(found) == 0, m).otherwise(F.concat(F.array_join(pieces, ""), text(gs, last, F.size(gs) - last)))

        return _once(numbers(gs), of)

    return _once(F.regexp_extract_all(m, F.lit("[ -]?[0-9]+"), F.lit(0)), woven)


def _phone(key: Column, m: Column) -> Column:
    """The last ten digits, or all after a leading + and one digit if there are fewer than eleven."""
    d = F.regexp_replace(m, _DIGIT_DROP, "")
    n = F.length(d)
    head = F.when(n > 10, n - 10).otherwise(F.when(F.substr(m, F.lit(1), F.lit(1)) == "+", 1).otherwise(0))
    new = F.concat(F.substr(d, F.lit(1), head), permute_digits(key, "phone", F.substr(d, head + 1, n)))
    return F.when((n >= 8) & (n <= 15), refill(m, new)).otherwise(m)


def _ssn(key: Column, m: Column) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = (area - 1 - F.when(area > 666, 1).otherwise(0)) * SSN_REST + (group - 1) * 9_999 + serial - 1
    x = permute(key, "ssn", rank, F.lit(SSN_AREAS).cast("long"), F.lit(SSN_REST).cast("long"))
    rest = F.pmod(x, F.lit(SSN_REST).cast("long"))
    a = ((x - rest) / SSN_REST).cast("long") + 1
    s = F.pmod(rest, F.lit(9_999).cast("long"))
    parts = [(F.when(a >= 666, a + 1).otherwise(a), 3), (((rest - s) / 9_999).cast("long") + 1, 2), (s + 1, 4)]
    return F.when(ok, F.concat_ws("-", *[F.lpad(c.cast("string"), n, "0") for c, n in parts])).otherwise(m)


def _iban(key: Column, m: Column) -> Column:
    flat = F.regexp_replace(m, " ", "")
    n = F.length(flat)
    land, body = F.substr(flat, F.lit(1), F.lit(2)), F.substr(flat, F.lit(5), n)
    ok = (n >= 15) & (n <= 34) & (mod97(F.concat(body, F.substr(flat, F.lit(1), F.lit(4)))) == 1)
    new = permute_signs(key, "iban", body)
    check = F.lpad((98 - mod97(F.concat(new, land, F.lit("00")))).cast("string"), 2, "0")
    whole = F.concat(land, check, new)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    spaced = F.aggregate(F.split(m, ""), start, lambda s, c: F.struct(F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(whole, s["at"] + 1, F.lit(1)))).alias("out"), (s["at"] + F.when(c == " ", 0).otherwise(1)).alias("at")), lambda s: s["out"])
    return F.when(ok, spaced).otherwise(m)


def _date(key: Column, m: Column) -> Column:
    def by(form: str) -> Column:
        day = F.try_to_timestamp(m, F.lit(form)).cast("date")
        days = F.datediff(day, F.lit("2000-01-01").cast("date")).cast("long")
        place = F.pmod(days, F.lit(CYCLE).cast("long"))
        moved = permute(key, "date", place, F.lit(CYCLE_A).cast("long"), F.lit(CYCLE_B).cast("long"))
        new = F.date_add(F.lit("2000-01-01").cast("date"), (days - place + moved).cast("int"))
        return F.when(day.isNotNull() & (F.date_format(day, form) == m) & F.year(day).between(1600, 2399), F.date_format(new, form)).otherwise(m)

    return F.when(m.contains("-"), by("yyyy-MM-dd")).when(m.contains("."), by("dd.MM.yyyy")).otherwise(by("MM/dd/yyyy"))


_FORMS: dict[str, Callable[[Column, Column], Column]] = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card, "phone": _phone}


def pseudonym(key: Column, m: Column) -> Column:
    """The pseudonym of one match of PATTERN; the match itself if it does not validate."""
    kinds = [(F.expr("true") & m.rlike(f"^(?:{p})$"), _FORMS[k](key, m)) for k, p in KINDS.items()]
    return reduce(lambda out, kv: F.when(kv[0], kv[1]).otherwise(out), reversed(kinds), m)


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced; all other columns and rows unchanged.

    The same value gives the same pseudonym in every document under one ``key``. Numbers that do not
    validate, and everything else, stay as they are; so does an address of over 64 signs before its @. Null
    text stays null, empty stays empty; the time is linear in a text's length. No shuffle.
    """
    k, text = F.lit(key), F.col(column)

    def woven(found: Column) -> Column:
        out = F.zip_with(F.split(text, PATTERN, -1), F.transform(found, lambda m: pseudonym(k, m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.size(found) == 0, text).otherwise(F.array_join(out, ""))

    return docs.withColumn(column, F.when(text.rlike(HINT), _once(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), woven)).otherwise(text))
