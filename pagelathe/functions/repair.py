"""Look-alike letters, misread signs, garbage tokens and user rules, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelathe.functions import text as T
from pagelathe.functions import validators as V

#: Letters that look alike, Latin and Cyrillic in the same order.
LATIN, CYRILLIC = "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"
#: Letters that only one of the two scripts has.
ONLY_CYRILLIC = "БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯЁбгджзийлпфцчшщъыьэюяё"
ONLY_LATIN = "DFGIJLNQRSUVWZbdfghijklmnqrstuvwz"
#: Digits misread for letters within Cyrillic words, and signs misread for digits within numbers.
DIGIT_FOR_LETTER_RU = (("0", "о"), ("3", "з"), ("4", "ч"), ("6", "б"), ("8", "в"), ("1", "л"))
LETTER_FOR_DIGIT_RU = (("ОOо", "0"), ("Зз", "3"), ("Чч", "4"), ("бB", "6"), ("Вв", "8"), ("IlI|", "1"))
TWINS_RU = (("H", "Н"), ("B", "В"), ("C", "С"), ("P", "Р"), ("T", "Т"), ("M", "М"), ("A", "А"), ("E", "Е"), ("K", "К"), ("X", "Х"), ("O", "О"), ("a", "а"), ("c", "с"), ("e", "е"), ("o", "о"), ("p", "р"), ("x", "х"), ("y", "у"), ("b", "ь"))
DIGIT_FOR_LETTER_EN = (("0", "o"), ("1", "l"), ("5", "s"))
LETTER_FOR_DIGIT_EN = (("Oo", "0"), ("Il|", "1"), ("Ss", "5"))
PAIRS_EN = (("rn", "m"), ("cl", "d"), ("vv", "w"))
#: Letters that mark a misread token, and signs that frame one.
FOREIGN = "іїєґІЇЄҐàáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝŸÑÇ"
FRAME = " \t\r\n.,;:!?\"'«»()[]{}|\\/=_~^`<>*#$%+‐‑‒–—―‘’“”"
QUOTES = "\"'`‘’‚‛“”„‟"

_CYR, _NUM, _LET = "[А-Яа-яЁё]", "[0-9]", "[A-Za-z]"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c`` with ``c`` worked out once a row, however often ``f`` reads it, within lambdas too."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def weave(c: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """``c`` with every match of ``pattern`` replaced by ``f`` of it."""

    def of(t: Column) -> Column:
        found, rest = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        return F.array_join(F.zip_with(rest, F.transform(found, f), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return once(c, of)


def to_cyrillic(c: Column) -> Column:
    return F.translate(c, LATIN, CYRILLIC)


def to_latin(c: Column) -> Column:
    return F.translate(c, CYRILLIC, LATIN)


def fix_confusables(c: Column) -> Column:
    """Latin look-alikes next to Cyrillic letters read as Cyrillic: runs after one whole, before one their last letter.

    Reading left to right, each repaired letter repairs the next, so a run after a Cyrillic letter turns
    at once; before one only the letter that touches it does.
    """
    after = weave(c, rf"(?<={_CYR})[{LATIN}]+", to_cyrillic)
    return F.when(c.rlike(_CYR), weave(after, rf"[{LATIN}](?={_CYR})", to_cyrillic)).otherwise(c)


def normalize_cyrillic(c: Column) -> Column:
    """``text.normalize`` with look-alikes repaired."""
    return T.strip(fix_confusables(T.normalize(c)))


def collapse(c: Column) -> Column:
    """The normalised text on one line."""
    return T.strip(F.translate(normalize_cyrillic(c), "\n", " "))


def _within(side: str, rules) -> list[tuple[str, str]]:
    return [(f"(?<={side})[{signs}](?={side})", to) for signs, to in rules]


RUSSIAN = [*_within(_CYR, DIGIT_FOR_LETTER_RU), *_within(_NUM, LETTER_FOR_DIGIT_RU), *_within(_CYR, TWINS_RU), (rf"(?U)(?<={_CYR})b(?=\b)", "ь")]
ENGLISH = [*_within(_LET, DIGIT_FOR_LETTER_EN), *_within(_NUM, LETTER_FOR_DIGIT_EN), *[(f"(?<=[a-z]){a}(?=[a-z])", b) for a, b in PAIRS_EN], (r"(?U)\bvv(?=[a-z])", "w")]


def apply_patterns(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Patterns and replacements, one after the other."""
    return reduce(lambda out, r: F.regexp_replace(out, *r), rules, c)


def autocorrect_russian(c: Column) -> Column:
    return apply_patterns(c, RUSSIAN)


def autocorrect_english(c: Column) -> Column:
    return apply_patterns(c, ENGLISH)


@dataclass(frozen=True)
class Rule:
    """A user's replacement: a pattern, or a literal if not ``is_regex``."""

    pattern: str
    replacement: str = ""
    is_regex: bool = True
    case_sensitive: bool = True
    enabled: bool = True


def apply_rules(c: Column, rules: list[Rule]) -> Column:
    """Enabled rules in order; a rule whose pattern does not compile is passed by."""
    import re

    def step(out: Column, r: Rule) -> Column:
        body, to = (r.pattern, r.replacement) if r.is_regex else (re.escape(r.pattern), r.replacement.replace("\\", "\\\\").replace("$", "\\$"))
        try:
            re.compile(body)
        except re.error:
            return out
        if r.is_regex:
            to = re.sub(r"\\(\d)", r"$\1", to.replace("$", "\\$"))
        return F.regexp_replace(out, ("(?U)" if r.case_sensitive else "(?iuU)") + body, to)

    return reduce(step, [r for r in rules if r.enabled and r.pattern], c)


def word_script(word: Column) -> Column:
    """``cyr`` or ``lat`` where only one script's own letters stand in the word, else ``mixed``."""
    cyr, lat = word.rlike(f"[{ONLY_CYRILLIC}]"), word.rlike(f"[{ONLY_LATIN}]")
    return F.when(cyr & ~lat, "cyr").when(lat & ~cyr, "lat").otherwise("mixed")


def script_majority(c: Column) -> Column:
    """The script with three quarters of at least three exclusive letters; else null."""
    cyr, lat = F.regexp_count(c, F.lit(f"[{ONLY_CYRILLIC}]")), F.regexp_count(c, F.lit(f"[{ONLY_LATIN}]"))
    return F.when(cyr + lat < 3, None).when(cyr >= 3 * lat, "cyr").when(lat >= 3 * cyr, "lat")


def _in_script(word: Column, majority: Column, prefer_latin: Column) -> Column:
    kind = F.coalesce(F.nullif(word_script(word), F.lit("mixed")), F.when(prefer_latin, F.lit("lat")), majority)
    return once(kind, lambda k: F.when(k == "cyr", to_cyrillic(word)).when(k == "lat", to_latin(word)).otherwise(word))


def unify_word(word: Column, majority: Column, prefer_latin: Column) -> Column:
    """Look-alikes of one word in the word's script; undecided words follow numbers, then the majority. Addresses and paths stay."""
    skip = word.rlike(r"(?U)https?://|www\.|[\w.-]+@|[A-Za-z]:[\\/]")
    return F.when(skip, word).otherwise(_in_script(word, majority, prefer_latin))


#: Noncharacters, which stand in no proper text: the start of a word, of a numeric word, and a word's end.
_WORD, _NUMERIC, _END = "\ufdd0", "\ufdd1", "\ufdd2"


def unify_scripts(c: Column) -> Column:
    """``unify_word`` over all words. A digit beside the word, or beyond one of ``-_/.``, makes it numeric.

    Words are marked first, numeric ones by their surroundings, then turned in one pass. The three
    noncharacters used as marks are removed from a text that has them. Texts without Cyrillic stay as they are.
    """
    word = r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё'’\-]*+"
    marked = F.regexp_replace(F.translate(c, _WORD + _NUMERIC + _END, ""), word, f"{_WORD}$0{_END}")
    marked = F.regexp_replace(marked, rf"(?<=\p{{Nd}}|\p{{Nd}}[-_/.]){_WORD}", _NUMERIC)
    marked = F.regexp_replace(marked, rf"{_WORD}({word}{_END}(?=[-_/.]?\p{{Nd}}))", f"{_NUMERIC}$1")

    def turned(majority: Column) -> Column:
        return weave(marked, f"[{_WORD}{_NUMERIC}]{word}{_END}", lambda m: _in_script(F.substr(m, F.lit(2), F.length(m) - 2), majority, m.startswith(_NUMERIC)))

    return F.when(c.rlike(f"[{CYRILLIC}{ONLY_CYRILLIC}]"), once(script_majority(c), turned)).otherwise(c)


def script_runs(word: Column) -> Column:
    """Runs of letters of one script, other signs aside."""
    letters = F.regexp_replace(word, "[^А-яЁёA-Za-z]", "")
    return F.regexp_count(letters, F.lit("[А-яЁё]+|[A-Za-z]+"))


def _class(signs: str) -> str:
    return "".join("\\" + s if s in "\\[]^-&" else s for s in signs)


def is_garbage_token(token: Column) -> Column:
    """Quotes within a word or at its end, foreign letters, three script runs, or a mix of punctuation."""
    quote, letter = f"[{_class(QUOTES)}]", "[А-ЯЁа-яёA-Za-z]"
    core = F.regexp_replace(token, f"^[{_class(FRAME)}]+|[{_class(FRAME)}]+$", "")
    bare = (F.length(token) > 1) & ~token.rlike(r"(?s)^(.)\1*$")
    inside = token.rlike(f"[А-ЯЁа-яёA-Za-z0-9]{quote}+{letter}") | token.rlike(r"\p{Nd}[\"'`‘’]+$")
    tail = core.rlike(f"[А-ЯЁа-яёA-Za-z0-9][{_class(QUOTES[:-2])}]+$")
    return F.when(F.coalesce(token, F.lit("")) == "", True).when(inside, True).when(core == "", bare).otherwise(core.rlike(f"[{FOREIGN}]") | tail | (script_runs(core) >= 3))


def is_noise_line(line: Column, ratio: float = 0.5) -> Column:
    """At least ``ratio`` of the tokens are garbage; an empty line is noise."""
    tokens = F.split(T.strip(line), r"(?U)\s+")
    return F.when(T.strip(line) == "", True).otherwise(F.size(F.filter(tokens, is_garbage_token)) >= F.size(tokens) * ratio)


def strip_garbage_tokens(c: Column) -> Column:
    kept = weave(c, r"(?U)\S+", lambda w: F.when(is_garbage_token(w), "").otherwise(w))
    return T.strip(F.regexp_replace(kept, r"(?U)\s{2,}", " "))


def looks_noisy(line: Column) -> Column:
    """Lines of a form's cell that carry nothing: short, wordless, of brackets or of crumbs."""
    s = T.strip(line)
    n, alnum, signs = F.length(s), T.count_alnum(s), F.regexp_count(s, F.lit(r"[\[\](){}|\\/=_~^`<>*#$%]"))
    tokens = F.split(s, r"(?U)\s+")
    crumbs = (F.size(tokens) >= 4) & (F.size(F.filter(tokens, lambda t: F.length(t) <= 2)) > F.size(tokens) * 0.6)
    wordless = ~s.rlike(r"[А-Яа-яЁёA-Za-z]{4,}|\p{Nd}{2}\.\p{Nd}{2}\.\p{Nd}{4}|\p{Nd}{5,}")
    return (n <= 3) | is_noise_line(s) | wordless | (alnum == 0) | (alnum < n * 0.3) | ((signs >= 3) & (signs > n * 0.3)) | crumbs


def clean_value(c: Column, missing: str = "отсутствует", garbage: str = "неразборчиво") -> Column:
    v = F.regexp_replace(c, r"^[ \t\r\n:;,.\-–—|]+|[ \t\r\n:;,.\-–—|]+$", "")
    return F.when(F.coalesce(v, F.lit("")) == "", missing).when(T.is_garbage(v), garbage).otherwise(v)


#: What dates, amounts and phones look like before they are judged.
DATE_LIKE = r"(?U)\b[0-9OoОо|lIZzBSsGT]{1,2}[.,\s\-/][0-9OoОо|lIZzBSsGT]{1,2}[.,\s\-/][0-9OoОо|lIZzBSsGT]{2,4}\b"
AMOUNT_LIKE = r"(?U)\b\p{Nd}{1,3}(?:\s\p{Nd}{3})+(?:[,.]\p{Nd}{1,2})?(?:\s*(?:руб\.?|₽))?\b|\b\p{Nd}+[,.]\p{Nd}{2}\s*(?:руб\.?|₽)\b"
PHONE_LIKE = r"(?U)(?:\+7|\b8)[\s\-().]*[0-9OoОоlIZzBSsG]{3,4}[\s\-().]*[0-9OoОоlIZzBSsG][\s\-().0-9OoОоlIZzBSsG]{5,15}"


def canonical_entities(c: Column) -> Column:
    """Dates, then amounts, then phones in their canonical form where they can be read, else as they are."""

    def fixed(fix: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda m: F.coalesce(fix(m), m)

    steps = ((DATE_LIKE, V.fix_date), (AMOUNT_LIKE, V.fix_amount), (PHONE_LIKE, V.fix_phone))
    return reduce(lambda out, s: weave(out, s[0], fixed(s[1])), steps, c)


def mark_low_words(c: Column, words: Column, opened: str = "[?", closed: str = "?]") -> Column:
    """Whole words of the list ``words`` within marks, the longest first."""
    quoted = F.transform(F.array_sort(F.array_distinct(words), lambda a, b: F.length(b) - F.length(a)), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\w)"))
    return F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, c).otherwise(F.regexp_replace(c, pattern, F.lit(f"{opened}$0{closed}")))


def fold_name(c: Column) -> Column:
    """A name for comparison: lower case, Cyrillic look-alikes as Latin, letters and digits only."""
    return F.regexp_replace(F.translate(F.lower(c), "ёзоеархукмтвн", "e3oeapxykmtbh"), r"[^\p{L}\p{N} ]", "")


def find_inn(c: Column) -> Column:
    """The first valid tax number of a text."""
    return F.get(F.filter(F.regexp_extract_all(c, F.lit(r"(?U)\b(\p{Nd}{10}|\p{Nd}{12})\b"), F.lit(1)), V.is_inn), F.lit(0))


_GRZ = f"[{V.PLATE_CYRILLIC}{V.PLATE_LATIN}]"
PLATE_LIKE = rf"(?:{_GRZ}[0-9]{{3}}{_GRZ}{{2}}\s?[0-9]{{2,3}}|{_GRZ}{{2}}[0-9]{{4}}\s?[0-9]{{2,3}})(?![0-9])"


def find_plate(c: Column) -> Column:
    """The first plate of a text, in Cyrillic letters; null if there is none."""
    return F.nullif(T.strip(V.plate(F.regexp_extract(F.upper(c), PLATE_LIKE, 0))), F.lit(""))


def format_plate(c: Column) -> Column:
    s, l = F.replace(F.upper(c), F.lit(" "), F.lit("")), f"[{V.PLATE_CYRILLIC}]"  # noqa: E741
    car, trailer = rf"^({l})([0-9]{{3}})({l}{{2}})([0-9]{{2,3}})$", rf"^({l}{{2}})([0-9]{{4}})([0-9]{{2,3}})$"
    return F.when(s.rlike(car), F.regexp_replace(s, car, "$1 $2 $3 $4")).when(s.rlike(trailer), F.regexp_replace(s, trailer, "$1 $2 $3")).otherwise(c)


def split_low_words(c: Column, words: Column) -> Column:
    """A text as (span, low): words of the list apart from what is between them, in order; empty spans are left out."""
    quoted = F.transform(F.array_sort(F.array_distinct(words), lambda a, b: F.length(b) - F.length(a)), lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E")))
    pattern = F.concat(F.lit(r"(?U)(?<!\w)(?:"), F.array_join(quoted, "|"), F.lit(r")(?!\w)"))
    part = lambda t, low: F.struct(t.alias("span"), F.lit(low).alias("low"))
    pairs = F.zip_with(F.split(c, pattern, -1), F.regexp_extract_all(c, pattern, F.lit(0)), lambda a, b: F.array(part(a, False), part(F.coalesce(b, F.lit("")), True)))
    whole = F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, F.array(part(c, False))).otherwise(F.flatten(pairs))
    return F.filter(whole, lambda x: x["span"] != "")
