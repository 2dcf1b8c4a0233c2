"""Text normalisation and line predicates as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Soft hyphen, zero-width and direction marks that carry no text.
INVISIBLE = r"[\x{AD}\x{200B}-\x{200D}\x{FEFF}\x{202A}\x{202C}]"
#: Hyphen-minus and the dashes that break a word at a line's end.
DASHES = "-‐‑‒–—―−"
#: Signs that rulers are made of.
RULER = r"^[-=_*~`.•·]{3,}$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_invisible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def join_hyphen_breaks(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)([А-Яа-яЁёA-Za-z])[{DASHES}]\s*\n\s*([А-Яа-яЁёA-Za-z])", "$1$2")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\x{A0}\x{2009}\x{202F}]+", " ")


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{2,}", "\n")


def unix_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def normalize(c: Column) -> Column:
    """Invisible signs, line ends, hyphen breaks, spaces, blank lines, ends; in this order."""
    return strip(reduce(lambda x, f: f(x), (strip_invisible, unix_newlines, join_hyphen_breaks, collapse_spaces, collapse_newlines), c))


def merge_hyphenated(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])", "$1$2")


def normalize_whitespace(c: Column) -> Column:
    """Line ends to newline, runs of blanks to one space, no blank at a line's end, at most one empty line."""
    c = F.regexp_replace(unix_newlines(c), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def remove_artifacts(c: Column) -> Column:
    """Drop lines that are not blank and have no letter or digit."""
    return F.array_join(F.filter(lines(c), lambda x: (strip(x) == "") | x.rlike(r"[\p{L}\p{N}]")), "\n")


def char_stats(c: Column) -> Column:
    """Letters, digits and other signs, white space aside."""
    dense = F.regexp_replace(c, r"(?U)\s+", "")
    letters, digits = F.regexp_replace(dense, r"[^\p{L}]", ""), F.regexp_replace(dense, r"[^\p{Nd}]", "")
    return F.struct(F.length(letters).alias("letters"), F.length(digits).alias("digits"), (F.length(dense) - F.length(letters) - F.length(digits)).alias("other"))


def is_ruler(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "").rlike(RULER)


#: More than half signs: a line has two in a row, spaces aside, or is one sign.
_SIGNS = r"(?U)[^\p{L}\p{Nd}\s]\s*[^\p{L}\p{Nd}\s]|^\s*[^\p{L}\p{Nd}\s]\s*$"
#: Any sign, or a lone letter.
_SOME_SIGN = r"(?U)[^\p{L}\p{Nd}\s]|^\s*\p{L}\s*$"


def is_garbage_line(c: Column, strict: bool = False) -> Column:
    """Rulers and walls of signs; if strict, lone letters and lines with two fifths of signs too.

    One pattern passes by most lines of prose; signs are counted in the rest only, each line's once.
    """

    def counted(n: Column) -> Column:
        total = n["letters"] + n["digits"] + n["other"]
        loose = (total > 0) & ((n["letters"] > 0) | (n["other"] > 0)) & (n["other"] * 10 >= total * 7)
        if not strict:
            return loose
        return loose | ((total == 1) & (n["letters"] == 1)) | ((total >= 3) & (n["other"] * 5 >= total * 2))

    walls = F.get(F.transform(F.transform(F.array(F.regexp_replace(c, r"(?U)\s+", "")), char_stats), counted), F.lit(0))
    return c.rlike(_SOME_SIGN if strict else _SIGNS) & (is_ruler(c) | walls)


def filter_garbage_lines(c: Column, strictness: str = "lenient") -> Column:
    if strictness == "disabled":
        return c
    kept = F.filter(lines(F.regexp_replace(c, r"\n$", "")), lambda x: ~is_garbage_line(x, strictness == "strict"))
    return F.when(F.coalesce(c, F.lit("")) == "", c).otherwise(F.array_join(kept, "\n"))


def is_garbage(c: Column) -> Column:
    """No Cyrillic or Latin letter and no digit."""
    return ~c.rlike("[А-Яа-яЁёA-Za-z0-9]")


def count_alnum(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def count_needle(c: Column, needle: str) -> Column:
    """Occurrences of a literal, letters of either case."""
    return F.regexp_count(F.lower(c), F.lit("\\Q" + needle.lower() + "\\E"))


def fold_number(c: Column) -> Column:
    """Cyrillic А, Е, О read as Latin, upper case."""
    return F.upper(F.translate(c, "АЕО", "AEO"))


def script_of(c: Column) -> Column:
    """``c`` for Cyrillic, ``l`` for Latin, else empty, of one sign."""
    return F.when(c.rlike("^[А-Яа-яЁё]$"), "c").when(c.rlike("^[A-Za-z]$"), "l").otherwise("")


def is_substantial_page(c: Column) -> Column:
    """At least 50 signs and three tokens of two word signs: a text layer worth keeping."""
    return (F.length(strip(c)) >= 50) & (F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]{2,}")) >= 3)


def is_rescuable(word: Column, conf: Column, low: float = 30, high: float = 75, least: int = 3) -> Column:
    return conf.between(low, high) & (F.length(word) >= least) & word.rlike(r"\p{L}")


def keep_capitals(word: Column, conf: Column) -> Column:
    """Short Cyrillic abbreviations survive a low confidence."""
    return (conf >= 25) & word.rlike("^[А-ЯЁ]{3,7}$")


def is_brand_suspect(word: Column) -> Column:
    return ~word.rlike(r"\p{Nd}") & word.rlike(r"(?<!\p{L})\p{Lu}{3,10}(?!\p{L})")
