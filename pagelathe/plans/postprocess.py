"""The clean-up of a reading as one chain of column expressions, each step by a setting."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelathe.functions import repair as R
from pagelathe.functions import text as T
from pagelathe.operators import lookups as L
from pagelathe.shipping import in_arrow, ship


@dataclass(frozen=True)
class Settings:
    """What of the chain is on. ``garbage`` is disabled, lenient or strict; anything else counts as lenient."""

    unicode: bool = True
    hyphens: bool = True
    whitespace: bool = True
    artifacts: bool = True
    garbage: str = "lenient"
    look_alikes: bool = True
    russian: bool = True
    english: bool = True
    rules: tuple[R.Rule, ...] = field(default=())
    rule_seconds: float = 1.0
    identifiers: bool = False
    entities: bool = False


#: Every step.
UNIVERSAL = replace(Settings(), identifiers=True, entities=True)


@F.pandas_udf(StringType())
def _composed(texts):  # noqa: ANN001, ANN202  type hints would be read as the UDF's kind
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else t)


def compose(c: Column) -> Column:
    """NFC. Spark has no function for it; texts below U+0300 are composed as they are and send no sign to Python."""
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x{00}-\x{02FF}]"), c)), c)


def limited_rules(c: Column, rules: tuple[R.Rule, ...], seconds: float = 1.0) -> Column:
    """User rules in order, each text's each rule for at most ``seconds``: a rule that takes longer leaves the text as it was.

    Java's patterns have no limit of time, so rules of users run in Python's ``regex`` module, behind Arrow.
    """
    live = _live(rules)
    if not live:
        return c

    def applied(texts):  # noqa: ANN001, ANN202
        one = _applier(live, seconds)
        return texts.map(one)

    return F.pandas_udf(applied, StringType())(c)


def _live(rules: tuple[R.Rule, ...]) -> list[R.Rule]:
    return [r for r in rules if r.enabled and r.pattern]


def _applier(rules: list[R.Rule], seconds: float) -> Callable[[object], object]:
    """Rules that compile, one after the other, each within its time."""
    import regex

    compiled = []
    for r in rules:
        body, to = (r.pattern, r.replacement) if r.is_regex else (regex.escape(r.pattern), r.replacement.replace("\\", "\\\\"))
        try:
            compiled.append((regex.compile(body, 0 if r.case_sensitive else regex.IGNORECASE), to))
        except regex.error:
            continue

    def one(t: object) -> object:
        for pattern, to in compiled if isinstance(t, str) else []:
            try:
                t = pattern.sub(to, t, timeout=seconds)
            except (TimeoutError, regex.error, IndexError):
                continue
        return t

    return one


def _ruled(docs: DataFrame, column: str, rules: tuple[R.Rule, ...], seconds: float) -> DataFrame:
    """``docs`` with ``limited_rules`` of a column, as a step of its own: as one expression among others it would be worked out again and again."""
    live, names, at = _live(rules), docs.columns, docs.columns.index(column)
    if not live:
        return docs

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = _applier(live, seconds)
        for b in batches:
            columns = [pa.array([one(t) for t in c.to_pylist()], pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.toDF(*[f"c{i}" for i in range(len(names))]), rows, docs.schema)


def broken_rules(rules: list[R.Rule]) -> dict[str, str]:
    """Of rules that do not compile the pattern and why."""
    import regex

    out = {}
    for r in rules:
        if r.is_regex:
            try:
                regex.compile(r.pattern)
            except regex.error as e:
                out[r.pattern] = str(e)
    return out


def process(docs: DataFrame, settings: Settings = Settings(), column: str = "text", key: str = "doc_id", catalog: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``column`` cleaned, in the order of Settings; empty and null texts stay as they are.

    ``catalog`` (value) is needed for identifiers, which look among its values; without one they stay.
    """
    ship(docs.sparkSession)
    steps = [
        (settings.unicode, compose),
        (settings.hyphens, T.merge_hyphenated),
        (settings.whitespace, T.normalize_whitespace),
        (settings.artifacts, T.remove_artifacts),
        (settings.garbage != "disabled", lambda c: T.filter_garbage_lines(c, "strict" if settings.garbage == "strict" else "lenient")),
        (settings.look_alikes, R.unify_scripts),
        (settings.russian, R.autocorrect_russian),
        (settings.english, R.autocorrect_english),
    ]
    out = docs
    for on, step in steps:
        if on:
            out = out.withColumn(column, F.when(F.coalesce(F.col(column), F.lit("")) == "", F.col(column)).otherwise(step(F.col(column))))
    out = _ruled(out, column, settings.rules, settings.rule_seconds)
    if settings.identifiers and catalog is not None:
        out = L.fix_identifiers(out, catalog, key, column)
    return out.withColumn(column, R.canonical_entities(F.col(column))) if settings.entities else out


def universal(docs: DataFrame, column: str = "text", key: str = "doc_id", catalog: DataFrame | None = None) -> DataFrame:
    """``process`` with every step on."""
    return process(docs, UNIVERSAL, column, key, catalog)
