"""Quality rules: statistics of whole texts and a learned decision list over them.

What the base test rejects is not learned from. Sequential covering in the manner of IREP: a conjunction of thresholds grows on two
thirds of the labelled rows by information gain, is pruned on the last third, and is kept
if it is precise there; the rows that it covers leave and the next rule is learned from
the rest. The list becomes one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import _text as T
from pagelathe.shipping import in_arrow

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
#: What rules may test, from the statistics.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "mark_rate": "n_marks / greatest(n_words, 1)",
}
#: At most about so many labelled rows are learned from.
SAMPLE_ROWS = 20_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def _sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[off])


def _repeated(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place: whether its keys occur more than once, and whether equal ones stand before it."""
    n = len(keys[0])
    order = np.lexsort(keys)
    same = np.ones(max(n - 1, 0), bool)
    for k in keys:
        k = k[order]
        same &= k[1:] == k[:-1]
    again = np.zeros(n, bool)
    again[1:] = same
    many = again.copy()
    many[:-1] |= same
    out = np.empty((2, n), bool)
    out[0, order], out[1, order] = many, again
    return out[0], out[1]


def stats_of(buf: np.ndarray, off: np.ndarray, window: int = 5) -> list[np.ndarray]:
    """STATS of each text of a block."""
    starts, ends, first = T.words_of(buf, off)
    n = np.diff(first)
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    upper = (buf >= 65) & (buf <= 90)
    upper[1:] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)

    of = T.text_index(first)
    pos = np.arange(len(starts)) - first[of]
    at = np.flatnonzero(pos + window <= n[of])
    keys = T.span_keys(buf, starts, ends)
    many, _ = _repeated(*(T.hash_windows(T.hash_keys(*keys, seed), at, window, seed) for seed in (0, 1)), of[at])
    repeat = T.covered(len(starts), at[many], window)

    newline = np.flatnonzero(buf == 0x0A)
    line_start = np.union1d(off[:-1][np.diff(off) > 0], newline[newline + 1 < len(buf)] + 1)
    line_end = np.append(line_start[1:], len(buf))[: len(line_start)]
    line_end -= (line_end > 0) & (buf[np.maximum(line_end - 1, 0)] == 0x0A) if len(line_end) else 0
    line_end = np.maximum(line_end, line_start)
    filled = np.unique(np.searchsorted(line_start, starts, "right") - 1)
    line_of = np.searchsorted(off, line_start[filled], "right") - 1
    _, again = _repeated(*T.span_keys(buf, line_start[filled], line_end[filled]), line_of)
    texts = len(off) - 1
    return [
        n,
        _sum(inside & ((buf & 0xC0) != 0x80), off),
        _sum(_SYMBOL[buf], off),
        np.bincount(line_of[again], minlength=texts),
        _sum(repeat, first),
        np.bincount(line_of, minlength=texts),
        _sum(upper, off),
        _sum(_MARK[buf], off),
    ]


def _stat_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, buf, off in T.text_blocks(batch.column(1)):
            cols = [pa.array(c.astype(np.int64)) for c in stats_of(buf, off)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], names=["doc_id", *STATS])


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, STATS...) of each row's whole text; null text counts as empty, all zero."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(docs, _stat_rows, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, whether at least, threshold); what it covers is rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, value in self.tests:
            x = F.expr(FEATURES[name])
            out = out & (x >= value if above else x < value)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>=' if a else '<'} {v:.4g}" for n, a, v in self.tests)


def _covers(tests, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    m = np.ones(n, bool)
    for name, above, value in tests:
        m &= x[name] >= value if above else x[name] < value
    return m


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 10, max_rules: int = 12, max_tests: int = 4) -> list[Rule]:
    """An ordered list of rules for the bad rows; empty if there are no good or no bad rows.

    A rule stays if it covers ``least`` bad rows of those left, and in the pruning third at least
    ``precision`` of what it covers is bad.
    """
    n = len(bad)
    part = np.arange(n) % 3 == 2
    left, rules = np.ones(n, bool), []
    for _ in range(max_rules):
        grow, prune = left & ~part, left & part
        if bad[grow].sum() < least or not (~bad[grow]).any():
            break
        tests: list[tuple[str, bool, float]] = []
        inside = grow.copy()
        while len(tests) < max_tests and (~bad[inside]).any():
            p0, n0 = bad[inside].sum(), inside.sum()
            best = (1e-9, None)
            for name in FEATURES:
                v, b = x[name][inside], bad[inside]
                order = np.argsort(v, kind="stable")
                v, c = v[order], np.cumsum(b[order])
                edge = np.flatnonzero(v[1:] > v[:-1])
                if not len(edge):
                    continue
                low_p, low_n = c[edge], edge + 1
                for above, p, m in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= least // 2, p * (np.log2(p / m) - np.log2(p0 / n0)), -1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (name, above, float((v[edge[k]] + v[edge[k] + 1]) / 2)))
            if best[1] is None:
                break
            tests.append(best[1])
            inside &= _covers(tests[-1:], x, n)
        if not tests:
            break

        def worth(t, prune=prune) -> float:
            m = _covers(t, x, n) & prune
            return (bad[m].sum() - (~bad[m]).sum()) / max(1, m.sum()) if m.any() else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        hit = _covers(tests, x, n)
        held = hit & prune
        if bad[hit & left].sum() < least or not held.any() or bad[held].mean() < precision:
            break
        rules.append(Rule(tuple(tests)))
        left &= ~hit
    return rules


#: What fails before any rule is asked.
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules for rows labelled 0 that the base test lets pass, from at most ``sample_rows`` labelled documents.

    Documents are drawn by a hash of the id; of a document labelled twice the lower label counts, of several
    texts of one id the one with the least statistics. So the same tables give the same rules. Null ids and labels are left out.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    total = ids.count()
    keep = min(1.0, 0.95 * sample_rows / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    drawn = ids.where(place < int(keep * (1 << 20)) + 1).orderBy(place, "doc_id").limit(sample_rows)
    # at most sample_rows of 12 bytes are broadcast, and as many rows of numbers come back
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(drawn), "doc_id", "left_semi")
    one = text_stats(texts).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "s.*").where(f"not ({BASE_FAILED})")
    seen = one.join(F.broadcast(drawn), "doc_id").orderBy("doc_id")
    got = seen.select("y", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()]).toPandas()
    order = np.random.default_rng(7).permutation(len(got))
    return learn({n: got[n].to_numpy()[order] for n in FEATURES}, (got["y"].to_numpy() == 0)[order])


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional: the index of the first rule that holds, else null (keep)."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """STATS and verdict of each row of ``docs`` (doc_id, text).

    doc_id, STATS..., base_failed (n_words < 10, or over a fifth of the words in repeated
    five-word windows), rule (index of the first rule that holds), kept. Null or empty text: all
    counts zero, base_failed. Null doc_id and repeated rows are judged like others.
    """
    s = text_stats(docs)
    s = s.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rule", verdict(rules))
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
