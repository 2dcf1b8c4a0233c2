"""Language ID: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else reads as one space; n-grams of one to
three characters are hashed to buckets. Counts per language come from a bounded sample
that Spark draws and sums; the log-probability matrix (buckets x languages, a few MB)
is broadcast and blocks of texts are scored with numpy.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from pagelathe.llm import _text as T
from pagelathe.llm.graph import quoted
from pagelathe.shipping import in_arrow

BUCKETS = 1 << 16
#: Texts of so many bytes are scored at once, at some 80 bytes of arrays a byte.
BLOCK_BYTES = 1 << 18
ORDERS = 3
#: At most about so many documents of each language are learned from.
PER_LANGUAGE = 1500
MAX_LANGUAGES = 64
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _signs() -> np.ndarray:
    """For each code point the lower-case letter's, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (grams x orders; BUCKETS for none), where each text's grams start, letters of each text."""
    points = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = (buf & 0xC0) != 0x80
    first = np.concatenate(([0], np.cumsum(lead)))[off]
    c = _signs()[points]
    letter = c != 32
    gap = ~letter
    gap[1:] &= c[:-1] == 32  # of several spaces one stays
    edge = first[:-1][first[:-1] < len(c)]
    gap[edge] = False
    keep = np.flatnonzero(~gap)
    start = np.searchsorted(keep, first)
    n = np.diff(np.concatenate(([0], np.cumsum(letter)))[first])
    c = c[keep]
    out = np.full((len(c), ORDERS), BUCKETS, np.int32)
    of_end = np.repeat(start[1:], np.diff(start))
    at = np.arange(len(c))
    h = np.zeros(len(c), np.uint32)
    for k in range(ORDERS):
        here = c[k:] if k else c
        h = (h[: len(here)] ^ here) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
        b = ((h * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.int32)
        ok = at[: len(here)] + k < of_end[: len(here)]
        if k == 0:
            ok &= here != 32
        out[: len(here), k] = np.where(ok, b, BUCKETS)
    return out, start, n


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + 1, languages) float32: log probabilities; the last row is zero
    prior: np.ndarray  # (languages) log share of the learned rows

    def score(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: index of the language, its share of a tempered posterior, number of letters."""
        b, start, letters = _grams(buf, off)
        total = np.zeros((len(off) - 1, len(self.languages)))
        some = np.flatnonzero(np.diff(start) > 0)
        if len(some):
            per = np.zeros((len(b), len(self.languages)), np.float32)
            for k in range(ORDERS):
                per += self.weights[b[:, k]]
            total[some] = np.add.reduceat(per, start[:-1][some], axis=0, dtype=np.float64) + self.prior
        # grams of a text are not independent: log odds are divided by the root of their number
        odds = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(letters, 1))[:, None]
        p = np.exp(odds)
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        return best, p[np.arange(len(best)), best], letters


def _count_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        langs = batch.column(0).dictionary_encode()
        code = np.asarray(langs.indices)
        names = langs.dictionary.to_pylist()
        sums = np.zeros((len(names), BUCKETS + 1), np.int64)
        for i, j, buf, off in T.text_blocks(batch.column(1), BLOCK_BYTES):
            b, start, _ = _grams(buf, off)
            of = np.repeat(code[i:j], np.diff(start))
            for k in range(len(names)):
                sums[k] += np.bincount(b[of == k].ravel(), minlength=BUCKETS + 1)
        for k, name in enumerate(names):
            at = np.flatnonzero(sums[k, :BUCKETS])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(sums[k, at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, smoothing: float = 0.5) -> Model:
    """Learn from rows (doc_id, text, lang) with text and lang, at most about ``per_language`` of each language.

    Rows are drawn by a hash of doc_id; priors are the languages' shares of all rows. No labelled row: a model
    of no language. At most MAX_LANGUAGES x BUCKETS counts come to the driver.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    if not sizes:
        return Model((), np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    shares = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1 << 20, -(-per_language * (1 << 20) // n)))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < shares[F.col("lang")]).select("lang", "text")
    counts = in_arrow(drawn, _count_rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(sizes))
    table = np.zeros((BUCKETS, len(languages)))
    code = {x: i for i, x in enumerate(languages)}
    at = np.array([code[x] for x in counts["lang"].to_pylist()], np.int64)
    table[np.asarray(counts["bucket"]), at] = np.asarray(counts["n"])
    seen = table.sum(axis=1) > 0
    table = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * seen.sum()))
    # a bucket that no language has says nothing
    table[~seen] = 0
    prior = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.vstack((table, np.zeros((1, len(languages))))).astype(np.float32), np.log(prior / prior.sum()))


def _predict_rows(model, names: list[str], text: int, kept: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        known = np.array([*m.languages, UNDETERMINED], object)
        for batch in it:
            for i, j, buf, off in T.text_blocks(batch.column(text), BLOCK_BYTES):
                if m.languages:
                    best, score, letters = m.score(buf, off)
                    best, score = np.where(letters > 0, best, len(m.languages)), np.where(letters > 0, score, 0.0)
                else:
                    best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                rest = [batch.column(k).slice(i, j - i) for k in range(kept)]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(known[best].tolist(), pa.string()), pa.array(score)], names=names)

    return run


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns of each row, lang_pred and score (0 to 1), under ``names``.

    Reads ``text`` alone. Null text, or text without a letter: ``und`` and score 0. Null ids and
    repeated rows are kept; without a learned language all rows are ``und``. Kept columns may have any
    names but those of the two results.
    """
    columns = [F.col(quoted(k)) for k in keep]
    if "text" in keep and docs.schema["text"].dataType == StringType():
        rows, text = docs.select(*columns), keep.index("text")
    else:
        rows, text = docs.select(*columns, F.col("text").cast("string")), len(keep)
    fields = [*rows.schema.fields[: len(keep)], StructField(names[0], StringType()), StructField(names[1], DoubleType())]
    run = _predict_rows(docs.sparkSession.sparkContext.broadcast(model), [x.name for x in fields], text, len(keep))
    # by place, as columns on their way to Python are looked up by name, dots and all
    return in_arrow(rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]), run, StructType(fields))


def held_out() -> Column:
    """True for rows that nothing is learned from: crc32 of doc_id as text, modulo 3, is 1; or a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
