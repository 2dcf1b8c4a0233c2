"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, whole. Byte-level ids spell the text's bytes, so
their lengths give every token's span; spans are joined with the sections' spans by a
sorted search. A token that crosses a section's end is allocated by a rule:
``first`` (the section of its first byte), ``last``, or ``most`` (the section that
holds most of its bytes, the earlier on a tie).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import _text as T
from pagelathe.llm import _tokens
from pagelathe.shipping import in_arrow

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long, doc_tokens long"


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For token spans and ascending section starts: each token's section, and whether it crosses an end."""
    a = np.searchsorted(cuts, starts, "right") - 1
    b = np.searchsorted(cuts, ends - 1, "right") - 1
    if rule == "first":
        got = a
    elif rule == "last":
        got = b
    else:
        got = a.copy()
        for i in np.flatnonzero(a != b).tolist():
            inner = np.concatenate(([starts[i]], cuts[a[i] + 1 : b[i] + 1], [ends[i]]))
            got[i] = a[i] + int(np.argmax(np.diff(inner)))
    return got, a != b


def _rows(path: str, rule: str, by_line: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokens.encoder(path)
        for batch in it:
            for i, j, buf, off in T.text_blocks(batch.column(1)):
                ids, first = encode(buf, off)
                ends = np.cumsum(encode.lengths[ids], dtype=np.int64)
                if len(ends) and ends[-1] != len(buf):
                    raise ValueError("the tokens do not spell the text")
                starts = ends - encode.lengths[ids]
                # a section is a line with its newline; an empty text has one empty section
                lines = np.flatnonzero(buf == 0x0A) + 1 if by_line else np.zeros(0, np.int64)
                lines = lines[~np.isin(lines, off)]
                filled = np.diff(off) > 0
                cuts = np.union1d(lines, off[:-1][filled])
                got, crossing = attribute(starts, ends, cuts, rule)
                counts, crossed = np.bincount(got, minlength=len(cuts)), np.bincount(got[crossing], minlength=len(cuts))
                of = np.searchsorted(off[:-1][filled], cuts, "right") - 1
                of = np.flatnonzero(filled)[of] if len(of) else of
                empty = np.flatnonzero(~filled)
                chars = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                stop = np.append(cuts[1:], len(buf))[: len(cuts)]
                base = chars[off[of]]
                section = np.arange(len(cuts)) - np.searchsorted(of, of)
                zero = np.zeros(len(empty), np.int64)
                cols = [np.concatenate((x, zero)) for x in (section, chars[cuts] - base, chars[stop] - base, counts, crossed)]
                of = np.concatenate((of, empty))
                docs = batch.column(0).slice(i, j - i).take(pa.array(of))
                yield pa.RecordBatch.from_arrays([docs, *(pa.array(c.astype(np.int64)) for c in cols), pa.array(np.diff(first)[of])], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    return run


def token_counts(docs: DataFrame, rule: str = "first", sections: str = "lines", vocabulary: str | None = None) -> DataFrame:
    """One row for each section of each document (doc_id, text).

    doc_id, section (from 0), start and end (code points; a line holds its newline), n_tokens
    allocated to it, n_crossing of these that cross a section's end, doc_tokens of the whole
    document. Sections' counts sum to the document's. ``sections``: ``lines`` or ``whole``.
    Null or empty text: one section of no tokens. Null doc_id and repeated rows are kept.
    """
    if rule not in RULES or sections not in ("lines", "whole"):
        raise ValueError(f"rule must be one of {RULES}, sections lines or whole")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(docs, _rows(vocabulary or _tokens.vocabulary_path(), rule, sections == "lines"), SCHEMA)
