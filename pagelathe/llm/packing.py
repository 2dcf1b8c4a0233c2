"""Harmonic packing of token sequences.

A document's ids, closed by one separator id, are its length q. A document of up to ``capacity`` ids
belongs to class k = capacity // q, and a bin of class k takes exactly k documents of that class, whole; a
worker fills bins without knowing of any other. A bin of k documents is at least k / (k + 1) full. Documents
longer than a bin have to be cut anyway, so they are what fills the rest: a worker keeps the ids
of long documents in a reservoir, gives each filled bin the ids that it lacks, and what the
reservoir holds beyond its bound leaves as whole sequences. Bins that wait for ids are bounded,
too: beyond, and at a task's end, their documents and those of open bins are laid end to end and cut to
whole sequences, the last to powers of two, which need no padding. No shuffle.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import _text as T
from pagelathe.llm import _tokens
from pagelathe.shipping import in_arrow

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


#: Ids that a worker's reservoir holds, and bins that wait for ids, at most (4 bytes an id).
RESERVOIR, WAITING = 1 << 20, 1 << 10


class _Piece:
    """Ids of one document: doc, whether its id is null, start, ids, doc_tokens."""

    __slots__ = ("doc", "none", "start", "ids", "total")

    def __init__(self, doc, none, start, ids, total):
        self.doc, self.none, self.start, self.ids, self.total = doc, none, start, ids, total

    def split(self, n: int) -> _Piece:
        """The first ``n`` ids; the rest stays."""
        head = _Piece(self.doc, self.none, self.start, self.ids[:n], self.total)
        self.start, self.ids = self.start + n, self.ids[n:]
        return head


class _Bins:
    def __init__(self, capacity: int, task: int):
        self.capacity, self.next = capacity, task << 40
        self.open: dict[int, list[_Piece]] = {}
        self.waiting: deque[tuple[list[_Piece], int]] = deque()
        self.reservoir: deque[_Piece] = deque()
        self.held = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list[_Piece]) -> None:
        at = 0
        for p in pieces:
            n = len(p.ids)
            self.rows.append((p.doc, p.none, p.start, n, zlib.crc32(p.ids), p.total, self.next, at))
            at += n
        self.next += 1

    def draw(self, n: int) -> list[_Piece]:
        """``n`` ids of the reservoir."""
        self.held -= n
        out = []
        while n:
            first = self.reservoir[0]
            if len(first.ids) <= n:
                self.reservoir.popleft()
                n -= len(first.ids)
                out.append(first)
            else:
                out.append(first.split(n))
                n = 0
        return out

    def add(self, p: _Piece) -> None:
        q = len(p.ids)
        if q > self.capacity:
            self.reservoir.append(p)
            self.held += q
        else:
            k = self.capacity // q
            group = self.open.setdefault(k, [])
            group.append(p)
            if len(group) == k:
                del self.open[k]
                lacks = self.capacity - sum(len(x.ids) for x in group)
                if lacks:
                    self.waiting.append((group, lacks))
                else:
                    self.emit(group)
        while self.waiting and self.held >= self.waiting[0][1]:
            group, lacks = self.waiting.popleft()
            self.emit(group + self.draw(lacks))
        while self.held > RESERVOIR:
            self.emit(self.draw(self.capacity))
        if len(self.waiting) > WAITING:
            self.flow([x for group, _ in self.waiting for x in group], whole=True)
            self.waiting.clear()

    def flow(self, pieces: list[_Piece], whole: bool) -> None:
        """Pieces end to end, cut to whole sequences; what is left to powers of two, or (``whole``) to the reservoir."""
        todo, total = deque(pieces), sum(len(x.ids) for x in pieces)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        if not whole:
            sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self.reservoir, kept = todo, self.reservoir
        held, self.held = self.held, total
        for n in sizes:
            self.emit(self.draw(n))
        self.reservoir, self.held = kept + todo, held + self.held

    def taken(self) -> tuple | None:
        rows, self.rows = self.rows, []
        return tuple(np.array(c) for c in zip(*rows, strict=True)) if rows else None

    def close(self) -> None:
        """What is left: the reservoir first fills what it can, then everything flows."""
        left = [x for group, _ in self.waiting for x in group] + [x for k in sorted(self.open) for x in self.open[k]]
        rest, self.reservoir, self.held = list(self.reservoir), deque(), 0
        self.waiting.clear()
        self.open = {}
        self.flow(left + rest, whole=False)


def _pack_rows(path: str, capacity: int, separator: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bins = _tokens.encoder(path), _Bins(capacity, TaskContext.get().partitionId())

        def rows() -> Iterator[pa.RecordBatch]:
            found = bins.taken()
            if found:
                doc, none, *rest = found
                cols = [pa.array(doc.astype(np.int64), mask=none.astype(bool)), *(pa.array(np.asarray(c, np.int64)) for c in rest)]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

        for batch in it:
            ids = batch.column(0).fill_null(0).to_pylist()
            none = batch.column(0).is_null().to_pylist()
            for i, _, buf, off in T.text_blocks(batch.column(1)):
                tokens, first = encode(buf, off)
                closed = np.insert(tokens, first[1:], separator).astype("<u4")
                cuts = (first + np.arange(len(first))).tolist()
                for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    # a copy, as what waits would keep the whole block
                    bins.add(_Piece(ids[i + n], none[i + n], 0, closed[a:b].copy(), b - a))
                yield from rows()
        bins.close()
        yield from rows()

    return run


def pack(docs: DataFrame, capacity: int = 1024, separator: int = 0, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents (doc_id, text) in sequences of at most ``capacity`` ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; pieces of a document do not
    overlap and cover its ids and the separator. Sequences are to be padded to ``capacity``, except
    those of a power of two. Null or empty text: the separator alone. Null doc_id: kept, null.
    Repeated rows are documents of their own. No documents: no rows. ``capacity`` is a power of two
    of at least 8. Sequence ids are unique, and repeat if a task runs again on the same rows.
    """
    if capacity < 8 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two of at least 8")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(docs, _pack_rows(vocabulary or _tokens.vocabulary_path(), capacity, separator), SCHEMA)
