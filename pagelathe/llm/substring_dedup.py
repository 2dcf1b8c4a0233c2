"""Substring dedup by difference-cover anchors.

A window is ``window`` consecutive words of one document; it goes if the same
word sequence starts in a document with a smaller id. A difference cover D of
period p has, for every shift, two members that differ by it, so two equal
windows, wherever they stand, hold an equal anchor of ``window - p + 1`` words
that starts at a position of residue in D in both documents. So:

1. every document gives its anchors at cover positions (6 of 31), and anchors
   that two documents share flag their positions;
2. each flag extends to the windows that hold it, and those windows' 128-bit
   hashes are compared: one goes if a smaller document has it;
3. the words that the windows cover leave.

Hashes travel packed (`_packed`); texts are dealt once by document, and both passes that
read them read that one shuffle. Map tasks settle equal anchors and windows among themselves
first and send one record a hash, so a passage that a third of all documents hold costs one
record for each block of input. No pairs are made.

Anchors only say where to look, so 64 bits do; windows are compared by 128 bits, of two
independent hashes of the words (`_text.span_keys`: words of up to 15 bytes are their own key).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import _packed as X
from pagelathe.llm import _text as T
from pagelathe.shipping import in_arrow

#: A perfect difference set: every residue of the period is a difference of two members.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
FLUSH = 1 << 19  # records that a map task gathers before it settles and sends them
FLAG, TEXT, KEY = 0, 1, 2
_FLAGS = [np.int64, np.uint64, np.int32]


def _home(doc: np.ndarray, mark: np.ndarray, cells: int) -> np.ndarray:
    return (T.mix(doc.view(np.uint64) + mark) % np.uint64(cells)).astype(np.int64)


def _settle(keys: list[np.ndarray], doc: np.ndarray, mark: np.ndarray, pos: np.ndarray, done: np.ndarray | None, smaller: bool):
    """Sort by key and document; return the order, and per record whether its key is settled and whether to send it.

    ``smaller``: a record is settled if another document with a smaller id has the key; else if any
    two documents have it. Of each key only the smallest document's records need to be sent.
    """
    order = np.lexsort((pos, mark, doc, *keys[::-1]))
    k, d = [x[order] for x in keys], doc[order]
    new = np.ones(len(d), bool)
    if len(d):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in k])
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    least = d[at][group] if len(at) else d
    if smaller:
        hit = d > least
    else:
        last = d[np.append(at[1:], len(d)) - 1] if len(at) else d
        hit = (last != d[at])[group] if len(at) else np.zeros(0, bool)
        if done is not None and len(at):
            hit |= np.logical_or.reduceat(done[order] > 0, at)[group]
    return order, hit, d == least


class _Flags:
    """Gathers flags (document, mark, position) over cells and sends them in flushes."""

    def __init__(self, p: X.Plan):
        self.p, self.held, self.n = p, [], 0

    def add(self, doc: np.ndarray, mark: np.ndarray, pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            self.held.append((doc, mark, pos.astype(np.int32)))
            self.n += len(doc)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            doc, mark, pos = (np.concatenate(c) for c in zip(*self.held, strict=True))
            self.held, self.n = [], 0
            yield from X.batches(X.deal(_home(doc, mark, self.p.cells), FLAG, doc, mark, pos), self.p)


class _Gather:
    """Collects records of a map task and sends them in flushes."""

    def __init__(self, p: X.Plan, keys: int, smaller: bool):
        self.p, self.n_keys, self.smaller, self.held, self.n = p, keys, smaller, [], 0

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(cols[0]):
            self.held.append(cols)
            self.n += len(cols[0])
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        cols = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        self.held, self.n = [], 0
        keys, (doc, mark, pos) = cols[: self.n_keys], cols[self.n_keys :]
        order, hit, least = _settle(keys, doc, mark, pos, None, self.smaller)
        cols = [c[order] for c in cols]
        doc, mark, pos = (c for c in cols[self.n_keys :])
        rows = X.deal(_home(doc[hit], mark[hit], self.p.cells), FLAG, doc[hit], mark[hit], pos[hit].astype(np.int32)) if hit.any() else []
        keys = [c[least] for c in cols[: self.n_keys]]
        # a record: keys, document, mark of its text, position, whether it is settled
        tail = [doc[least], mark[least], pos[least].astype(np.uint32), hit[least].astype(np.uint8)]
        yield from X.batches(rows + X.deal((keys[0] % np.uint64(self.p.cells)).astype(np.int64), KEY, *keys, *tail), self.p)


def _reduce(p: X.Plan, n_keys: int, smaller: bool):
    """Of each cell: flags pass, as map tasks settled them; keys are settled."""
    types = [np.uint64] * n_keys + [np.int64, np.uint64, np.uint32, np.uint8]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Flags(p)
        for cell in X.cells_of(it):
            held = []
            for _, kind, data in cell:
                if kind == FLAG:
                    yield from out.add(*X.unpack(data, _FLAGS))
                else:
                    held.append(X.unpack(data, types))
            if not held:
                continue
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            del held
            keys, (doc, mark, pos, done) = cols[:n_keys], cols[n_keys:]
            order, hit, _ = _settle(keys, doc, mark, pos, done, smaller)
            pick = order[hit & (done[order] == 0)]
            yield from out.add(doc[pick], mark[pick], pos[pick])
        yield from out.flush()

    return run


def _marks(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """48 bits of each text: with the doc_id they name a row, as equal rows fare alike. (The other bytes are zero and compress.)"""
    view, digest = memoryview(np.ascontiguousarray(buf)), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.uint64) >> np.uint64(16)


def _id_columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(0)
    none = np.asarray(col.is_null())
    return np.asarray(col.fill_null(0)).astype(np.int64), none


def _anchor_rows(p: X.Plan, window: int, period: int, cover: tuple[int, ...]):
    size = window - period + 1
    is_cover = np.isin(np.arange(period), cover)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather(p, 1, False)
        for batch in it:
            ids, none = _id_columns(batch)
            for i, j, buf, off in T.text_blocks(batch.column(1)):
                starts, ends, first = T.words_of(buf, off)
                n = np.diff(first)
                use = (n >= window) & ~none[i:j]
                if not use.any():
                    continue
                h = T.hash_spans(buf, starts, ends)
                of = T.text_index(first)
                pos = np.arange(len(h)) - first[of]
                at = np.flatnonzero(use[of] & is_cover[pos % period] & (pos + size <= n[of]))
                mark = _marks(buf, off)
                of = of[at]
                yield from out.add(T.hash_windows(h, at, size), ids[i:j][of], mark[of], pos[at].astype(np.int32))
        yield from out.flush()

    return run


def _text_rows(p: X.Plan):
    """Whole documents, dealt to their cells in compressed blocks."""

    def send(held: list) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([h[0] for h in held])
        none = np.concatenate([h[1] for h in held])
        mark = np.concatenate([h[2] for h in held])
        text = pa.concat_arrays([h[3] for h in held])
        home = np.where(none, np.arange(len(ids)) % p.cells, _home(ids, mark, p.cells))
        order = np.argsort(home, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(home[order], prepend=-1)), len(order)).tolist()
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            block = pa.record_batch([pa.array(ids[at], mask=none[at]), pa.array(mark[at]), text.take(pa.array(at))], names=["i", "c", "t"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_batch(block)
            rows.append((int(home[at[0]]), TEXT, sink.getvalue().to_pybytes()))
        yield from X.batches(rows, p)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            ids, none = _id_columns(batch)
            col = batch.column(1).cast(pa.large_string())
            for i, j, buf, off in T.text_blocks(col):
                held.append((ids[i:j], none[i:j], _marks(buf, off), col.slice(i, j - i)))
                size += len(buf)
                if size >= 16 << 20:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)

    return run


def _with_flags(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From a partition's rows, of each cell flags first: blocks of documents, each with its flags (text, position)."""
    for cell in X.cells_of(it):
        flags, table, pos = [], None, None
        for _, kind, data in cell:
            if kind == FLAG:
                flags.append(X.unpack(data, _FLAGS))
                continue
            if table is None:
                table, pos = _table(flags)
                flags = []
            with pa.ipc.open_stream(data) as reader:
                for block in reader:
                    yield from _flagged(block, table, pos)


def _table(flags: list) -> tuple[dict, np.ndarray]:
    """By document and mark where its positions lie, and all positions."""
    doc, mark, pos = (np.concatenate(c) for c in zip(*flags, strict=True)) if flags else (np.zeros(0, t) for t in _FLAGS)
    order = np.lexsort((pos, mark, doc))
    doc, mark, pos = doc[order], mark[order], pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(doc))[: len(at)]
    return {(d, c): (a, b) for d, c, a, b in zip(doc[at].tolist(), mark[at].tolist(), at.tolist(), ends.tolist(), strict=True)}, pos


def _flagged(block: pa.RecordBatch, table: dict, pos: np.ndarray) -> Iterator[tuple]:
    ids, none = _id_columns(block)
    mark = np.asarray(block.column(1))
    for i, j, buf, off in T.text_blocks(block.column(2)):
        found = [(0, 0) if x else table.get((d, c), (0, 0)) for d, c, x in zip(ids[i:j].tolist(), mark[i:j].tolist(), none[i:j].tolist(), strict=True)]
        lo, hi = (np.array(x, np.int64) for x in zip(*found, strict=True))
        yield ids[i:j], none[i:j], mark[i:j], buf, off, np.repeat(np.arange(j - i), hi - lo), pos[T.ranges(lo, hi - lo)]


def _window_rows(p: X.Plan, window: int, period: int):
    size = window - period + 1

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Gather(p, 2, True)
        for ids, _, mark, buf, off, of, pos in _with_flags(it):
            if not len(of):
                continue
            starts, ends, first = T.words_of(buf, off)
            n = np.diff(first)
            lo, hi = np.maximum(pos - (window - size), 0), np.minimum(pos, n[of] - window)
            ok = hi >= lo
            lo, hi, of = lo[ok], hi[ok], of[ok]
            inside = np.zeros(len(starts) + 1, np.int32)
            np.add.at(inside, first[of] + lo, 1)
            np.add.at(inside, first[of] + hi + 1, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            words = T.span_keys(buf, starts, ends)
            hashes = [T.hash_windows(T.hash_keys(*words, seed), at, window, seed) for seed in (0, 1)]
            d = np.searchsorted(first, at, "right") - 1
            yield from out.add(*hashes, ids[d], mark[d], (at - first[d]).astype(np.int32))
        yield from out.flush()

    return run


def _result_rows(window: int, with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, none, _, buf, off, of, pos in _with_flags(it):
            starts, ends, first = T.words_of(buf, off)
            gone = T.covered(len(starts), first[of] + pos, window)
            body, at = T.joined(buf, off, starts, ends, first, ~gone)
            view = memoryview(body)
            spans = [(a, max(a, b - 1)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            removed = np.concatenate(([0], np.cumsum(gone)))[first]
            cols = [pa.array(ids, mask=none), pa.array(np.diff(first)), pa.array(np.diff(removed)), pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in spans])]
            if with_text:
                cols.append(pa.array([bytes(view[a:b]).decode() for a, b in spans]))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(cols)])

    return run


def substring_dedup(docs: DataFrame, window: int = 50, period: int = PERIOD, cover: tuple[int, ...] = COVER, with_text: bool = True) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256[, kept_text].

    Words ``[^\\x20\\x09-\\x0D]+`` of the whole text; a word leaves if a window of ``window`` words
    over it also starts in a document with a smaller doc_id. Windows are judged on the input.
    Null or empty text: no words, the digest of nothing. Null doc_id: the row comes back whole,
    as no id is smaller than null and null is smaller than none. Rows that share a doc_id do not
    judge each other; each is judged against smaller ids by its own text. Other columns are not read.
    """
    if not len(cover) or {(a - b) % period for a in cover for b in cover} != set(range(period)) or period >= window:
        raise ValueError("cover must have every residue of the period as a difference, and the period be shorter than the window")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    p = X.plan(docs)
    texts = X.dealt(in_arrow(docs, _text_rows(p), X.SCHEMA), p)
    seen = X.by_cell(X.dealt(in_arrow(docs, _anchor_rows(p, window, period, cover), X.SCHEMA), p), _reduce(p, 1, False))
    windows = X.by_cell(X.with_texts(seen, texts, p), _window_rows(p, window, period))
    gone = X.by_cell(X.dealt(windows, p), _reduce(p, 2, True))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return X.by_cell(X.with_texts(gone, texts, p), _result_rows(window, with_text), schema)
