"""Vectorised word segmentation and hashing over Arrow string buffers.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. All routines work on a block:
the UTF-8 bytes of some whole texts laid end to end (``buf``) and their byte
offsets (``off``, one more than texts). Nothing here touches Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 1 << 19
U64 = np.uint64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_SEEDS = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_ODD = 0x8CB92BA72F3D8DD7
#: By a number of bytes up to eight: those bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: A text is one block of arrays, of some 60 bytes a byte of text; longer texts are refused.
MAX_TEXT_BYTES = 128 << 20


def text_blocks(col: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(i0, i1, buf, off)``: rows i0..i1 of a string column; nulls read as empty.

    Blocks hold about ``max_bytes``, or one text; a text of over MAX_TEXT_BYTES raises a ValueError.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    if n == 0:
        return
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    if n and int(np.diff(off).max()) > MAX_TEXT_BYTES:
        raise ValueError(f"a text of over {MAX_TEXT_BYTES} bytes")
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of every word, and the index of each text's first word (one more than texts)."""
    word = ~_SPACE[buf]
    prev = np.empty_like(word)
    prev[:1] = False
    prev[1:] = word[:-1]
    edge = off[:-1]
    prev[edge[edge < len(buf)]] = False
    starts = np.flatnonzero(word & ~prev)
    nxt = np.empty_like(word)
    nxt[-1:] = False
    nxt[:-1] = word[1:]
    edge = off[1:] - 1
    nxt[edge[edge >= 0]] = False
    ends = np.flatnonzero(word & ~nxt) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _words_at(buf: np.ndarray, kind: str, more: int) -> np.ndarray:
    """The little-endian number at every byte of ``buf`` and of ``more`` zero bytes after it."""
    padded = np.concatenate((buf, np.zeros(more + 8, np.uint8)))
    return np.ndarray((len(buf) + more,), kind, padded.data, strides=(1,))


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each byte span: spans of up to 15 bytes as they are, with their length; longer ones by XXH3-128."""
    at = _words_at(buf, "<u8", 16)
    n = ends - starts
    k0 = at[starts] & _MASKS[np.minimum(n, 8)]
    k1 = (at[starts + 8] & _MASKS[np.clip(n - 8, 0, 7)]) | (np.minimum(n, 15).astype(U64) << U64(56))
    long = np.flatnonzero(n > 15)
    if len(long):
        view, digest = memoryview(np.ascontiguousarray(buf)), xxhash.xxh3_128_digest
        both = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), "<u8").reshape(-1, 2)
        k0[long], k1[long] = both[:, 0], both[:, 1] | U64(0xFF << 56)
    return k0, k1


def hash_keys(k0: np.ndarray, k1: np.ndarray, seed: int = 0) -> np.ndarray:
    """64 bits of a 128-bit key; seeds give independent ones."""
    return mix(mix(k0 ^ U64(_SEEDS[seed])) + k1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand; seeds 0 and 1 are independent."""
    return hash_keys(*span_keys(buf, starts, ends), seed)


def hash_windows(words: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` word hashes from each position in ``at``, put together in pairs of pairs.

    Two words make a hash, two of these one of four words, and so on; the powers of two that ``size``
    is made of are put together in turn. Nothing is a sum of powers, so no pattern of words cancels out.
    """
    level, width, done, out = mix(words + U64(_SEEDS[seed])), 1, 0, np.full(len(at), size, U64)
    while width <= size:
        if size & width:
            out = mix(out * U64(_ODD) + level[at + done]) if len(at) else out
            done += width
        if 2 * width > size:
            break
        level = mix(level[:-width] * U64(_ODD) + level[width:]) if len(level) > width else level[:0]
        width *= 2
    return out


_X1, _X2, _X3, _X4, _X5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _lane(acc, x: np.ndarray) -> np.ndarray:
    return _rotl(acc + x * _X2, 31) * _X1


def xxh64_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each byte span. Spans of up to 256 bytes are hashed together, longest first; longer ones one by one."""
    n = ends - starts
    out = np.empty(len(n), U64)
    long = np.flatnonzero(n > 256)
    if len(long):
        view = memoryview(np.ascontiguousarray(buf))
        out[long] = [xxhash.xxh64_intdigest(view[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    order = np.argsort(-np.where(n > 256, -1, n).astype(np.int16), kind="stable")[: len(n) - len(long)]
    at, size = starts[order], n[order]
    down = -size  # ascending, for searches
    eight, four = _words_at(buf, "<u8", 16), _words_at(buf, "<u4", 16)
    s = U64(seed)
    with np.errstate(over="ignore"):
        h = np.full(len(at), s + _X5, U64)
        big = int(np.searchsorted(down, -32, "right"))
        if big:
            v = [np.full(big, x, U64) for x in (s + _X1 + _X2, s + _X2, s, s - _X1)]
            for stripe in range(8):
                m = int(np.searchsorted(down, -32 * (stripe + 1), "right"))
                if not m:
                    break
                for k in range(4):
                    v[k][:m] = _lane(v[k][:m], eight[at[:m] + (32 * stripe + 8 * k)])
            g = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                g = (g ^ _lane(U64(0), x)) * _X1 + _X4
            h[:big] = g
        h += size.astype(U64)
        place = at + (size & ~31)
        rest = size & 31
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            h[on] = _rotl(h[on] ^ _lane(U64(0), eight[place[on] + 8 * k]), 27) * _X1 + _X4
        place, rest = place + (rest & ~7), rest & 7
        on = np.flatnonzero(rest >= 4)
        h[on] = _rotl(h[on] ^ (four[place[on]].astype(U64) * _X1), 23) * _X2 + _X3
        place, rest = place + (rest & 4), rest & 3
        for k in range(3):
            on = np.flatnonzero(rest > k)
            h[on] = _rotl(h[on] ^ (buf[place[on] + k].astype(U64) * _X5), 11) * _X1
        h = (h ^ (h >> U64(33))) * _X2
        h = (h ^ (h >> U64(29))) * _X3
    out[order] = h ^ (h >> U64(32))
    return out


def text_index(first: np.ndarray) -> np.ndarray:
    """For every word the index of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start+1, ... for each (start, length), end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at, lengths) + np.repeat(starts, lengths)


def covered(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Boolean mask over n words: inside one of the windows of ``size`` words from ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + size, n), -1)
    return np.cumsum(d[:-1]) > 0


def joined(buf: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text (those in ``keep``) joined by one space: bytes and offsets.

    Every word carries a space after it in the bytes; a text's span leaves out the last one.
    """
    lengths = ends - starts
    if keep is not None:
        starts, lengths = starts[keep], lengths[keep]
        first = np.concatenate(([0], np.cumsum(keep)))[first]
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = np.full(int(at[-1]), 0x20, np.uint8)
    if len(lengths):
        body = np.ones(len(out), bool)
        body[at[1:] - 1] = False
        out[body] = buf[ranges(starts, lengths)]
    return out, at[first]
