"""Byte-level BPE ids of whole texts, by `tokenizers`, with a word cache in numpy.

Byte-level BPE encodes each pre-token by itself, so a text's ids are its pre-tokens' ids
end to end. Pre-tokens are cut here with array operations after the vocabulary's pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
each distinct one is encoded once by the tokenizer's model, and the rest is table lookup.
Texts with other characters than printable ASCII, its white space and the letters
U+00C0 to U+017F go to the tokenizer whole. Tests hold both ways equal.
"""

from __future__ import annotations

import functools
import os

import numpy as np

from pagelathe.llm import _text as T

VOCABULARY = "byte_bpe_50k.json"
OTHER, LETTER, DIGIT, SIGN, SPACE, BLANK = range(6)

_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[0x20] = SPACE
_CLASS[0x09:0x0E] = BLANK
_CLASS[0xC3:0xC6] = _CLASS[0x80:0xC0] = LETTER
_SLOTS, _MOST_PIECES, _MOST_IDS = 1 << 20, 1_500_000, 8_000_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where pre-tokens start, and per text whether that holds (else: use the tokenizer)."""
    n = len(buf)
    kind = _CLASS[buf]
    odd = kind == OTHER
    lead = np.flatnonzero(buf == 0xC3)
    lead = lead[lead + 1 < n]
    odd[lead[(buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)]] = True
    fine = np.ones(len(off) - 1, bool)
    fine[np.searchsorted(off, np.flatnonzero(odd), "right") - 1] = False

    edge = np.zeros(n + 1, bool)
    edge[off] = True
    group = np.where(kind == BLANK, SPACE, kind)
    new = edge[:n].copy()
    new[1:] |= group[1:] != group[:-1]
    start = new.copy()
    run = np.flatnonzero(new & (group != SPACE))
    run = run[(run > 0) & ~edge[run]] if len(run) else run
    before = run[group[run - 1] == SPACE]
    start[before - 1] = True
    start[before[kind[before - 1] == SPACE]] = False

    tick = np.flatnonzero((buf == 0x27) & new)
    tick = tick[(tick + 1 < n)]
    tick = tick[new[tick + 1] & ~edge[tick + 1] & (kind[tick + 1] == LETTER)]
    tick = tick[(tick == 0) | edge[tick] | (kind[tick - 1] != SPACE)]
    if len(tick):
        b1, b2 = buf[tick + 1], np.where((tick + 2 < n) & ~edge[np.minimum(tick + 2, n)], buf[np.minimum(tick + 2, n - 1)], 0)
        size = np.where(np.isin(b1, list(b"stmd")), 1, 0)
        two = ((b1 == ord("r")) & (b2 == ord("e"))) | ((b1 == ord("v")) & (b2 == ord("e"))) | ((b1 == ord("l")) & (b2 == ord("l")))
        size = np.where(two, 2, size)
        tick, size = tick[size > 0], size[size > 0]
        start[tick + 1] = False
        after = tick + 1 + size
        after = after[after < n]
        start[after[(kind[after] == LETTER) & ~edge[after]]] = True
    return np.flatnonzero(start), fine


@functools.lru_cache(maxsize=1)
def _byte_signs() -> dict[int, str]:
    """Byte-level BPE's printable sign for every byte: itself if printable Latin-1, else the next from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of blocks of texts; keeps the pieces that it has seen, up to a bound."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        back = {s: b for b, s in _byte_signs().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int32)
        for word, i in vocab.items():
            self.lengths[i] = len(word) if all(c in back for c in word) else len(word.encode())
        self._forget()

    def _forget(self) -> None:
        # a piece is its 128-bit key (short pieces are their key); a slot that holds none has a key of no piece
        self.keys = np.full((2, _SLOTS), (1 << 64) - 1, np.uint64)
        self.at = np.zeros(_SLOTS, np.int32)
        self.size = np.zeros(_SLOTS, np.int32)
        self.pool, self.used, self.pieces = np.zeros(1 << 16, np.int32), 0, 0

    def _learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        table, tokenize = _byte_signs(), self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w.decode("latin-1").translate(table))] for w in words]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int32, int(size.sum()))
        at = self.used + np.cumsum(size) - size
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.pieces += len(found)
        return at.astype(np.int32), size

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts end to end, and where each text's ids start (one more than texts)."""
        n = len(off) - 1
        start, fine = cut(buf, off)
        end = np.append(start[1:], len(buf))
        keys = np.stack(T.span_keys(buf, start, end))
        h = T.hash_keys(*keys)
        if self.pieces > _MOST_PIECES or self.used > _MOST_IDS:
            self._forget()
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        at, size = self.at[slot], self.size[slot]
        of = np.searchsorted(off, start, "right") - 1
        miss = np.flatnonzero((self.keys[:, slot] != keys).any(axis=0) & fine[of])
        if len(miss):
            _, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            pick = miss[first]
            # pieces of one hash and unequal keys are pieces of their own
            other = np.flatnonzero((keys[:, miss] != keys[:, pick[back]]).any(axis=0))
            back[other] = len(pick) + np.arange(len(other))
            pick = np.concatenate((pick, miss[other]))
            view = buf.tobytes()
            a, s = self._learn([view[x:y] for x, y in zip(start[pick].tolist(), end[pick].tolist(), strict=True)])
            for i, k in enumerate(keys):
                self.keys[i, slot[pick]] = k[pick]
            self.at[slot[pick]], self.size[slot[pick]] = a, s
            at[miss], size[miss] = a[back], s[back]
        size[~fine[of]] = 0
        ids = self.pool[T.ranges(at.astype(np.int64), size.astype(np.int64))]
        sums = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        first_id = sums[np.searchsorted(start, off)]
        if fine.all():
            return ids, first_id
        whole, parts = buf.tobytes(), []
        for i in range(n):
            if fine[i]:
                parts.append(ids[first_id[i] : first_id[i + 1]])
            else:
                parts.append(np.array(self.tokenizer.encode(whole[off[i] : off[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32))
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, with its cache, across tasks."""
    return Encoder(path)
