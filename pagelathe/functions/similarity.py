"""Similarity of short strings, by longest common subsequences kept as bits of one integer."""

from __future__ import annotations


def _common(where: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a string of n signs (each sign's places as bits) and ``other``."""
    full = (1 << n) - 1
    rows = full
    for c in other:
        hit = rows & where.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return n - rows.bit_count()


def _places(s: str) -> dict[str, int]:
    where: dict[str, int] = {}
    for i, c in enumerate(s):
        where[c] = where.get(c, 0) | 1 << i
    return where


def indel_ratio(a: str, b: str) -> float:
    """200 * longest common subsequence / total length; 100 for two empty strings, 0 for one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    return 200.0 * _common(_places(a), len(a), b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string against windows of its length in the longer, cut at both ends."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return 0.0
    if short in long:
        return 100.0
    where, best = _places(short), 0.0
    for w in {long[max(0, i) : i + n] for i in range(1 - n, len(long))} - {""}:
        best = max(best, 200.0 * _common(where, n, w) / (n + len(w)))
    return best
