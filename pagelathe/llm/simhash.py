"""SimHash near-dedup with covering locality-sensitive hashing.

Each text has a 64-bit SimHash over its shingles' XXH64. Every bit position
draws a nonzero vector of r+1 bits; for each of the 2^(r+1)-1 nonzero vectors v
one table keeps the bits whose vector is not orthogonal to v. Any r vectors of
r+1 bits have a common orthogonal v, so two fingerprints within r bits agree
on all kept bits of some table: no pair within the radius is missed.

Documents with one fingerprint are one node. Within a table's bucket, members
differ in the left-out bits only. Two members are within two bits exactly if
some value within one bit of both exists, so large buckets are dealt anew by
these midpoints, of which each has at most 1 + left-out bits members; no bucket
is searched pair by pair and none is held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.llm import _text as T
from pagelathe.llm.graph import by_count, checkpointed, components, salted
from pagelathe.shipping import in_arrow

RADIUS = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The eight bits of a byte, one in each byte of a word.
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(7 - i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def _bit_counts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text how many of its hashes have each bit set, lowest bit first."""
    n = len(first) - 1
    counts = np.zeros((n, 64), np.int64)
    if not len(h):
        return counts
    # eight sums in a word of eight bytes hold up to 255 hashes
    length = np.diff(first)
    pieces = -(-length // 255)
    piece_of = np.repeat(np.arange(n), pieces)
    at = first[:-1][piece_of] + 255 * T.ranges(np.zeros(n, np.int64), pieces)
    lanes = h.astype("<u8").view(np.uint8).reshape(-1, 8)
    start = np.concatenate(([0], np.cumsum(pieces)))[:-1]
    some = length > 0
    for k in range(8):
        sums = np.add.reduceat(_SPREAD[lanes[:, k]], at).astype("<u8").view(np.uint8).reshape(-1, 8)
        whole = np.add.reduceat(sums.astype(np.int64), start[some], axis=0)
        counts[some, 8 * k : 8 * k + 8] = whole[:, ::-1]
    return counts


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the bits that over half of its hashes have set."""
    bits = 2 * _bit_counts(h, first) > np.diff(first)[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64, copy=False)


def fingerprints_of(buf: np.ndarray, off: np.ndarray, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text of a block, as signed 64-bit numbers."""
    buf = _LOWER[buf]
    starts, ends, first = T.words_of(buf, off)
    body, at = T.joined(buf, off, starts, ends, first)
    n = np.diff(first)
    m = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    stop = np.cumsum(ends - starts + 1) - 1
    begin = stop - (ends - starts)
    lead = T.ranges(first[:-1], m)
    last = lead + np.repeat(np.minimum(shingle, np.maximum(n, 1)) - 1, m)
    h = T.xxh64_spans(body, begin[lead], stop[last], 42)
    return majority(h, np.concatenate(([0], np.cumsum(m)))).view(np.int64)


def _fingerprint_rows(shingle: int, names: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, buf, off in T.text_blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(fingerprints_of(buf, off, shingle))], names=names)

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): ``fp`` the signed 64-bit SimHash of the whole text; 0 for null or wordless texts."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_arrow(docs, _fingerprint_rows(shingle, ["doc_id", "fp"]), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The bits that each table keeps; bit i has the vector 1 + i mod (2^(radius+1) - 1)."""
    top = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if bin((1 + i % top) & v).count("1") % 2) for v in range(1, top + 1)]


def covering_keys(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """One key for each table of each unsigned fingerprint; those within ``radius`` bits share one at least."""
    tables = [T.mix(np.full(1, t, np.uint64)) ^ (fps & np.uint64(m)) for t, m in enumerate(covering_masks(radius))]
    return T.mix(np.stack(tables, axis=1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that join exactly what lies within ``radius`` bits.

    Not every such pair is listed: those that share a midpoint are listed as a star, so what is
    within the radius is joined by listed links between fingerprints within the radius.
    """
    if radius not in (1, 2):
        raise ValueError("midpoints of one bit serve a radius of 1 or 2")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("mask"), F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]).alias("free")) for t, m in enumerate(covering_masks(radius))])
    keyed = nodes.select("fp", F.explode(tables).alias("k")).select("fp", "k.t", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"), "k.free")
    shared = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key")
    close = keyed.join(shared, ["t", "key"], "left_semi")
    mids = close.select("fp", "t", F.explode(F.concat(F.array(F.col("fp")), F.transform("free", lambda b: F.col("fp").bitwiseXOR(b)))).alias("mid"))
    # a midpoint's members are itself and its neighbours in the left-out bits: a bounded group
    group = mids.groupBy("t", "mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    if radius == 2:
        star = group.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:
        star = group.where(F.array_contains("fps", F.col("mid"))).select(F.col("mid").alias("a"), F.explode("fps").alias("b"))
    return star.where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, fingerprint, component_id.

    ``component_id``: the smallest doc_id reachable over links of at most ``radius`` bits, itself
    included. Fingerprints: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, ``shingle``-word shingles
    with repeats (fewer words: the whole sequence; none, or null text: zero). A null doc_id takes part
    in links and gets the smallest id of its component (null only if no member has an id). Rows that
    repeat are kept. Other columns are not read.
    """
    # 16 bytes a document, read several times: written once, not computed anew
    fps = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(salted(fps, "fp", {"low": F.min("doc_id")}))
    parts = components(links(nodes.select("fp"), radius)).select(F.col("node").alias("fp"), "component")
    classed = nodes.join(parts, "fp", "left").select("fp", "low", "n", F.coalesce("component", "fp").alias("component"))
    ids = classed.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = checkpointed(classed.join(ids, "component").select("fp", "component_id", "n"))
    out = by_count(fps, by_fp, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
