"""A shuffle of packed numpy columns: tens of millions of small records as a few thousand binary rows.

Records that belong together (one hash, one document) are dealt to one of C cells, cell c to
partition c mod P. Each map task sorts what it has by cell and sends one row a cell: ``(key int, cell int,
kind int, data binary)``. A task gets its cells in order (Spark's sort spills) and holds one cell at a
time. P and C follow from the bytes of the input, so a cell's size does not grow with it. Before
sending, map tasks settle among themselves whatever they can, so one key gives at most one
record for each block of input, however many rows have it.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.shipping import in_arrow

SCHEMA = "key int, cell int, kind int, data binary"
_ARROW = pa.schema([("key", pa.int32()), ("cell", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Bytes of text for each cell and for each partition.
CELL_BYTES, PART_BYTES = 32 << 20, 256 << 20


@dataclass(frozen=True)
class Plan:
    """``keys``: for each partition a number that Spark's hash partitioning sends there."""

    parts: int
    cells: int
    keys: np.ndarray


def _hash(x: np.ndarray) -> np.ndarray:
    """``hash(x)`` of Spark (Murmur3 of an int, seed 42)."""
    turn = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(k ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def keys_of(parts: int) -> np.ndarray:
    out, low = np.full(parts, -1, np.int32), 0
    while (out < 0).any():
        some = np.arange(low, low + 8 * parts, dtype=np.int32)[::-1]
        empty = out < 0
        found = np.full(parts, -1, np.int32)
        found[_hash(some) % parts] = some
        out[empty] = found[empty]
        low += 8 * parts
    return out


def plan(docs: DataFrame) -> Plan:
    """Partitions and cells for the texts of ``docs`` (text), by their bytes: one pass over their lengths."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    return Plan(parts, parts * max(1, -(-total // (parts * CELL_BYTES))), keys_of(parts))


def _planes(c: np.ndarray) -> np.ndarray:
    """The bytes of a column by place, as high bytes of ids and positions are mostly zero and compress."""
    c = np.ascontiguousarray(c)
    return c.view(np.uint8).reshape(len(c), c.itemsize).T


def pack(*columns: np.ndarray) -> bytes:
    body = b"".join(_planes(c).tobytes() for c in columns)
    return np.array([len(columns[0]), len(body)], np.int64).tobytes() + pa.Codec("zstd", 1).compress(body, asbytes=True)


def unpack(data: bytes, dtypes: list) -> list[np.ndarray]:
    n, size = np.frombuffer(data, np.int64, 2).tolist()
    body = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[16:], decompressed_size=size), np.uint8)
    out, at = [], 0
    for t in dtypes:
        width = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(body[at : at + n * width].reshape(width, n).T).view(t).ravel())
        at += n * width
    return out


def deal(cell: np.ndarray, kind: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row for each cell that has records."""
    order = np.argsort(cell, kind="stable")
    cell, cols = cell[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell)).tolist()
    return [(int(cell[a]), kind, pack(*(c[a:b] for c in cols))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def batches(rows: list[tuple[int, int, bytes]], p: Plan) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most about 8 MB, or one row."""
    at, size = 0, 0
    for i, r in enumerate(rows):
        if size and size + len(r[2]) > 8 << 20:
            yield _batch(rows[at:i], p)
            at, size = i, 0
        size += len(r[2])
    if at < len(rows):
        yield _batch(rows[at:], p)


def _batch(rows: list[tuple[int, int, bytes]], p: Plan) -> pa.RecordBatch:
    cell, kind, data = zip(*rows, strict=True)
    cell = np.array(cell, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(p.keys[cell % p.parts]), pa.array(cell), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], schema=_ARROW)


def cells_of(it: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, int, bytes]]]:
    """Of a partition's rows, for each cell its rows (cell, kind, data)."""
    rows = ((c.as_py(), k.as_py(), d.as_py()) for b in it for c, k, d in zip(b.column(1), b.column(2), b.column(3), strict=True))
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield group


def dealt(df: DataFrame, p: Plan) -> DataFrame:
    """Packed rows on the partitions of their cells."""
    return df.repartition(p.parts, "key")


def with_texts(records: DataFrame, texts: DataFrame, p: Plan) -> DataFrame:
    """Records, dealt, beside ``texts``, which are dealt already: their shuffle is used again, not made anew."""
    if df_conf(texts, "spark.sql.unionOutputPartitioning") != "true":
        return dealt(records.unionByName(texts), p)
    both = dealt(records, p).unionByName(texts)
    # a union that did not lay equal partitions together would miss records, so each row is held against its place
    here = F.spark_partition_id() == F.pmod(F.hash("key"), F.lit(p.parts))
    return both.withColumn("data", F.when(here, F.col("data")).otherwise(F.raise_error(F.lit("partitions of a union were not laid together")).cast("binary")))


def df_conf(df: DataFrame, name: str) -> str:
    return str(df.sparkSession.conf.get(name)).lower()


def by_cell(df: DataFrame, reduce: Callable, schema: str = SCHEMA) -> DataFrame:
    """Rows dealt to cells to ``reduce``: an iterator of batches, by cell and kind."""
    return in_arrow(df.sortWithinPartitions("cell", "kind"), reduce, schema)
