"""Makes this package importable by Python workers, whatever is on their own path."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once for each application.

    The driver's own path says nothing of theirs, so it is always sent. Every function that makes a
    Python worker calls this.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        # the driver's file server hands this file out; no executor reads the folder itself
        target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{_ROOT.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


#: Bytes of rows that a worker gets at once, where the session does not say: ten thousand long texts are no batch.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def _ready(spark: SparkSession) -> None:
    ship(spark)
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)


def _give_back() -> None:
    """Return freed memory: a worker lives on between tasks, beside others."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def _tidy(rows: Callable) -> Callable:
    def run(it):  # noqa: ANN001, ANN202
        yield from rows(it)
        _give_back()

    return run


def in_arrow(df: DataFrame, rows: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` by a function of this package."""
    _ready(df.sparkSession)
    return df.mapInArrow(_tidy(rows), schema)


def in_pandas(df: DataFrame, rows: Callable, schema) -> DataFrame:
    """``df.mapInPandas`` by a function of this package."""
    _ready(df.sparkSession)
    return df.mapInPandas(_tidy(rows), schema)
