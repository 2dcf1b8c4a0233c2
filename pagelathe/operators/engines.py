"""Character recognition is an outside engine behind this interface; a fixed one stands in for it in tests."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.shipping import in_pandas

SCHEMA = "path string, page int, text string, confidence double, tier int, error string"


class Engine(ABC):
    """Reads one page's image. Sent to executors, so it must pickle; heavy state belongs into ``read``."""

    name: str = ""

    @abstractmethod
    def available(self) -> tuple[bool, str]:
        """Whether it can run here, and what to do if not."""

    @abstractmethod
    def read(self, image: bytes, config: dict) -> tuple[str, float]:
        """Text and mean confidence; raises if the page cannot be read."""

    def unload(self) -> None:
        """Let go of what is heavy."""


@dataclass
class FixedEngine(Engine):
    """Answers by the image's bytes; raises for those it does not know."""

    answers: dict[bytes, tuple[str, float]] = field(default_factory=dict)
    name: str = "fixed"

    def available(self) -> tuple[bool, str]:
        return True, ""

    def read(self, image: bytes, config: dict) -> tuple[str, float]:
        return self.answers[bytes(image)]


class EchoEngine(Engine):
    """Reads an image's bytes as text; fails on texts that begin with F, and with O by settings without an input."""

    name = "echo"

    def available(self) -> tuple[bool, str]:
        return True, ""

    def read(self, image: bytes, config: dict) -> tuple[str, float]:
        text = bytes(image).decode()
        if text[:1] == "F" or (text[:1] == "O" and "input" not in config):
            raise ValueError("unreadable")
        return text, 90.0


_REGISTRY: dict[str, Callable[[], Engine]] = {"fixed": FixedEngine, "echo": EchoEngine}


def register(kind: str, make: Callable[[], Engine]) -> None:
    _REGISTRY[kind] = make


def get(kind: str) -> Engine:
    return _REGISTRY[kind]()


def recognise(pages: DataFrame, engine: Engine, tiers: list[dict]) -> DataFrame:
    """Read (path, page, data) with each configuration in turn until one works; a page that none reads keeps its error.

    A page is one row and one unit of retry; a failure never costs another page.
    """
    ok, message = engine.available()
    if not ok:
        raise RuntimeError(message)

    def one(data: bytes | None) -> tuple:
        error = "no image"
        for i, config in enumerate(tiers if data is not None else []):
            try:
                return (*engine.read(data, config), i, None)
            except Exception as e:  # noqa: BLE001  an engine may raise anything; the next tier is the remedy
                error = f"{type(e).__name__}: {e}"
        return "", 0.0, None, error

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = [(p, n, *one(d)) for p, n, d in zip(f["path"], f["page"], f["data"], strict=True)]
            out = pd.DataFrame(rows, columns=["path", "page", "text", "confidence", "tier", "error"])
            yield out.astype({"tier": "Int32"})

    return in_pandas(pages.select("path", "page", "data"), batch, SCHEMA)


def fill(rows: DataFrame, text: str, key: str, fields: list[str], missing: tuple[str, ...], filler: Callable[[str, list[str]], dict[str, str]] | None, below: float = 0.4) -> DataFrame:
    """Ask ``filler`` for the open fields of rows whose ``overall`` is under ``below``; off without one.

    ``filler`` gets a text and the open fields' names. Its model and service are its own matter: there is no default.
    """
    if filler is None:
        return rows

    def batch(frames: Iterator) -> Iterator:
        for f in frames:
            for i in f.index[f["overall"] < below]:
                want = [c for c in fields if (f.at[i, c] or "") in ("", *missing)]
                answer = filler(f.at[i, text] or "", want) if want else {}
                for c in want:
                    if (answer.get(c) or "").strip():
                        f.at[i, c], f.at[i, f"{c}_conf"] = answer[c].strip(), 0.6
            yield f

    return in_pandas(rows, batch, rows.schema)


#: Settings of the three further tries at a page that the first cannot read, in order.
TIERS = (
    {"input": "raw", "steps": ("sauvola", "clahe_3", "background", "denoise"), "psm": 6},
    {"input": "raster", "dpi": 200, "gray": True, "psm": 6, "optimize": 0},
    {"input": "raster", "dpi": 150, "gray": True, "psm": 11, "optimize": 0},
)


def recognise_documents(pages: DataFrame, engine: Engine, first: dict) -> DataFrame:
    """``recognise`` with ``first`` and then TIERS, and in ``failed`` whether no page of the document could be read.

    A page that fails keeps its error beside the others; only a document without any page read has failed.
    """
    read = recognise(pages, engine, [first, *TIERS])
    all_failed = read.groupBy("path").agg(F.bool_and(F.col("error").isNotNull()).alias("failed"))
    return read.join(all_failed, "path")
