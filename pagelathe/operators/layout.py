"""Page text from placed spans: lines by height, two columns where most lines part at the middle.

A page's spans (page_width, x0, y0, x1, y1, text) are few; they meet in one row of the page's own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelathe.shipping import in_pandas

Span = tuple[float, float, float, float, str]


def lines_of(spans: list[Span], tolerance: float = 3.0) -> list[list[Span]]:
    """Spans whose top is within ``tolerance`` of the line's first, each line from left to right."""
    lines: list[list[Span]] = []
    for s in sorted(spans, key=lambda s: (s[1], s[0])):
        if lines and abs(s[1] - lines[-1][0][1]) <= tolerance:
            lines[-1].append(s)
        else:
            lines.append([s])
    return [sorted(x, key=lambda s: s[0]) for x in lines]


def is_two_column(lines: list[list[Span]], width: float, gap: float = 30.0, share: float = 0.5) -> bool:
    def parted(line: list[Span]) -> bool:
        best, at = max(((b[0] - a[2], (a[2] + b[0]) / 2) for a, b in zip(line, line[1:], strict=False)), key=lambda g: g[0], default=(0.0, 0.0))
        return best >= gap and abs(at - width / 2) < width * 0.2

    return bool(lines) and sum(map(parted, lines)) >= share * len(lines)


def render(spans: list[Span], width: float) -> str:
    lines = lines_of([s for s in spans if s[4] and s[4].strip()])
    if not is_two_column(lines, width):
        return "\n".join(" ".join(s[4] for s in x) for x in lines)
    sides = [[" ".join(s[4] for s in x if ((s[0] + s[2]) / 2 < width / 2) == left) for x in lines] for left in (True, False)]
    return "\n\n".join(t for t in ("\n".join(x for x in side if x) for side in sides) if t)


def _by_page(spans: DataFrame, rows, columns: str) -> DataFrame:  # noqa: ANN001
    """``rows`` of (spans, width) of each page, after its doc and page."""
    row = F.struct("x0", "y0", "x1", "y1", "text")
    pages = spans.groupBy("doc", "page").agg(F.max("page_width").alias("width"), F.sort_array(F.collect_list(row)).alias("spans"))
    names = ["doc", "page", *(c.split()[0] for c in columns.split(", "))]

    def batch(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            out = []
            for doc, page, width, items in zip(f["doc"], f["page"], f["width"], f["spans"], strict=True):
                found = [tuple(s.values()) if isinstance(s, dict) else tuple(s) for s in items]
                out += [(doc, page, *r) for r in rows(found, width)]
            yield pd.DataFrame(out, columns=names)

    keys = ", ".join(f"{c} {spans.schema[c].dataType.simpleString()}" for c in ("doc", "page"))
    return in_pandas(pages, batch, f"{keys}, {columns}")


def page_texts(spans: DataFrame) -> DataFrame:
    """(doc, page, text) of spans (doc, page, page_width, x0, y0, x1, y1, text); blank spans are passed by."""
    return _by_page(spans, lambda found, width: [(render(found, width),)], "text string")


def line_numbers(spans: DataFrame) -> DataFrame:
    """(doc, page, line, place, text): each span's line on its page and place in the line, from 1."""
    return _by_page(spans, lambda found, _: [(i, k, s[4]) for i, x in enumerate(lines_of(found), 1) for k, s in enumerate(x, 1)], "line int, place int, text string")


def column_counts(spans: DataFrame) -> DataFrame:
    """(doc, page, two): whether most of a page's lines part at its middle."""
    return _by_page(spans, lambda found, width: [(is_two_column(lines_of(found), width),)], "two boolean")
