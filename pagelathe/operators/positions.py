"""Tables that belong together by place: pages and images, words and sizes, requests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_images(pages: DataFrame, images: DataFrame) -> DataFrame:
    """Pages (doc, page, ...) with their image (doc, page, image), null where there is none.

    By number, not by place in a list, so a page that failed shifts no other.
    """
    return pages.join(images.select("doc", "page", "image"), ["doc", "page"], "left")


def aligned(words: DataFrame, sizes: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (doc, page, page_width, page_height) with their image's size and number of words; all three must have each page.

    A page that one of them lacks is an error, which names it.
    """
    counted = words.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n_words"))
    both = pages.join(sizes.select("doc", "page", "image_width", "image_height"), ["doc", "page"], "full").join(counted, ["doc", "page"], "full")
    whole = F.col("page_width").isNotNull() & F.col("image_width").isNotNull() & F.col("n_words").isNotNull()
    fault = F.raise_error(F.concat(F.lit("page without a counterpart: "), F.col("doc").cast("string"), F.lit("/"), F.col("page").cast("string")))
    return both.withColumn("n_words", F.when(whole, F.col("n_words")).otherwise(fault.cast("bigint")))


def scales(pages: DataFrame) -> DataFrame:
    """``pages`` with how many of the page's units a pixel of the image has, each way."""
    return pages.withColumn("scale_x", F.col("page_width") / F.col("image_width")).withColumn("scale_y", F.col("page_height") / F.col("image_height"))


def page_boxes(boxes: DataFrame, scaled: DataFrame) -> DataFrame:
    """Boxes (doc, page, x0, y0, x1, y1) of pixels in the units of ``scaled`` (doc, page, scale_x, scale_y)."""
    out = boxes.join(scaled.select("doc", "page", "scale_x", "scale_y"), ["doc", "page"])
    return out.select(*boxes.columns[:2], *[(F.col(c) * F.col(f"scale_{c[0]}")).alias(c) for c in ("x0", "y0", "x1", "y1")], *[c for c in boxes.columns if c not in ("doc", "page", "x0", "y0", "x1", "y1")])


def in_order(results: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Results in the order of ``requests`` (key, pos), those of one request by place."""
    return requests.select(key, "pos").join(results, key).orderBy("pos", *[c for c in ("place",) if c in results.columns])


def points(pixels, dpi):  # noqa: ANN001, ANN201
    """Pixels at ``dpi`` in points, 72 to the inch."""
    return pixels * F.lit(72.0) / dpi
