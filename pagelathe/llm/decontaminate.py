"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document if at least ``threshold`` of its distinct word shingles occur there. Items
are partitioned by size. The MinHash sketch of an item is the s smallest hashes of its shingles, with s from the
upper size u of its partition: s = floor((1 - threshold) u) + 1. A document that contains the item misses at most
s - 1 of its shingles, so it has one of the sketch: no containment is missed, however long the document.
Documents' shingle hashes meet the sketches in one equi-join, and candidates are verified by exact containment of
the shingles themselves.

What MinHash does here is to choose, in the order of the hashes, which shingles of an item are asked for. Documents have no
signatures of their own: a signature of a whole document of 20,000 shingles agrees with an item of 30 in one value in
700, and signatures of all item-sized windows of all documents would be most of the work and still miss some. Items of fewer
words than a shingle are partitions of their own, by length: their whole sequence is looked for among the
documents' windows of that many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.graph import checkpointed

SHINGLE, THRESHOLD = 5, 0.8
#: Sides of up to so many rows (24 bytes each) are broadcast; beyond, joins shuffle.
BROADCAST_ROWS = 100_000
#: Items of up to so many characters together are broadcast.
BROADCAST_CHARS = 4_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _windows(w: Column, ks: list[int], one) -> Column:
    """``one`` of each window of k words, for each k; nothing where there are fewer words."""

    def long(ws: Column, k: int) -> Column:
        return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: one([F.get(ws, i + j) for j in range(k)])))

    def of(ws: Column) -> Column:
        each = [long(ws, k) for k in ks]
        none = F.slice(F.array(one([F.lit("")] * ks[0])), 1, 0)
        return F.concat(*[F.coalesce(x, none) for x in each])

    # the words are a lambda's argument: wherever the optimizer moves this, they are split once a row
    return F.get(F.transform(F.array(w), of), F.lit(0))


def _of_item(w: Column, k: int, make) -> Column:
    """``make`` of an item's windows: of k words, or of as many as it has."""
    out = F.when(F.size(w) >= k, make(w, [k]))
    for n in range(1, k):
        out = out.when(F.size(w) == n, make(w, [n]))
    return out.otherwise(F.slice(make(w, [k]), 1, 0))


def shingle_hashes(w: Column, ks: list[int]) -> Column:
    return _windows(w, ks, lambda parts: F.xxhash64(*parts))


def shingles(w: Column, ks: list[int]) -> Column:
    """Distinct shingles as text."""
    return F.array_distinct(_windows(w, ks, lambda parts: F.concat_ws(" ", *parts)))


def _small(df: DataFrame, rows: int) -> tuple[DataFrame, bool]:
    return df, df.limit(rows + 1).count() <= rows


def _sketches(items: DataFrame, threshold: float) -> DataFrame:
    size = F.size("hashes")
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)))) + 1) - 1
    s = F.floor((1 - threshold) * top + 1e-9).cast("int") + 1
    sketch = F.slice(F.sort_array("hashes"), F.lit(1), F.least(s, size))
    # a document of fewer shingles than the item needs cannot contain it
    need = F.ceil(threshold * size - 1e-9).cast("int")
    return items.select("item_id", need.alias("need"), F.explode_outer(sketch).alias("h")).where("h is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each distinct document row and item that it contains.

    doc_id, text_hash (XXH64 of the text: with doc_id it names the row), item_id, n_item (distinct
    shingles), n_found, containment. Words are lower-cased runs of letters and digits; a text of fewer
    words than a shingle has none, an item of fewer is its whole sequence. Null, empty and wordless texts and items match nothing. Items
    that share an id are items of their own by text. Null ids are kept. Whole documents are searched.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("item_text")).where("item_text is not null").distinct()
    items = items.withColumn("key", F.xxhash64(F.coalesce(F.col("item_id"), F.lit(-1)), "item_text"))
    bags = items.select("item_id", "key", words(F.col("item_text")).alias("w"))
    short = bags.where(F.size("w").between(1, shingle - 1)).select(F.size("w").alias("n")).distinct()
    ks = [shingle, *sorted(r["n"] for r in short.collect())]  # at most as many as a shingle has words
    bags = bags.select("item_id", "key", _of_item(F.col("w"), shingle, shingles).alias("shingles"), F.array_distinct(_of_item(F.col("w"), shingle, shingle_hashes)).alias("hashes"))
    sketch = _sketches(bags.select(F.col("key").alias("item_id"), "hashes"), threshold).withColumnRenamed("item_id", "key")
    sketch, small = _small(sketch, BROADCAST_ROWS)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    found = rows.select("doc_id", "text_hash", shingle_hashes(words(F.col("text")), ks).alias("hs"))
    # explode() would infer a filter on its array and have all shingles made twice
    found = found.select("doc_id", "text_hash", F.size("hs").alias("n_doc"), F.explode_outer("hs").alias("h"))
    if small:
        found = found.join(F.broadcast(sketch), "h")
    else:
        # one row for each hash of a document, so a document that repeats a shingle is no hot key of its own
        found = found.distinct().join(sketch, "h")
    candidates = found.where("n_doc >= need").select("doc_id", "text_hash", "key").distinct()
    # ids of suspected documents only; written once, as their number decides how they are joined
    candidates, few = _small(checkpointed(candidates), BROADCAST_ROWS)
    total = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    bag = bags.select("item_id", "key", "shingles")
    # texts join the few ids, not the items' shingles, when they move
    side = F.broadcast(candidates) if few else candidates
    same = (F.col("c.text_hash") == F.col("d.text_hash")) & F.col("c.doc_id").eqNullSafe(F.col("d.doc_id"))
    held = rows.dropDuplicates(["doc_id", "text_hash"]) if not few else rows
    pairs = held.alias("d").join(side.alias("c"), same).select("d.doc_id", "d.text_hash", "c.key", words(F.col("d.text")).alias("w"))
    pairs = pairs.join(F.broadcast(bag) if total <= BROADCAST_CHARS else bag, "key")
    common = F.size(F.array_intersect("shingles", shingles(F.col("w"), ks)))
    pairs = pairs.select("doc_id", "text_hash", "item_id", F.size("shingles").cast("long").alias("n_item"), common.cast("long").alias("n_found"))
    pairs = pairs.where(F.col("n_found") >= F.ceil(F.lit(threshold) * F.col("n_item") - 1e-9)).distinct()
    return pairs.withColumn("containment", F.col("n_found") / F.col("n_item"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no item, unchanged."""
    bad = contaminated(docs, benchmark, shingle, threshold).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad, few = _small(checkpointed(bad), BROADCAST_ROWS)
    same = (F.xxhash64(F.col("text").cast("string")) == F.col("__hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")

