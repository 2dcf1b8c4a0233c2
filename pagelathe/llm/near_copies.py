"""Near copies by word shingles: SimHash with covering LSH, then MinHash bands, propose pairs; exact Jaccard similarity decides.

Documents with one set of shingles are one node. The tables of ``simhash`` put nodes in buckets
by the SimHash of their set, so that no pair within two bits is missed. A pair of similarity 0.8 is 9.7 bits apart on
average; for those beyond two bits 40 bands of 6 MinHash values follow, of which a pair of similarity 0.8 shares
none with a chance of (1 - 0.8^6)^40 = 5e-6, a closer pair with less.

All keys move twice: as one list a node, where equal sets become one node, and with their node (16 bytes),
where shared buckets are found. Sizes, parity maps and sets follow for members of shared buckets only.

In each bucket all members meet the smallest of them, and near ones become one component. A bucket whose members are
one component needs no more pairs, so a group of near copies costs a few
pairs a member, however large it is. Once the pairs between components are few, or after ROUNDS more
rounds in which another member is met, all that are left are compared: each pair of a bucket has been compared or is in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.llm import _text as T
from pagelathe.llm import simhash
from pagelathe.llm.graph import by_count, checkpointed, components, quoted, settled
from pagelathe.shipping import in_arrow

SHINGLE, BANDS, ROWS = 5, 40, 6
#: The similarity is 8/10; whole numbers decide.
NEAR, OF = 8, 10
#: Up to so many rows (of 16 to some 120 bytes) are broadcast to what looks them up; beyond, both move.
BROADCAST_ROWS = 100_000
#: Up to so many links (16 bytes each) are joined to components in one task.
LINKS_AT_ONCE = 1_000_000
#: Pairs between components are compared at once when they are at most so many a member, or after so many rounds.
FEW, ROUNDS = 8, 1
#: A set or bucket that more pairs or members need is sent to one more task for each so many.
SPLIT = 200
#: Words of a set's parity map: each shingle flips one of 64 * WORDS bits.
WORDS = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(buf: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text of a block, with repeats, and each text's first (one more than texts)."""
    buf = _LOWER[buf]
    starts, ends, first = T.words_of(buf, off)
    n = np.diff(first)
    m = np.where(n == 0, 0, np.maximum(n - shingle + 1, 1))
    at = T.ranges(first[:-1], m)
    size = np.repeat(np.minimum(shingle, n), m)
    words, out = T.hash_spans(buf, starts, ends), np.empty(len(at), np.uint64)
    for k in range(1, shingle + 1):
        out[size == k] = T.hash_windows(words, at[size == k], k)
    return out, np.concatenate(([0], np.cumsum(m)))


def _sets(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ``counts`` numbers each, as signed ones."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values.ravel().view(np.int64)))


def band_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key for each band of each text that has a shingle."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(at), band, np.uint64)
        for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
            key = T.mix(key ^ np.minimum.reduceat(h * f, at)) if len(at) else key
        out[:, band] = key
    return out


def parity_maps(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """WORDS words for each text that has a shingle; two sets' maps differ in no more bits than the sets in shingles."""
    at = first[:-1][np.diff(first) > 0]
    out = np.empty((len(at), WORDS), np.uint64)
    word, bit = h >> np.uint64(32) & np.uint64(WORDS - 1), np.uint64(1) << (h >> np.uint64(58))
    for w in range(WORDS if len(at) else 0):
        out[:, w] = np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), at)
    return out


def _bag_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, buf, off in T.text_blocks(batch.column(2)):
            sets = _sets(*shingles_of(buf, off))
            sizes = np.array([len(s) for s in sets], np.int64)
            h, first = np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))
            # a set's every shingle counts once, so that a repeated one does not make unlike texts one fingerprint
            tables = simhash.covering_keys(simhash.majority(h, first)[sizes > 0])
            keys = np.concatenate((tables, band_keys(h, first)), axis=1)
            cols = [*(batch.column(k).slice(i, j - i) for k in (0, 1)), pa.array(_nodes(sets)), _lists(keys, (sizes > 0) * keys.shape[1])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "mark", "node", "keys"])


def _node_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, buf, off in T.text_blocks(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(_sets(*shingles_of(buf, off)))), batch.column(0).slice(i, j - i)], names=["node", "text"])


def _set_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for i, j, buf, off in T.text_blocks(batch.column(1)):
            sets = _sets(*shingles_of(buf, off))
            sizes = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate(sets)
            bits = _lists(parity_maps(h, np.concatenate(([0], np.cumsum(sizes)))), (sizes > 0) * WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(h, sizes), pa.array(sizes), bits], names=["node", "shingles", "size", "bits"])


def _may_be_near(size_a: str, bits_a: str, size_b: str, bits_b: str) -> Column:
    """False where sizes or parity maps rule out that sets are similar enough: they differ in at most (OF - NEAR) / (OF + NEAR) of their sizes' sum."""
    apart = sum((F.bit_count(F.col(bits_a)[i].bitwiseXOR(F.col(bits_b)[i])) for i in range(WORDS)), F.lit(0))
    fits = OF * F.least(size_a, size_b) >= NEAR * F.greatest(size_a, size_b)
    return fits & ((OF + NEAR) * apart <= (OF - NEAR) * (F.col(size_a) + F.col(size_b)))


def _few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def _looked_up(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with checkpointed ``facts`` (key, n, ...), one a key: few of them meet the rows where those are."""
    return rows.join(F.broadcast(facts), key) if _few(facts) else by_count(rows, facts, key)


def _parts(n: str = "n") -> Column:
    return F.floor(F.col(n) / SPLIT).cast("int") + 1


def _with_sets(pairs: DataFrame, sets: DataFrame, end: str) -> DataFrame:
    """``pairs`` with the set of their ``end``; the pairs of one node are dealt to as many tasks as they fill."""
    counts = checkpointed(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")))
    dealt = _looked_up(pairs, counts, end).withColumn("part", F.pmod(F.xxhash64("a", "b"), _parts()).cast("int")).drop("n")
    copies = sets.toDF(end, f"of_{end}").join(F.broadcast(counts) if _few(counts) else counts, end).withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).drop("n")
    return dealt.join(copies, [end, "part"]).drop("part")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose sets' Jaccard similarity is high enough."""
    both = _with_sets(_with_sets(pairs, sets, "a"), sets, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(OF * common >= NEAR * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def _left(open_: DataFrame) -> DataFrame:
    """(a, b): all pairs of a bucket that are of two components and of sizes that fit.

    What is outside a bucket's largest component meets all, so no more than twice the pairs are looked at.
    """
    others = open_.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).where("component <> top.component")
    others = others.select("key", "part", F.col("node").alias("o"), F.col("size").alias("size_o"), F.col("bits").alias("bits_o"), F.col("component").alias("of_o"))
    all_ = open_.withColumn("part", F.pmod(F.xxhash64("node"), _parts()).cast("int"))
    met = others.join(all_, ["key", "part"]).where("of_o <> component").where(_may_be_near("size_o", "bits_o", "size", "bits"))
    return met.select(F.least("o", "node").alias("a"), F.greatest("o", "node").alias("b")).distinct()


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with their component over ``found``."""
    part = components(found, at_once=LINKS_AT_ONCE)
    return members.join(F.broadcast(part) if _few(part) else part, "node", "left").withColumn("component", F.coalesce("component", "node"))


def search(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` and more near pairs (a, b), which join what all near pairs within the buckets of ``members`` (key, node, size, bits) join."""
    for turn in range(ROUNDS + 1):
        placed = _placed(members, found)
        tally = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        facts = tally.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.max(F.struct("n", "component")).alias("top"))
        facts = checkpointed(facts.where("n > top.n"))
        pairs, rows = facts.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("same")) / 2), F.sum("n")).first()
        if not rows:
            return found
        open_ = settled(_looked_up(placed, facts.drop("same"), "key"))
        if pairs <= FEW * rows or turn == ROUNDS:
            return settled(found.unionByName(_near(checkpointed(_left(open_)), sets)))
        # the order is of all buckets alike, so that the buckets of one group have few heads between them
        order = F.struct(F.xxhash64("node", F.lit(turn)).alias("r"), "node", "size", "bits", F.col("component").alias("of"))
        heads = checkpointed(open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("head")))
        led = _looked_up(open_.drop("n", "top"), heads, "key")
        met = led.where("component <> head.of").where(_may_be_near("size", "bits", "head.size", "head.bits"))
        met = met.select(F.least("head.node", "node").alias("a"), F.greatest("head.node", "node").alias("b")).distinct()
        found = settled(found.unionByName(_near(checkpointed(met), sets)))
        members = led.where("node <> head.node").select("key", "node", "size", "bits")
    return found


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): verified links between near nodes of ``nodes`` (node, keys), which join what all near pairs that share a bucket join."""
    bucket = Window.partitionBy("key")
    # dealt as keys and nodes; nodes are hashes, so the smallest is any, and buckets of one group have few heads between them
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition("key")
    keyed = keyed.select("key", "node", F.count(F.lit(1)).over(bucket).alias("n"), F.min("node").over(bucket).alias("head"))
    keyed = checkpointed(keyed.where("n > 1").drop("n"))
    wanted = checkpointed(keyed.select("node").distinct())
    texts = in_arrow(docs.select(F.col("text").cast("string")), _node_rows, "node long, text string")
    few = _few(wanted)
    texts = texts.join(F.broadcast(wanted) if few else wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    facts = checkpointed(in_arrow(texts, _set_rows, "node long, shingles array<long>, size long, bits array<long>"))
    sets, facts = facts.select("node", "shingles"), facts.select("node", "size", "bits")
    known = F.broadcast(facts) if few else facts
    met = keyed.where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    met = met.join(known.toDF("a", "size_a", "bits_a"), "a").join(known.toDF("b", "size_b", "bits_b"), "b")
    found = settled(_near(checkpointed(met.where(_may_be_near("size_a", "bits_a", "size_b", "bits_b")).select("a", "b")), sets))
    return search(keyed.select("key", "node").join(known, "node"), sets, found)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...), one of each group of near copies: the one with the smallest id.

    A group is what links of Jaccard similarity 0.8 or more join, on the sets of five-word shingles
    (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; fewer words: the whole sequence; none, or null
    text: the empty set, which equals itself only). Rows without an id come after all ids; of rows with one id and
    text one stays, of texts with one id the first by hash. Kept rows are unchanged.
    """
    names = docs.columns
    mark = next(n for n in (f"mark{i}" for i in range(len(names) + 1)) if n not in names)
    docs = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col(mark).alias("mark"), F.col("text").cast("string"))
    bags = checkpointed(in_arrow(rows, _bag_rows, "doc_id long, mark long, node long, keys array<long>"))
    # the few nodes that links touch name their component; every other node is its own
    named = _placed(bags.select("doc_id", "mark", "node"), links(docs, bags.groupBy("node").agg(F.first("keys").alias("keys"))))
    named = checkpointed(named.groupBy("component", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("mark").alias("first"))).alias("m"), F.count(F.lit(1)).alias("rows"))
    # groups of one row need no join: what goes, and what repeats, is all that is looked up
    crowded = _looked_up(named.drop("n"), checkpointed(first.where("rows > 1").select("component", F.col("rows").alias("n"), "m")), "component")
    gone = crowded.where(~(F.col("doc_id").eqNullSafe(F.col("m.id")) & (F.col("mark") == F.col("m.first")))).select("doc_id", "mark")
    again = named.where("n > 1").select("doc_id", "mark")
    out = _without(docs, mark, gone)
    again = checkpointed(again)
    if again.isEmpty():
        return out.select(*(F.col(quoted(n)) for n in names))
    ids = again.toDF("id", "m")
    repeated = out.join(ids, ids["id"].eqNullSafe(out["doc_id"].cast("long")) & (ids["m"] == out[mark]), "left_semi").dropDuplicates(["doc_id", mark])
    return _without(out, mark, again).unionByName(repeated).select(*(F.col(quoted(n)) for n in names))


def _without(docs: DataFrame, mark: str, gone: DataFrame) -> DataFrame:
    gone = checkpointed(gone.select(F.col("doc_id").alias("id"), F.col("mark").alias("m")).distinct())
    same = gone["id"].eqNullSafe(docs["doc_id"].cast("long")) & (gone["m"] == docs[mark])
    return docs.join(F.broadcast(gone) if _few(gone) else gone, same, "left_anti")
