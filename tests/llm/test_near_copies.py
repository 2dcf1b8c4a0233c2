"""The near-copy stage of the pipeline: SimHash tables, parity maps, and what a bucket's pairs cost and find."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from pagelathe.llm import _text as T
from pagelathe.llm import near_copies, simhash
from pagelathe.llm.graph import components


def blocks(texts):
    (_, _, buf, off), *more = T.text_blocks(pa.array(texts))
    assert not more
    sets = near_copies._sets(*near_copies.shingles_of(buf, off))
    return sets, np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def edited(r, n, copies):
    words = [f"w{r.randrange(9000)}" for _ in range(n)]
    return [" ".join(w if k != at else f"x{r.randrange(9000)}" for k, w in enumerate(words)) for at in r.sample(range(n), copies)]


def test_covering_keys_meet_within_the_radius():
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for i in r.sample(range(64), r.randint(0, 2)):
            b ^= 1 << i
        keys = simhash.covering_keys(np.array([a, b], np.uint64))
        assert keys.shape == (2, 7) and (keys[0] == keys[1]).any()
    assert not (simhash.covering_keys(np.array([5], np.uint64)) == simhash.covering_keys(~np.array([5], np.uint64))).any()


def test_parity_maps_are_no_further_apart_than_sets():
    r = random.Random(2)
    texts = [t for n in (5, 40, 400) for t in edited(r, n, 5)] + ["one", "one two", "", " "]
    sets, h, first = blocks(texts)
    maps = near_copies.parity_maps(h, first)
    full = [s for s in sets if len(s)]
    assert len(maps) == len(full)
    for a, x in zip(full, maps, strict=True):
        for b, y in zip(full, maps, strict=True):
            apart = sum(int(v).bit_count() for v in x ^ y)
            assert apart <= len(np.setxor1d(a, b)) and (apart - len(np.setxor1d(a, b))) % 2 == 0


def test_simhash_tables_propose_links(spark, monkeypatch):
    """Without a MinHash band all near pairs within two bits are still joined."""
    r = random.Random(3)
    texts = [t for _ in range(12) for t in edited(r, 400, 4)]
    sets, h, first = blocks(texts)
    fps = [int(x) for x in simhash.majority(h, first)]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2 and 10 * len(np.intersect1d(sets[i], sets[j])) >= 8 * len(np.union1d(sets[i], sets[j]))}
    assert near
    monkeypatch.setattr(near_copies, "band_keys", lambda h, first: np.arange(40 * (len(first) - 1), dtype=np.uint64).reshape(-1, 40))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kept = {x.doc_id for x in near_copies.one_of_each(docs).collect()}
    assert not {max(p) for p in near} & kept and len(kept) < len(texts)


def test_a_large_group_costs_few_pairs_a_member(spark, monkeypatch):
    n, made, near = 300, [], near_copies._near

    def counted(pairs, sets):
        made.append(pairs.count())
        return near(pairs, sets)

    monkeypatch.setattr(near_copies, "_near", counted)
    docs = spark.createDataFrame(list(enumerate(edited(random.Random(4), 400, n))), "doc_id long, text string").repartition(3)
    assert [x.doc_id for x in near_copies.one_of_each(docs).collect()] == [0]
    assert sum(made) <= 24 * n, made


@pytest.mark.parametrize("few", [0, 10**9])
@pytest.mark.parametrize("split", [200, 7])
def test_no_pair_of_a_crowded_bucket_is_lost(spark, monkeypatch, few, split):
    """One bucket of pairs that are near, and of nothing else that is."""
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "SPLIT", split)
    r = random.Random(5)
    texts = [t for _ in range(40) for t in edited(r, 120, 2)]
    sets, h, first = blocks(texts)
    bits = near_copies.parity_maps(h, first).view(np.int64).tolist()
    members = spark.createDataFrame([(7, i, len(s), b) for i, (s, b) in enumerate(zip(sets, bits, strict=True))], "key long, node long, size long, bits array<long>")
    held = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "node long, shingles array<long>")
    near = {(i, i + 1) for i in range(0, 80, 2) if 10 * len(np.intersect1d(sets[i], sets[i + 1])) >= 8 * len(np.union1d(sets[i], sets[i + 1]))}
    assert len(near) > 10
    found = near_copies.search(members, held, spark.createDataFrame([], "a long, b long"))
    assert {(x.component, x.node) for x in components(found).collect() if x.component != x.node} == near


def test_components_of_one_task(spark):
    r = random.Random(6)
    chain = [(i, i + 1) for i in range(-50, 50)]
    r.shuffle(chain)
    some = [(r.randrange(-(1 << 63), 1 << 63), r.randrange(1000, 1400)) for _ in range(300)] + [(r.randrange(2000, 2500), r.randrange(2000, 2500)) for _ in range(300)]
    for pairs in (chain, [(max(p), min(p)) for p in chain], some, chain + some, [(7, 7)], []):
        edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
        want = {(x.node, x.component) for x in components(edges).collect()}
        assert {(x.node, x.component) for x in components(edges, at_once=1000).collect()} == want
        assert {(x.node, x.component) for x in components(edges, at_once=10).collect()} == want


def moved(spark):
    """Bytes that the session's stages have shuffled so far."""
    made, to_list = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList
    stages = made.stageList(to_list(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), to_list())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("few", [100_000, 0])
def test_texts_and_keys_move_little(spark, monkeypatch, few):
    """Also when nothing counts as few enough to broadcast."""
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", few)
    r = random.Random(7)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(250)) for _ in range(2000)]
    size = sum(map(len, texts))
    docs = spark.createDataFrame(list(enumerate(texts + [t + " end" for t in texts[:20]])), "doc_id long, text string").repartition(4)
    docs.cache().count()
    before = moved(spark)
    assert {x.doc_id for x in near_copies.one_of_each(docs).select("doc_id").collect()} == set(range(2000))
    made = (moved(spark) - before) / size
    docs.unpersist()
    assert made < 0.7, made
