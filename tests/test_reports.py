"""Names, cached results and lines of reports on small fixtures."""

from __future__ import annotations

import random

from pagelathe.operators import reports as P


def test_unique_names_match_one_by_one(spark):
    rng = random.Random(3)
    taken = {"a.pdf", "a (2).pdf", "a (3).pdf", "b (1)", "d.x/c", "z (0).pdf"}
    wanted = [(i, rng.choice(["a.pdf", "b", "d.x/c", "e.tar.gz"])) for i in range(30)]
    have, want = set(taken), {}
    for i, p in wanted:
        head, dot, end = p.rpartition(".")
        root, end = (head, dot + end) if dot and "/" not in end else (p, "")
        want[i] = next(n for k in range(99) if (n := p if k == 0 else f"{root} ({k}){end}") not in have)
        have.add(want[i])
    got = P.unique_names(spark.createDataFrame(wanted, "id int, path string"), spark.createDataFrame([(t,) for t in taken], "path string"))
    assert {r["id"]: r["name"] for r in got.collect()} == want


def test_cache_store(spark):
    cols = "bucket string, key string, size long, mtime int"
    old = spark.createDataFrame([("b", "x", 5, 1), ("b", "y", 5, 2), ("b", "z", 5, 3)], cols)
    kept = P.cache_store(old, spark.createDataFrame([("b", "x", 6, 4)], cols), 11)
    assert {(r["key"], r["size"]) for r in kept.collect()} == {("x", 6), ("z", 5)}


def test_pairs_and_patterns(spark):
    files = spark.createDataFrame([("a", 1), ("b", 2)], "stem string, n int")
    both, alone = P.paired(files, spark.createDataFrame([("a", "t")], "stem string, truth string"))
    assert [r["n"] for r in both.collect()] == [1] and [r["n"] for r in alone.collect()] == [2]
    c = spark.createDataFrame([("f", "a", "b"), ("f", "a", "b"), ("g", "a", "b")], "field string, original string, corrected string")
    assert tuple(P.common_corrections(c, 1).collect()[0]) == ("f", "a", "b", 2)
