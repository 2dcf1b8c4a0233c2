"""Words, lines and pieces that a polynomial hash cannot tell apart, and very long texts."""

from __future__ import annotations

import random
import time

import numpy as np
import xxhash

from pagelathe.llm import _text as T
from pagelathe.llm import _packed, _tokens, langid, packing, pii, quality, queries, simhash, substring_dedup, token_counts, url_filter


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def thue_morse(n=2048):
    s = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return s, s.translate(str.maketrans("ab", "ba"))


def test_xxh64_equals_the_library():
    r = random.Random(1)
    parts = [r.randbytes(r.choice([0, 1, 3, 4, 7, 8, 9, 15, 16, 31, 32, 33, 63, 64, 65, 255, 256, 257, 400])) for _ in range(800)]
    off = np.cumsum([0, *map(len, parts)])
    got = T.xxh64_spans(np.frombuffer(b"".join(parts), np.uint8), off[:-1], off[1:], 42)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def test_equal_spans_alone_have_equal_keys():
    r = random.Random(2)
    parts = ["".join(r.choice("ab") for _ in range(r.randint(0, 20))).encode() for _ in range(3000)] + [b"a\0", b"a", b"a\0\0"]
    off = np.cumsum([0, *map(len, parts)])
    k = T.span_keys(np.frombuffer(b"".join(parts), np.uint8), off[:-1], off[1:])
    seen = {}
    assert all(seen.setdefault(key, p) == p for key, p in zip(zip(*(x.tolist() for x in k), strict=True), parts, strict=True))
    assert len(seen) == len(set(parts))


def test_tokens_of_the_pair():
    enc = _tokens.Encoder(_tokens.vocabulary_path())
    for t in thue_morse():
        ids, _ = enc(*block([t]))
        assert ids.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_windows_of_words_of_the_pair(spark):
    a, b = thue_morse()
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([a, *words[:49]])), (2, " ".join([b, *words[:49]])), (3, " ".join([a, *words[:49]])), (4, " ".join("ab"[i.bit_count() & 1] for i in range(64))), (5, " ".join("ba"[i.bit_count() & 1] for i in range(64)))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 50, 4: 0, 5: 0}


def test_lines_of_the_pair():
    a, b = thue_morse()
    stats = dict(zip(quality.STATS, quality.stats_of(*block([f"{a}\n{b}\n{a}", " ".join([a, *"pqrs", b, *"pqrs"])])), strict=True))
    assert stats["n_dup_lines"].tolist() == [1, 0] and stats["n_repeat_words"].tolist() == [0, 0]


def test_texts_of_many_blocks(spark):
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdefghé") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    long = "\n".join(" ".join(r.choice(vocab) for _ in range(12)) for _ in range(70_000))
    assert len(long.encode()) > 4 << 20
    docs = spark.createDataFrame([(1, long), (2, long[1_000_000:1_500_000]), (3, "x" * 300_000), (4, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in substring_dedup.substring_dedup(docs, with_text=False).collect()}
    assert got[1].n_words == 840_000 and got[1].n_removed == 0 and got[2].n_removed >= got[2].n_words - 2 and got[4].n_words == 0
    assert {x.doc_id: x.n_words for x in quality.text_stats(docs).collect()} == {1: 840_000, 2: got[2].n_words, 3: 1, 4: 0}
    assert simhash.near_duplicates(docs).count() == 4
    counts = token_counts.token_counts(docs).groupBy("doc_id").sum("n_tokens", "section").collect()
    tok = _tokens.encoder(_tokens.vocabulary_path()).tokenizer
    want = {1: long, 2: long[1_000_000:1_500_000], 3: "x" * 300_000, 4: ""}
    assert {c[0]: c[1] for c in counts} == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in want.items()}


def test_blocks_of_one_empty_text(spark):
    docs = spark.createDataFrame([(1, "")], "doc_id long, text string").repartition(1)
    assert [tuple(r)[:3] for r in substring_dedup.substring_dedup(docs).collect()] == [(1, 0, 0)]
    assert quality.text_stats(docs).first().n_words == 0 and simhash.near_duplicates(docs).first().component_id == 1
    assert token_counts.token_counts(docs).first().n_tokens == 0 and packing.pack(docs).first().length == 1
    model = langid.fit(spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string"))
    assert langid.predict(docs, model).first().lang_pred == "und"


def test_keys_of_partitions(spark):
    keys = _packed.keys_of(37)
    rows = spark.createDataFrame([(int(k),) for k in keys], "k int").selectExpr("pmod(hash(k), 37) AS p").collect()
    assert [r.p for r in rows] == list(range(37))


def test_small_cells(spark, monkeypatch):
    """Many cells a partition give what one gives; so does a union that lays no partitions together."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, substring_dedup.substring_dedup(docs, with_text=False).collect()))
    monkeypatch.setattr(_packed, "CELL_BYTES", 20_000)
    monkeypatch.setattr(_packed, "PART_BYTES", 90_000)
    assert sorted(map(tuple, substring_dedup.substring_dedup(docs, with_text=False).collect())) == want
    monkeypatch.setattr(_packed, "df_conf", lambda *_: "false")
    assert sorted(map(tuple, substring_dedup.substring_dedup(docs, with_text=False).collect())) == want
    assert sum(r[2] for r in want) > 0


def test_long_texts_of_native_operators(spark):
    """Runs that a careless pattern searches again from every sign, in seconds."""
    texts = ["a-" * 500_000 + "1", "x@" + "a-" * 300_000, "1 " * 30_000, "12 34 " * 10_000 + "4111 1111 1111 1111 " + "5 " * 9_000, "token=" * 50_000 + "abcdefgh1", "a.b_" * 200_000 + "@x.com", "+1 " * 50_000, "DE89 " * 40_000]
    t = time.time()
    got = pii.pseudonymize(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string"), "k").collect()
    assert time.time() - t < 60
    out = {r.i: r.text for r in got}
    assert [out[i] == texts[i] for i in (0, 1, 2)] == [True] * 3 and "4111 1111 1111 1111" not in out[3] and len(out[3]) == len(texts[3])
    assert out[4] != texts[4] and out[5].endswith(".com") and not out[5].endswith("@x.com")
    t = time.time()
    pages = spark.createDataFrame([(0, "http://" + "a." * 50_000 + "example.com/en/x"), (1, "http://" + "." * 50_000), (2, "http://x.net/es/" + "y" * 1_000_000)], "page_id long, url string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    assert {r.page_id: r.rule for r in url_filter.filter_urls(pages, rules).collect()} == {0: "example.com/en/", 1: None, 2: "net/es/"}
    assert time.time() - t < 30
