"""What queries do not show: limits of time, faults, retries, paths that are taken."""

from __future__ import annotations

import datetime
import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagelathe.functions.repair import Rule
from pagelathe.operators import decisions as D
from pagelathe.operators import lookups as L
from pagelathe.operators import positions, snapshots
from pagelathe.operators import words as W
from pagelathe.plans import postprocess as P
from pagelathe.streaming import queue as S


def test_rules_within_a_time(spark):
    df = spark.createDataFrame([(1, "a" * 40 + "!"), (2, "aab"), (3, None)], "i int, text string")
    rules = (Rule("^(a+)+$", "slow"), Rule("a", "b"), Rule("(", "x"), Rule("B", "c", case_sensitive=False), Rule("+", "", is_regex=False))
    t = time.time()
    got = {r.i: r.text for r in df.withColumn("text", P.limited_rules(F.col("text"), rules, 0.3)).collect()}
    assert got == {1: "c" * 40 + "!", 2: "ccc", 3: None} and time.time() - t < 30
    assert set(P.broken_rules(list(rules))) == {"("}


def test_clean_up_order_and_settings(spark):
    text = "Гру-\nз  гpуз\n=====\ncafe\u0301 0тель 3aвод\n\n\n\nдата 1.2.24"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    out = {r.doc_id: r.text for r in P.universal(df).collect()}
    assert out[1] == "Груз груз\ncafé 0тель 3авод\n\nдата 01.02.2024" and out[2] == "" and out[3] is None
    off = P.Settings(*[False] * 4, garbage="disabled", look_alikes=False, russian=False, english=False)
    assert {r.text for r in P.process(df, off).collect()} == {text, "", None}
    strict = replace(off, garbage="strict")
    assert "=====" not in P.process(df, strict).where("doc_id = 1").first().text
    assert P.process(df, replace(off, garbage="?")).where("doc_id = 1").first().text == "\n".join(x for x in text.split("\n") if x != "=====")


def test_pages_without_a_counterpart(spark):
    pages = spark.createDataFrame([("d", 1, 10.0, 10.0), ("d", 2, 10.0, 10.0)], "doc string, page int, page_width double, page_height double")
    sizes = spark.createDataFrame([("d", 1, 20, 40), ("d", 2, 20, 40)], "doc string, page int, image_width int, image_height int")
    words = spark.createDataFrame([("d", 1), ("d", 1), ("d", 2)], "doc string, page int")
    got = {r.page: (r.n_words, r.scale_x, r.scale_y) for r in positions.scales(positions.aligned(words, sizes, pages)).collect()}
    assert got == {1: (2, 0.5, 0.25), 2: (1, 0.5, 0.25)}
    with pytest.raises(Exception, match="d/2"):
        positions.aligned(words, sizes.where("page = 1"), pages).collect()


def test_paths_that_are_taken(tmp_path):
    tried = []

    def write(path):
        tried.append(path)
        if len(tried) == 1:
            raise PermissionError(path)

    now = datetime.datetime(2024, 5, 6, 7, 8, 9)
    assert snapshots.write_safe(write, "/x/a.xlsx", now) == "/x/a_20240506_070809.xlsx" and tried[0] == "/x/a.xlsx"
    assert snapshots.write_safe(lambda p: None, "/x/a.b/c") == "/x/a.b/c"


def test_jobs_retry_and_stop(spark):
    jobs, told, failed = S.Jobs(spark, 1), [], []
    gate = threading.Event()

    def slow(_):
        gate.wait(20)
        return 1

    first = jobs.submit("slow", slow, on_complete=lambda n, x: told.append((n, x)))
    second = jobs.submit("waits", lambda s: 2)
    assert jobs.active() == 2 and jobs.cancel("waits") and second.cancelled() and not jobs.cancel("none")
    gate.set()
    assert first.result(20) == 1 and told == [("slow", 1)] and not jobs.cancel("slow")

    def bad(_):
        failed.append(1)
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        jobs.submit("bad", bad, on_error=lambda n, e: told.append((n, str(e)))).result(20)
    assert len(failed) == 2 and told[-1] == ("bad", "no") and jobs.active() == 0


def test_word_chain(spark):
    base = [(1, 0, 1, 0, 0, "xx", 10.0), (1, 0, 1, 0, 1, "груз", 50.0), (1, 0, 1, 0, 2, "wavbill", 60.0), (1, 1, 1, 0, 3, "a", 20.0), (1, 1, 1, 0, 4, "b", 30.0), (1, 1, 1, 0, 5, "c", 25.0), (2, 0, 1, 0, 0, "", -1.0)]
    words = spark.createDataFrame([(*r, 0, 0, 1, 1) for r in base], "page int, block int, par int, line int, word_num int, word string, conf double, left int, top int, width int, height int")
    scripts = spark.createDataFrame([(1, 0, "да", 70.0, "da", 20.0)], "page int, word_num int, rus string, rus_conf double, eng string, eng_conf double")
    sharp = spark.createDataFrame([(1, 1, "груза", 65.0), (1, 0, "no", 99.0)], "page int, word_num int, new string, new_conf double")
    blocks = spark.createDataFrame([(1, 1, 3, "new", 90.0), (1, 1, 4, "words", 80.0)], "page int, block int, word_num int, word string, conf double")
    entries = spark.createDataFrame([("waybill", 0)], "entry string, pos int")
    out = W.chain(words, scripts, sharp, None, blocks, entries)
    got = {(r.page, r.word_num): (r.word, r.conf) for r in out["words"].collect()}
    assert got[1, 0] == ("да", 80.0) and got[1, 1] == ("груза", 65.0) and got[1, 2] == ("waybill", 85.0)
    assert (got[1, 3], got[1, 4], got[1, 5]) == (("new", 90.0), ("words", 80.0), ("", -1.0))
    page = out["pages"].first()
    assert page.page == 1 and page.n_words == 5 and page.threshold == 60.0 and page.text == "да груза waybill\nnew words" and page.low is None
    assert W.chain(words)["pages"].first().low == "xx|груз|wavbill|a|b|c" and W.chain(words)["handwritten"].count() == 1


def test_evicted_entries_match_one_window(spark):
    rows = [("a" if i % 3 else "b", i, (i * 7) % 11, datetime.datetime(2024, 1, 1 + i % 5, i % 24) if i % 13 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "bucket string, key int, size int, mtime timestamp")
    for most in (0, 50, 150, 10_000):
        want = set()
        for b in "ab":
            upto = 0
            for _, key, size, _ in sorted((r for r in rows if r[0] == b), key=lambda r: (r[3] is None, -(r[3] or datetime.datetime.min).timestamp() if r[3] else 0, r[1])):
                upto += size
                want |= {key} if upto > most else set()
        assert {r.key for r in L.evict(df, most).collect()} == want


def test_small_decisions(spark):
    row = spark.range(1).select(D.page_workers(F.lit(0), F.lit(4), F.lit(None).cast("int")).alias("a"), D.config_lines(F.create_map(F.lit("1"), F.lit("x"))).alias("b"), D.crop_config(F.lit("--psm 3 -l rus")).alias("c"), D.narrowed_languages(F.array(F.lit("rus")), F.lit("eng")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (1, None, "-l rus --psm 6", ["rus"])
