"""All queries of the library's own operators, each with SQL to hold it against.

Text operators run over ``documents``, word-table operators over a word table read off
``lineitem``, registries over ``orders``, ``customer`` and ``events``; rules about Cyrillic
text, of which the tables have none, over inline rows that both engines read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import repair as R
from pagelathe.functions import text as T
from pagelathe.functions import validators as V
from pagelathe.operators import annotations as A
from pagelathe.operators import decisions as D
from pagelathe.operators import evaluation as E
from pagelathe.operators import lookups as L
from pagelathe.operators import reports as P
from pagelathe.operators import waybills as B
from pagelathe.operators import words as W
from pagelathe.sources import files
from pagelathe.streaming import queue as S

FLAGSHIP = "nrm06_normalize"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_found(sf_dir: str, name: str) -> str:
    """A table's path as a pattern: a stream then takes it whether it is one file or a folder of files."""
    return f"{sf_dir}/{name}.parque[t]"


def _on_text(name: str, f, sql: str, **more) -> None:
    """A function of ``documents.text``, as a column ``out``."""
    _add(name, lambda s, d: _table(s, d, "documents").select("doc_id", f(F.col("text")).alias("out")), f"SELECT doc_id, {sql} AS out FROM documents")


#: Strings that both engines make of a table's columns; keys are the tables' own.
_KEY = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "documents": "doc_id"}
_S = "CAST(o_orderkey AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_RU_DAY = f"(lpad(CAST(1 + o_orderkey % 31 AS STRING), 2, '0') || '.' || substr({_DAY}, 6, 2) || '.' || CAST(CAST(substr({_DAY}, 1, 4) AS INT) + 20 AS STRING))"
_CYRILLIC = "translate({}, 'abekmhopctyxABEKMHOPCTYX', 'авекмнорстухАВЕКМНОРСТУХ')"
_INN_TEXT = "(CASE o_orderkey % 3 WHEN 0 THEN CAST(7700000000 + o_orderkey * 7919 AS STRING) WHEN 1 THEN CAST(500100000000 + o_orderkey * 7919 AS STRING) ELSE CAST(o_orderkey AS STRING) END)"
#: A word of several scripts: Latin, Cyrillic, half of each, with digits, foreign letters and quotes.
_MIX = f"(CASE p_partkey % 7 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN {_CYRILLIC.format('p_name')} WHEN 2 THEN upper(split_part(p_name, ' ', 2)) WHEN 3 THEN {_CYRILLIC.format('upper(p_type)')} WHEN 4 THEN p_brand || CAST(p_size AS STRING) WHEN 5 THEN 'і' || p_name || 'ü' ELSE p_type || '»' || p_brand END)"


def _over(name: str, table: str, value: str, f, sql: str, spread: bool = False) -> None:
    """A function of a string ``v`` that both engines make of ``table``'s columns, as a column ``out``; ``spread`` deals rows that take long each to all cores."""
    key = _KEY[table]
    rows = lambda s, d: _table(s, d, table).repartition(s.sparkContext.defaultParallelism) if spread else _table(s, d, table)
    _add(name, lambda s, d: rows(s, d).selectExpr(key, f"{value} AS v").select(key, f(F.col("v")).alias("out")), f"SELECT {key}, {sql} AS out FROM (SELECT *, {value} AS v FROM {table})")


# --- text ---------------------------------------------------------------------------------
_NL = "chr(10)"
_ws = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
_inv = r"regexp_replace(X, '[\x{AD}\x{200B}-\x{200D}\x{FEFF}\x{202A}\x{202C}]', '', 'g')"
_hyp = r"regexp_replace(X, '([А-Яа-яЁёA-Za-z])[-‐‑‒–—―−]\s*\n\s*([А-Яа-яЁёA-Za-z])', '\1\2', 'g')"
_spc = r"regexp_replace(X, '[ \t\x{A0}\x{2009}\x{202F}]+', ' ', 'g')"
_mnl = r"regexp_replace(X, '\n{2,}', chr(10), 'g')"
_crl = r"regexp_replace(X, '\r\n?', chr(10), 'g')"
_strip = r"regexp_replace(X, '^\s+|\s+$', '', 'g')"


def _nest(*steps: str) -> str:
    out = "text"
    for s in steps:
        out = s.replace("X", out)
    return out


_on_text("nrm01_strip_invisible", T.strip_invisible, _nest(_inv))
_on_text("nrm03_hyphen_breaks", T.join_hyphen_breaks, _nest(_hyp))
_on_text("nrm04_spaces", T.collapse_spaces, _nest(_spc))
_on_text("nrm05_newlines", T.collapse_newlines, _nest(_mnl))
_on_text("nrm06_normalize", T.normalize, _nest(_inv, _crl, _hyp, _spc, _mnl, _strip))
_on_text("pst03_merge_hyphenated", T.merge_hyphenated, r"regexp_replace(text, '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g')")
_on_text("pst04_whitespace", T.normalize_whitespace, _ws)
_on_text("pst05_artifacts", T.remove_artifacts, r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR regexp_matches(x, '[\p{L}\p{N}]')), chr(10))")
_on_text("flt01_is_garbage", T.is_garbage, "NOT regexp_matches(text, '[А-Яа-яЁёA-Za-z0-9]')")
_dense = r"regexp_replace(x, '\s+', '', 'g')"
_let = rf"length(regexp_replace({_dense}, '[^\p{{L}}]', '', 'g'))"
_dig = rf"length(regexp_replace({_dense}, '[^\p{{Nd}}]', '', 'g'))"
_all = f"length({_dense})"
_oth = f"({_all} - {_let} - {_dig})"
_loose = rf"(regexp_matches({_dense}, '^[-=_*~`.•·]{{3,}}$') OR ({_all} > 0 AND NOT ({_let} = 0 AND {_oth} = 0) AND {_oth} * 10 >= {_all} * 7))"
_strict = f"({_loose} OR ({_all} = 1 AND {_let} = 1) OR ({_all} >= 3 AND {_oth} * 5 >= {_all} * 2))"
for _name, _strictness, _rule in (("flt05_garbage_lenient", "lenient", _loose), ("flt06_garbage_strict", "strict", _strict)):
    _on_text(_name, lambda c, k=_strictness: T.filter_garbage_lines(c, k), rf"CASE WHEN text = '' THEN text ELSE array_to_string(list_filter(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda x: NOT {_rule}), chr(10)) END")
_on_text("flt08_letters", lambda c: T.char_stats(c)["letters"], _let.replace("(x,", "(text,"))
_on_text("flt08_digits", lambda c: T.char_stats(c)["digits"], _dig.replace("(x,", "(text,"))
_on_text("flt19_substantial", T.is_substantial_page, r"length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 50 AND len(regexp_extract_all(text, '[\p{L}\p{N}_]{2,}')) >= 3")
_on_text("flt21_find", lambda c: T.count_needle(c, "The"), "len(regexp_extract_all(lower(text), 'the'))")
_on_text("agg21_alnum_score", T.count_alnum, r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))")
_HEAD = "'Транспортная накладная № ' || CAST(o_orderkey AS STRING) || chr(10) || repeat('строка груза ', 8) || chr(10)"
_BUNDLE = f"('начало ' || chr(10) || repeat({_HEAD}, CAST(o_orderkey % 4 AS INT)))"
_add("spl04_anchor_split", lambda s, d: B.documents(_table(s, d, "orders").selectExpr("o_orderkey AS source", f"{_BUNDLE} AS text")).select("source", "place", F.length("document").alias("n")), f"SELECT CAST(o_orderkey AS VARCHAR) AS source, CAST(k AS INT) AS place, CASE WHEN o_orderkey % 4 < 2 THEN length(trim({_BUNDLE}, ' ' || chr(10))) ELSE length(trim({_HEAD}, ' ' || chr(10))) END AS n FROM (SELECT *, unnest(range(1, greatest(o_orderkey % 4, 1) + 1)) AS k FROM orders)")
_over("pst21_fold_number", "orders", f"translate(o_orderpriority, 'AEO', 'АЕО') || '-' || {_S}", T.fold_number, "upper(translate(v, 'АЕО', 'AEO'))")
_over("nrm11_script_of", "customer", f"substr(translate(c_mktsegment || c_name, 'AEOtm', 'АЕОтм'), CAST(1 + c_custkey % 22 AS INT), 1)", T.script_of, "CASE WHEN regexp_matches(v, '^[А-Яа-яЁё]$') THEN 'c' WHEN regexp_matches(v, '^[A-Za-z]$') THEN 'l' ELSE '' END")
_over("nrm06_cyrillic", "documents", f"{_CYRILLIC.format('text')}", T.normalize, _nest(_inv, _crl, _hyp, _spc, _mnl, _strip).replace("text", "v"))
_over("flt15_capitals", "part", f"translate(CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE upper(split_part(p_name, ' ', 1)) END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'АБСДЕФГНИЖКЛМНОПЙРСТУВШХЫЗ')", lambda c: T.keep_capitals(c, F.lit(30)), "regexp_matches(v, '^[А-ЯЁ]{3,7}$')")
_over("flt16_brand", "part", f"(CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand WHEN 2 THEN p_name || ' ' || p_type ELSE p_name END)", T.is_brand_suspect, r"NOT regexp_matches(v, '\p{Nd}') AND regexp_matches(v, '(^|[^\p{L}])\p{Lu}{3,10}([^\p{L}]|$)')")

# --- validators ---------------------------------------------------------------------------
_w = lambda weights, v="v": "(" + " + ".join(f"CAST({v}[{i + 1}] AS INT) * {w}" for i, w in enumerate(weights)) + f") % 11 % 10 = CAST({v}[{len(weights) + 1}] AS INT)"
_inn = lambda v="v": f"CASE WHEN regexp_matches({v}, '^[0-9]{{10}}$') THEN {_w(V.INN10, v)} WHEN regexp_matches({v}, '^[0-9]{{12}}$') THEN {_w(V.INN12A, v)} AND {_w(V.INN12B, v)} ELSE false END"
_over("val05_inn", "orders", f"{_INN_TEXT}", V.is_inn, _inn())
_add(
    "val07_inn_over_orders",
    lambda s, d: _table(s, d, "orders").select("o_orderkey", V.is_inn(F.lpad((F.col("o_orderkey") * 7919 + 7700000000).cast("string"), 10, "0")).alias("ok")),
    f"SELECT o_orderkey, {_inn()} AS ok FROM (SELECT o_orderkey, lpad(CAST(o_orderkey * 7919 + 7700000000 AS VARCHAR), 10, '0') AS v FROM orders)",
)
_over("val08_kpp", "orders", f"lpad({_S}, 4, '7') || substr('АБ01XYzя', CAST(1 + o_orderkey % 7 AS INT), 2) || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0')", V.is_kpp, "regexp_matches(v, '^[0-9]{4}[0-9A-ZА-Я]{2}[0-9]{3}$')")
_over("val09_ogrn", "orders", f"(CASE WHEN o_orderkey % 2 = 0 THEN '10277001' ELSE '3045001160' END || lpad(CAST(o_orderkey AS STRING), 5, '0'))", V.is_ogrn, "CASE WHEN regexp_matches(v, '^[0-9]{13}$') THEN CAST(v[1:12] AS BIGINT) % 11 % 10 = CAST(v[13] AS INT) WHEN regexp_matches(v, '^[0-9]{15}$') THEN CAST(v[1:14] AS BIGINT) % 13 % 10 = CAST(v[15] AS INT) ELSE false END")
_subs = "list_distinct(list_filter(flatten(list_transform(range(1, length(v) + 1), lambda i: list_transform(range(0, 10), lambda d: v[1:i - 1] || CAST(d AS VARCHAR) || v[i + 1:]))), lambda x: x <> v))"
_dels = "list_distinct(list_transform(range(1, length(v) + 1), lambda i: v[1:i - 1] || v[i + 1:]))"
_over("val10_substitutions", "customer", f"CAST(c_custkey AS STRING)", lambda c: F.array_join(F.sort_array(V.substitutions(c)), ","), f"array_to_string(list_sort({_subs}), ',')")
_over("val11_deletions", "customer", f"CAST(c_custkey * 11 AS STRING)", lambda c: F.array_join(F.sort_array(V.deletions(c)), ","), f"array_to_string(list_sort({_dels}), ',')")
_near = f"list_distinct(list_filter(list_concat({_subs}, {_dels}), lambda x: {_inn('x')}))"
_over("val13_fix_inn", "customer", f"(CASE WHEN c_custkey % 2 = 0 THEN '77070' ELSE '7707' END || lpad(CAST(c_custkey AS STRING), 6, '0'))", V.fix_inn, f"CASE WHEN regexp_matches(v, '^[0-9]{{10,13}}$') AND NOT {_inn()} AND len({_near}) = 1 THEN {_near}[1] END")
_like = f"translate({{}}, '{V.LOOKALIKE}', '{V.DIGITS}')"
_over("val19_clean_digits", "orders", f"(translate({_S}, '015', 'OlS') || CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE '' END)", V.clean_digits, f"CASE WHEN regexp_matches({_like.format('v')}, '^[0-9]+$') THEN {_like.format('v')} END")
_over("val01_date", "orders", f"{_RU_DAY}", lambda c: V.is_date(c, F.lit("2024-06-01").cast("date")), r"coalesce(regexp_matches(v, '^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$') AND year(try_strptime(v, '%d.%m.%Y')) BETWEEN 2014 AND 2025, false)")
_dpat = r"^\s*([0-9OoОо|lIZzBSsGT]{1,2})[.,\s\-/]([0-9OoОо|lIZzBSsGT]{1,2})[.,\s\-/]([0-9OoОо|lIZzBSsGT]{2,4})\s*$"
_part = lambda i: _like.format(f"regexp_extract(v, '{_dpat}', {i})")
_over("val15_fix_date", "orders", f"replace(translate({_RU_DAY}, '0', 'O'), '.', CASE o_orderkey % 3 WHEN 0 THEN '.' WHEN 1 THEN '-' ELSE '/' END)", V.fix_date, f"CASE WHEN regexp_matches(v, '{_dpat}') THEN CASE WHEN year(try_strptime(dd, '%Y-%m-%d')) BETWEEN 1900 AND 2100 THEN strftime(try_strptime(dd, '%Y-%m-%d'), '%d.%m.%Y') END END".replace("dd", f"(CASE WHEN length({_part(3)}) = 2 THEN '20' || {_part(3)} ELSE lpad({_part(3)}, 4, '0') END || '-' || lpad({_part(2)}, 2, '0') || '-' || lpad({_part(1)}, 2, '0'))"))
_over("val18_thousands", "orders", f"CAST(o_orderkey * o_custkey AS STRING)", V.group_thousands, "trim(reverse(regexp_replace(reverse(v), '([0-9]{3})', '\\1 ', 'g')))")
_apat = r"^\s*([0-9\sOoОо]+)(?:[,.]([0-9\sOoОо]{1,2}))?(?:\s*(?:руб\.?|коп\.?|р\.|₽))?\s*$"
_ai = _like.format(f"regexp_replace(regexp_extract(v, '{_apat}', 1, 'i'), '\\s+', '', 'g')")
_af = _like.format(f"regexp_replace(regexp_extract(v, '{_apat}', 2, 'i'), '\\s+', '', 'g')")
_over("val16_fix_amount", "orders", f"(translate(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '0', 'O') || CASE o_orderkey % 4 WHEN 0 THEN ',5O руб' WHEN 1 THEN '.7' WHEN 2 THEN 'х' ELSE '' END)", V.fix_amount, f"CASE WHEN regexp_matches({_ai}, '^[0-9]+$') THEN trim(reverse(regexp_replace(reverse({_ai}), '([0-9]{{3}})', '\\1 ', 'g'))) || ',' || rpad({_af}, 2, '0') END")
_pd = f"regexp_replace({_like.format('v')}, '[^0-9]', '', 'g')"
_pn = f"CASE WHEN length({_pd}) = 10 THEN '7' || {_pd} WHEN length({_pd}) = 11 AND {_pd}[1] = '8' THEN '7' || {_pd}[2:] ELSE {_pd} END"
_over("val17_fix_phone", "orders", f"(CASE o_orderkey % 3 WHEN 0 THEN '8 (' WHEN 1 THEN '+7 ' ELSE '' END || CAST(200 + o_custkey % 700 AS STRING) || ') ' || lpad(translate({_S}, '0', 'O'), 7, '1'))", V.fix_phone, f"CASE WHEN regexp_matches({_pn}, '^7[3-9][0-9]{{9}}$') THEN '+7 (' || ({_pn})[2:4] || ') ' || ({_pn})[5:7] || '-' || ({_pn})[8:9] || '-' || ({_pn})[10:11] END")
_over("val02_plate", "orders", f"(substr('АВЕКМНОРСТУХABEKMHOPCTYXЖa', CAST(1 + o_orderkey % 26 AS INT), 1) || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || 'ВC' || CAST(o_orderkey % 190 AS STRING))", V.is_plate, f"regexp_matches(trim(replace(translate(upper(v), '{V.PLATE_LATIN}', '{V.PLATE_CYRILLIC}'), '  ', ' ')), '{V.PLATE}')")
_over("val20_iso_to_ru", "orders", f"(substr({_DAY}, 1, 8) || lpad(CAST(1 + o_orderkey % 31 AS STRING), 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN 'T10:00' ELSE '' END)", V.iso_to_ru, "strftime(try_strptime(v[1:10], '%Y-%m-%d'), '%d.%m.%Y')")
_over("val21_ru_to_iso", "orders", f"{_RU_DAY}", V.ru_to_iso, "strftime(try_strptime(v, '%d.%m.%Y'), '%Y-%m-%d')")

# --- word table ---------------------------------------------------------------------------
_WORDS = """SELECT l_orderkey AS page, CAST(l_linenumber % 2 AS INT) AS block, 1 AS par, CAST(l_linenumber % 3 AS INT) AS line, l_linenumber AS word_num,
    l_returnflag || l_linestatus || CAST(l_suppkey % 40 AS VARCHAR(20)) AS word, l_quantity * 2 AS conf,
    CAST(l_partkey % 500 AS INT) AS "left", CAST(l_suppkey % 70 AS INT) AS "top", 20 AS width, 10 AS height FROM lineitem"""


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    whole = lambda c: F.col(c).cast("int")
    return li.select(
        F.col("l_orderkey").alias("page"),
        (whole("l_linenumber") % 2).alias("block"),
        F.lit(1).alias("par"),
        (whole("l_linenumber") % 3).alias("line"),
        F.col("l_linenumber").alias("word_num"),
        F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 40).cast("string")).alias("word"),
        (F.col("l_quantity") * 2).alias("conf"),
        (whole("l_partkey") % 500).alias("left"),
        (whole("l_suppkey") % 70).alias("top"),
        F.lit(20).alias("width"),
        F.lit(10).alias("height"),
    )


def _on_words(name: str, f, sql: str) -> None:
    _add(name, lambda s, d: f(_words(s, d)), f"WITH w AS ({_WORDS}) {sql}")


_box = 'min("left") AS x0, min("top") AS y0, max("left" + width) AS x1, max("top" + height) AS y1'
_on_words("agg08_page_confidence", W.page_confidence, "SELECT page, avg(conf) AS mean_conf, count(*) AS n_words FROM w GROUP BY page")
_on_words("agg09_adaptive_threshold", lambda w: W.page_confidence(w).select("page", W.adaptive_threshold(F.col("mean_conf"), 60).alias("thr")), "SELECT page, CAST(CASE WHEN avg(conf) >= 90 THEN 40 WHEN avg(conf) < 70 THEN 70 ELSE 60 END AS DOUBLE) AS thr FROM w GROUP BY page")
_on_words("agg04_block_aggregates", W.block_aggregates, f"SELECT page, block, avg(conf) AS mean_conf, count(*) AS n_words, {_box} FROM w GROUP BY page, block")
_on_words("wrd07_rescue_candidates", W.rescue_candidates, f"SELECT page, block, avg(conf) AS mean_conf, count(*) AS n_words, {_box} FROM w GROUP BY page, block HAVING avg(conf) < 60 AND count(*) >= 3")
_noisy = f"SELECT page, block, count(*) AS n_words, count(*) FILTER (conf < 60) AS n_low, {_box} FROM w GROUP BY page, block HAVING count(*) >= 3 AND count(*) FILTER (conf < 60) >= count(*) * 0.5"
_on_words("agg05_noisy_blocks", W.noisy_blocks, _noisy)
_on_words("agg06_handwritten", W.handwritten, "SELECT page, block, par FROM w GROUP BY page, block, par HAVING avg(conf) < 40 AND count(*) >= 3")
_on_words("agg07_rebuild_text", lambda w: W.rebuild_text(w, 50), "SELECT page, string_agg(t, chr(10) ORDER BY block, par, line) AS text FROM (SELECT page, block, par, line, string_agg(word, ' ' ORDER BY word_num, word) AS t FROM w WHERE conf >= 50 GROUP BY page, block, par, line) GROUP BY page")
_on_words("agg08_low_words", lambda w: W.low_words(w, 50), "SELECT page, string_agg(word, '|' ORDER BY block, par, line, word_num, word) AS low FROM w WHERE conf < 50 GROUP BY page")
_on_words("agg14_histogram", W.histogram, "SELECT CAST(least(floor(conf / 10), 9) AS INT) AS bucket, count(*) AS n FROM w GROUP BY 1")
_on_words("agg15_top_words", lambda w: W.top_words(w, 60, 20), "SELECT word, avg(conf) AS mean_conf, count(*) AS n FROM w WHERE conf >= 60 GROUP BY word ORDER BY n DESC, word LIMIT 20")
_on_words("agg16_report", lambda w: W.report(w, 60), "SELECT page, count(*) AS n_words, count(*) FILTER (conf >= 60) AS n_kept, avg(conf) AS mean_conf FROM w GROUP BY ROLLUP (page)")
_on_words("wrd12_padded_box", lambda w: W.padded_box(w, 6, 500, 70), 'SELECT page, word_num, greatest(0, "left" - 6) AS x0, greatest(0, "top" - 6) AS y0, least(500, "left" + width + 6) AS x1, least(70, "top" + height + 6) AS y1 FROM w')
_on_words("wrd10_redactions", lambda w: W.redactions(w, 60, 0.5), f"SELECT page, 'word' AS kind, \"left\" * 0.5 AS x0, \"top\" * 0.5 AS y0, (\"left\" + width) * 0.5 AS x1, (\"top\" + height) * 0.5 AS y1 FROM w WHERE conf < 60 UNION ALL SELECT page, 'block', x0 * 0.5, y0 * 0.5, x1 * 0.5, y1 * 0.5 FROM ({_noisy})")
_on_words("win06_best_word", lambda w: W.best_word(w).select("page", "conf"), "SELECT page, max(conf) AS conf FROM w GROUP BY page")
_on_words("flt14_soft_rescue", lambda w: W.soft_rescue(w, 60).select("page", "word_num", "word", "conf"), r"SELECT page, word_num, word, conf FROM w WHERE conf >= 45 AND conf < 60 AND length(word) >= 3 AND (regexp_matches(word, '\p{Nd}') OR regexp_matches(word, '^[А-Яа-яЁё]+$') OR regexp_matches(word, '^[A-Za-z]+$'))")
_on_words("flt17_rescuable", lambda w: w.where(T.is_rescuable(F.col("word"), F.col("conf"))).select("page", "word_num", "word"), "SELECT page, word_num, word FROM w WHERE conf BETWEEN 30 AND 75 AND length(word) >= 3 AND regexp_matches(word, '[A-Za-z]')")
_on_words("wrd03_swap_floor", lambda w: w.select("page", "word_num", W.swapped_confidence(F.col("conf"), F.col("word") != "AF1").alias("conf")), "SELECT page, word_num, CASE WHEN word <> 'AF1' THEN greatest(conf, 80.0::DOUBLE) ELSE conf END AS conf FROM w")

# --- joins, sets, windows -----------------------------------------------------------------
_add(
    "jn01_catalog_fix",
    lambda s, d: L.catalog_fix(_table(s, d, "orders").select((F.col("o_orderkey") * 10 + 7000000000).cast("string").alias("token")), _table(s, d, "customer").select((F.col("c_custkey") * 1000 + 7000000000).cast("string").alias("value"))),
    """WITH t AS (SELECT DISTINCT CAST(o_orderkey * 10 + 7000000000 AS VARCHAR) AS token FROM orders),
       c AS (SELECT DISTINCT CAST(c_custkey * 1000 + 7000000000 AS VARCHAR) AS value FROM customer),
       n AS (SELECT DISTINCT token, x AS value FROM (SELECT token, unnest(list_concat([token], flatten(list_transform(range(1, length(token) + 1), lambda i: list_transform(range(0, 10), lambda k: token[1:i - 1] || CAST(k AS VARCHAR) || token[i + 1:]))), list_transform(range(1, length(token) + 1), lambda i: token[1:i - 1] || token[i + 1:]))) AS x FROM t)),
       h AS (SELECT token, min(c.value) AS value, count(*) AS n, bool_or(c.value = token) AS own FROM n JOIN c USING (value) GROUP BY token)
       SELECT t.token, CASE WHEN own THEN t.token WHEN n = 1 THEN value END AS fixed FROM t LEFT JOIN h USING (token)""",
)
_add(
    "jn02_closest_word",
    lambda s, d: L.closest_word(_table(s, d, "documents").select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " ")).alias("word")).where("length(word) between 3 and 12").distinct(), _table(s, d, "part").select(F.explode(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ")).alias("entry")).where("entry rlike '^[a-z]+$'").groupBy("entry").agg(F.lit(0).alias("pos"))),
    """WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM documents) WHERE length(word) BETWEEN 3 AND 12),
       e AS (SELECT DISTINCT entry FROM (SELECT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS entry FROM part) WHERE regexp_matches(entry, '^[a-z]+$'))
       SELECT word, match, CAST(dist AS INT) AS dist FROM (SELECT word, entry AS match, levenshtein(word, entry) AS dist, row_number() OVER (PARTITION BY word ORDER BY levenshtein(word, entry), length(entry), entry) AS k
       FROM w, e WHERE levenshtein(word, entry) <= CASE WHEN length(word) < 6 THEN 1 ELSE 2 END) WHERE k = 1""",
)
_add(
    "jn03_registry",
    lambda s, d: L.registry(_table(s, d, "orders").selectExpr("o_orderkey", "CAST(7700000000 + o_custkey * 7919 AS STRING) AS inn"), _table(s, d, "customer").selectExpr("CAST(7700000000 + c_custkey * 7919 AS STRING) AS inn", "c_name")),
    f"SELECT o_orderkey, v AS inn, CASE WHEN {_inn()} THEN c_name END AS c_name FROM (SELECT o_orderkey, CAST(7700000000 + o_custkey * 7919 AS VARCHAR) AS v, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey)",
)
_add(
    "jn04_diff_rows",
    lambda s, d: L.diff_rows(
        _table(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        _table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment")),
        "c_custkey",
        ["name", "segment"],
    ),
    """SELECT c_custkey, 'name' AS field, c_name AS original, c_name || 'x' AS corrected, 'fix' AS kind FROM customer WHERE c_custkey % 3 = 0
       UNION ALL SELECT c_custkey, 'segment', c_mktsegment, '', 'clear' FROM customer WHERE c_custkey % 5 = 0""",
)
_add(
    "jn07_fill_from_engine",
    lambda s, d: L.fill_from_engine(_table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(F.col("role") == "user", F.col("text")).alias("text"), F.lit(None).cast("double").alias("conf")), _table(s, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.left("text", F.lit(20)).alias("text"), F.lit(50.0).alias("conf"))),
    "SELECT conv_id AS doc, turn AS page, coalesce(nullif(CASE WHEN role = 'user' THEN c.text END, ''), left(d.text, 20)) AS text, CASE WHEN d.doc_id IS NOT NULL THEN 50.0 END::DOUBLE AS conf FROM conversations c LEFT JOIN documents d ON doc_id = conv_id AND turn = 1",
)
_add(
    "jn10_insert_if_absent",
    lambda s, d: L.insert_if_absent(_table(s, d, "customer").select("c_custkey", "c_name"), _table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("new "), F.col("o_custkey").cast("string")).alias("c_name")), "c_custkey"),
    "SELECT c_custkey, c_name FROM customer UNION ALL SELECT DISTINCT o_custkey, 'new ' || CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
)
_add(
    "src21_merge_by_priority",
    lambda s, d: L.first_by(_table(s, d, "customer").select("c_custkey", F.lit(1).alias("prio"), F.col("c_name").alias("name")).unionByName(_table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(0).alias("prio"), F.lit("cached").alias("name"))), "c_custkey", ["prio"]),
    "SELECT c_custkey, CAST(CASE WHEN bool_or(cached) THEN 0 ELSE 1 END AS INT) AS prio, CASE WHEN bool_or(cached) THEN 'cached' ELSE min(n) END AS name FROM (SELECT c_custkey, false AS cached, c_name AS n FROM customer UNION ALL SELECT o_custkey, true, NULL FROM orders) GROUP BY c_custkey",
)
_add(
    "win03_page_islands",
    lambda s, d: L.islands(_table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).agg(F.max(F.when(F.col("l_returnflag") == "A", "start").when(F.col("l_returnflag") == "N", "cont").otherwise("blank")).alias("kind"))),
    """WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, max(CASE l_returnflag WHEN 'A' THEN 'start' WHEN 'N' THEN 'cont' ELSE 'blank' END) AS kind FROM lineitem GROUP BY 1, 2)
       SELECT doc, page, CAST(grp AS BIGINT) AS grp FROM (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page) AS grp FROM p) WHERE grp > 0 AND kind IN ('start', 'cont')""",
)
_add(
    "win05_evict",
    lambda s, d: L.evict(_table(s, d, "orders").select(F.col("o_orderpriority").alias("bucket"), F.col("o_orderkey").alias("key"), F.floor("o_totalprice").cast("long").alias("size"), F.col("o_orderdate").alias("mtime")), 5_000_000).select("bucket", "key"),
    "SELECT bucket, key FROM (SELECT o_orderpriority AS bucket, o_orderkey AS key, sum(CAST(floor(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto FROM orders) WHERE upto > 5000000",
)
_add("set01_ordered_distinct", lambda s, d: L.ordered_distinct(_table(s, d, "events"), "event_type", "event_id"), "SELECT event_type, min(event_id) AS event_id FROM events GROUP BY event_type")
_add("set02_intersection", lambda s, d: _table(s, d, "customer").select("c_custkey", L.only_known(V.substitutions(F.col("c_custkey").cast("string")), F.array(*[F.lit(x) for x in ("11", "21", "100")])).alias("known")), "SELECT c_custkey, CASE WHEN len(k) = 1 THEN k[1] END AS known FROM (SELECT c_custkey, list_filter(['11', '21', '100'], lambda x: length(x) = length(v) AND levenshtein(x, v) = 1) AS k FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS v FROM customer))")
_add("agg02_mean_of_positive", lambda s, d: P.average_confidence(_table(s, d, "events").select(F.col("event_type").alias("job"), (F.floor("value") - 20).alias("conf"))), "SELECT event_type AS job, coalesce(avg(CAST(floor(value) AS BIGINT) - 20) FILTER (floor(value) > 20), 0) AS mean_conf FROM events GROUP BY event_type")
_add("agg11_outcomes_by_field", lambda s, d: E.outcomes(_table(s, d, "lineitem").select(F.col("l_returnflag").alias("field"), F.when(F.col("l_linenumber") > 1, F.col("l_linestatus") == "F").alias("ok"))), "SELECT coalesce(l_returnflag, 'TOTAL') AS field, count(*) FILTER (l_linenumber > 1 AND l_linestatus = 'F') AS n_ok, count(*) FILTER (l_linenumber > 1 AND l_linestatus <> 'F') AS n_fail, count(*) FILTER (l_linenumber <= 1) AS n_skip, CAST(floor(count(*) FILTER (l_linenumber > 1 AND l_linestatus = 'F') * 100 / nullif(count(*) FILTER (l_linenumber > 1), 0)) AS BIGINT) AS percent FROM lineitem GROUP BY ROLLUP (l_returnflag)")
_add(
    "agg17_best_cell",
    lambda s, d: L.first_by(_table(s, d, "part").select(F.col("p_brand").alias("document"), F.col("p_retailprice").alias("cer"), F.col("p_size").alias("wer"), F.col("p_partkey").alias("cell")), "document", ["cer", "wer", "cell"]),
    "SELECT document, cer, wer, cell FROM (SELECT p_brand AS document, p_retailprice AS cer, p_size AS wer, p_partkey AS cell, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_size, p_partkey) AS k FROM part) WHERE k = 1",
)
_add("agg18_cer", lambda s, d: _table(s, d, "part").select("p_partkey", E.char_errors(F.col("p_name"), F.concat_ws(" ", F.lower("p_type"), F.col("p_name"))).alias("cer")), "SELECT p_partkey, round(levenshtein(p_name, lower(p_type) || ' ' || p_name) / length(p_name), 4) AS cer FROM part")
_add("udf12_kind", lambda s, d: _table(s, d, "orders").select("o_orderkey", L.kind_of(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority"))).alias("kind")), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'fill' WHEN o_orderkey % 3 = 0 THEN 'clear' ELSE 'fix' END AS kind FROM orders")
_add("win09_recent", lambda s, d: L.recent(_table(s, d, "events"), "user_id", "event_type", "event_id", 2).select("user_id", F.array_join("recent", ",").alias("recent")), "SELECT user_id, string_agg(event_type, ',' ORDER BY last DESC) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS k FROM (SELECT user_id, event_type, max(event_id) AS last FROM events GROUP BY 1, 2)) WHERE k <= 2 GROUP BY user_id")

# --- queue and streams --------------------------------------------------------------------
_LATEST = "SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"))


def _stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(_as_found(sf_dir, "events"))
    state = S.latest(stream.select("user_id", "event_id", F.col("event_type").alias("status")), "user_id", ["event_id"], "status")
    return S.run_once(state, "user_id")


_add("str02_latest_status", lambda s, d: S.latest(_events(s, d), "user_id", ["event_id"], "status"), _LATEST)
_add("str02_latest_status_stream", _stream_latest, _LATEST)
_add("str06_clear_done", lambda s, d: S.clear_done(S.latest(_events(s, d), "user_id", ["event_id"], "status"), ("error",)), f"SELECT * FROM ({_LATEST}) WHERE status <> 'error'")
_add("str10_recover", lambda s, d: S.recover(S.latest(_events(s, d), "user_id", ["event_id"], "status")), f"SELECT user_id, 'pending' AS status FROM ({_LATEST}) WHERE status <> 'completed'")
_add("str11_cache_key", lambda s, d: _table(s, d, "documents").select("doc_id", P.cache_key(F.col("text"), F.coalesce("source", F.lit("")), "v11").alias("key")), "SELECT doc_id, left(sha256(text), 16) || '--' || left(sha256(coalesce(source, '')), 16) || '--v11' AS key FROM documents")


# --- look-alikes, tokens and rules: what SQL's patterns cannot look around is held against brute force in tests ---
for _name, _f in {"nrm02_confusables": R.fix_confusables, "nrm06_normalize_cyrillic": R.normalize_cyrillic, "nrm07_collapse": R.collapse, "pst06_russian": R.autocorrect_russian, "pst07_english": R.autocorrect_english, "pst09_unify_scripts": R.unify_scripts, "pst14_entities": R.canonical_entities}.items():
    _add(_name, lambda s, d, f=_f: _table(s, d, "documents").select("doc_id", f(F.col("text")).alias("out")))

_count = lambda signs: f"len(regexp_extract_all(X, '[{signs}]'))"
_cy, _la = _count(R.ONLY_CYRILLIC), _count(R.ONLY_LATIN)
_major = f"CASE WHEN {_cy} + {_la} < 3 THEN NULL WHEN {_cy} >= 3 * {_la} THEN 'cyr' WHEN {_la} >= 3 * {_cy} THEN 'lat' END"
_kind = f"CASE WHEN {_cy} > 0 AND {_la} = 0 THEN 'cyr' WHEN {_la} > 0 AND {_cy} = 0 THEN 'lat' ELSE 'mixed' END"
_on_text("pst12_script_majority", R.script_majority, _major.replace("X", "text"))
_over("pst11_word_script", "part", f"{_MIX}", R.word_script, _kind.replace("X", "v"))
_over("pst10_unify_word", "part", f"{_MIX}", lambda c: R.unify_word(c, F.lit("cyr"), F.lit(False)), f"CASE coalesce(nullif({_kind}, 'mixed'), 'cyr') WHEN 'cyr' THEN translate(v, '{R.LATIN}', '{R.CYRILLIC}') ELSE translate(v, '{R.CYRILLIC}', '{R.LATIN}') END".replace("X", "v"))
_runs = "len(regexp_extract_all(regexp_replace(X, '[^А-яЁёA-Za-z]', '', 'g'), '[А-яЁё]+|[A-Za-z]+'))"
_over("nrm10_script_runs", "part", f"{_MIX}", R.script_runs, _runs.replace("X", "v"))
_sq = lambda x: x.replace("'", "''")
_core = f"regexp_replace(X, '^[{_sq(R._class(R.FRAME))}]+|[{_sq(R._class(R.FRAME))}]+$', '', 'g')"
_tok = f"""CASE WHEN X = '' THEN true WHEN regexp_matches(X, '[А-ЯЁа-яёA-Za-z0-9][{_sq(R.QUOTES)}]+[А-ЯЁа-яёA-Za-z]') OR regexp_matches(X, '\\p{{Nd}}["''`‘’]+$') THEN true
    WHEN {_core} = '' THEN length(X) > 1 AND length(replace(X, X[1], '')) > 0
    ELSE regexp_matches({_core}, '[{R.FOREIGN}]') OR regexp_matches({_core}, '[А-ЯЁа-яёA-Za-z0-9][{_sq(R.QUOTES[:-2])}]+$') OR {_runs.replace("X", _core)} >= 3 END"""
_over("flt02_garbage_token", "part", f"{_MIX}", R.is_garbage_token, _tok.replace("X", "v"))
_on_text("flt02_garbage_tokens_of_texts", lambda c: F.size(F.filter(F.split(c, r"[ \t\r\n\f\x0B]+"), R.is_garbage_token)), rf"len(list_filter(regexp_split_to_array(text, '[ \t\r\n\f\v]+'), lambda x: {_tok.replace('X', 'x')}))")
_noise_v = f"(CASE p_partkey % 4 WHEN 0 THEN p_name || ' іі їх' WHEN 1 THEN 'іі' || p_brand || ' їх' WHEN 2 THEN '  ' ELSE {_CYRILLIC.format('p_name')} || ' ' || p_type END)"
_over("flt03_noise_line", "part", _noise_v, R.is_noise_line, f"CASE WHEN trim(v) = '' THEN true ELSE 2 * len(list_filter(string_split_regex(trim(v), ' +'), lambda x: {_tok.replace('X', 'x')})) >= len(string_split_regex(trim(v), ' +')) END")
_over("nrm08_clean_value", "part", f"(CASE p_partkey % 5 WHEN 0 THEN ': ' || p_name || ' ;' WHEN 1 THEN '--' WHEN 2 THEN '!!' WHEN 3 THEN '№ ' || CAST(p_size AS STRING) || ' |' ELSE {_CYRILLIC.format('p_name')} END)", R.clean_value, r"CASE WHEN regexp_replace(v, '^[ \t\r\n:;,.\-–—|]+|[ \t\r\n:;,.\-–—|]+$', '', 'g') = '' THEN 'отсутствует' WHEN NOT regexp_matches(v, '[А-Яа-яЁёA-Za-z0-9]') THEN 'неразборчиво' ELSE regexp_replace(v, '^[ \t\r\n:;,.\-–—|]+|[ \t\r\n:;,.\-–—|]+$', '', 'g') END")
_over("pst20_fold_name", "part", f"('ООО «' || {_CYRILLIC.format('p_name')} || 'ё-' || p_brand || '»')", R.fold_name, r"regexp_replace(translate(lower(v), 'ёзоеархукмтвн', 'e3oeapxykmtbh'), '[^\p{L}\p{N} ]', '', 'g')")
_on_text("pst08_custom_rules", lambda c: R.apply_rules(c, [R.Rule("the", "THE", is_regex=False), R.Rule("([0-9]+)-([0-9]+)", r"\2-\1"), R.Rule("(", "x"), R.Rule("e", "", enabled=False)]), r"regexp_replace(replace(text, 'the', 'THE'), '([0-9]+)-([0-9]+)', '\2-\1', 'g')")
_over("val06_find_inn", "orders", f"('ИНН ' || {_INN_TEXT} || ' x ' || CAST(7700000000 + o_custkey * 7919 AS STRING) || ' y')", R.find_inn, f"list_filter(regexp_extract_all(v, '[0-9]{{10,12}}'), lambda x: {_inn('x')})[1]")
_over("val03_find_plate", "orders", f"(CASE WHEN o_orderkey % 3 = 0 THEN 'авто ' ELSE 'x ' END || substr('АВЕКМНОРСТУХabekmhopctyxж', CAST(1 + o_orderkey % 25 AS INT), 1) || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || 'НP' || lpad(CAST(o_orderkey % 190 AS STRING), 2, '1') || ' y')", R.find_plate, f"nullif(translate(regexp_extract(upper(v), '[{V.PLATE_CYRILLIC}{V.PLATE_LATIN}][0-9]{{3}}[{V.PLATE_CYRILLIC}{V.PLATE_LATIN}]{{2}}[0-9]{{2,3}}'), '{V.PLATE_LATIN}', '{V.PLATE_CYRILLIC}'), '')")
_over("val04_format_plate", "orders", f"(CASE o_orderkey % 3 WHEN 0 THEN 'Р' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || 'НР152' WHEN 1 THEN 'АА' || lpad(CAST(o_custkey AS STRING), 4, '0') || ' 77' ELSE o_orderpriority END)", R.format_plate, rf"CASE WHEN regexp_matches(v, '^[{V.PLATE_CYRILLIC}][0-9]{{3}}') THEN regexp_replace(v, '^(.)(...)(..)(.*)$', '\1 \2 \3 \4') WHEN regexp_matches(v, '^[{V.PLATE_CYRILLIC}]{{2}}[0-9]') THEN regexp_replace(replace(v, ' ', ''), '^(..)(....)(.*)$', '\1 \2 \3') ELSE v END")

# --- waybills made of orders: what each field must read follows from the columns --------------------
_CLIENT = "split_part(o_orderpriority, '-', 2) || '-' || CAST(o_custkey AS STRING)"
_GOODS = "CASE o_orderstatus WHEN 'F' THEN 'плита бетонная' WHEN 'O' THEN 'кирпич' ELSE 'щебень гранитный' END"
_GRZ = "substr('АВЕКМНОРСТУХ', CAST(1 + o_orderkey % 12 AS INT), 1) || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || 'ВС77'"
_DATE = f"(lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0') || '.' || substr({_DAY}, 6, 2) || '.2023')"
#: Every third has no number sign's line, every fifth no section of the vehicle, every seventh neither title nor body of the consignee.
_WAYBILL = f"""('Транспортная накладная' || chr(10) || 'Экземпляр № 2' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '№ ' || {_S} || '/К' END || ' от ' || {_DATE} || chr(10)
    || '1. Грузоотправитель' || chr(10) || 'является экспедитором' || chr(10) || 'ООО «' || {_CLIENT} || '», г. Тверь, ИНН 7707083893, КПП 770701001' || chr(10) || 'Подпись: Петров' || chr(10)
    || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '2. Грузополучатель: АО «' || {_CLIENT} || '», г. Псков, ИНН 7707083893' || chr(10) END
    || '3. Груз' || chr(10) || 'Наименование: ' || {_GOODS} || ', ' || CAST(o_custkey AS STRING) || ' шт' || chr(10) || 'Кол-во мест: ' || CAST(o_orderkey % 90 AS STRING) || chr(10) || 'Упаковка — поддон' || chr(10)
    || '6. Перевозчик' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Сидоров А.Б.' ELSE 'Самовывоз' END || chr(10)
    || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '7. Транспортное средство' || chr(10) || 'MAN ' || {_GRZ} || chr(10) END
    || '8. Приём груза' || chr(10) || 'ООО «Склад ' || {_CLIENT} || '», г. Тула, ИНН 7707083893, КПП 1' || chr(10) || '9. Отметки' || chr(10) || 'нет')"""


def _orders(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "orders").repartition(s.sparkContext.defaultParallelism)


def _waybills(s: SparkSession, d: str) -> DataFrame:
    # rows of some 50 bytes become texts of a kilobyte that are parsed in Python: one file's few blocks are spread first
    return _orders(s, d).selectExpr("o_orderkey AS source", f"{_WAYBILL} AS text")


def _field(name: str, fields: list[str], sql: dict[str, str]) -> None:
    cols = [c for f in fields for c in (f, f"{f}_conf")]
    _add(name, lambda s, d: B.parse(_waybills(s, d), "2024-06-01", fields).select("source", *cols), "SELECT CAST(o_orderkey AS VARCHAR) AS source, " + ", ".join(f"{sql[c]} AS {c}" for c in cols) + " FROM orders")


_NO = "'отсутствует'"
#: Dates that are printed on the form itself.
_PRINTED = "('30.11.2021', '21.12.2020', '26.12.2011', '02.04.2021', '02.04.2024', '11.12.2023')"
_PIECES_SQL = "CAST(o_orderkey % 90 AS VARCHAR) || ' мест, ' || CAST(o_custkey AS VARCHAR) || ' шт'"
_FIELD_SQL = {
    "number": f"CASE WHEN o_orderkey % 3 = 0 THEN {_NO} ELSE {_S} || '/К' END", "number_conf": "CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE",
    "date": f"CASE WHEN {_DATE} IN {_PRINTED} THEN {_NO} ELSE {_DATE} END", "date_conf": f"CASE WHEN {_DATE} IN {_PRINTED} THEN 0.0 ELSE 1.0 END::DOUBLE",
    "shipper": f"'ООО «' || {_CLIENT} || '», г. Тверь, ИНН 7707083893'", "shipper_conf": "0.9::DOUBLE",
    "consignee": f"CASE WHEN o_orderkey % 7 = 0 THEN {_NO} ELSE 'АО «' || {_CLIENT} || '», г. Псков' END", "consignee_conf": "CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE 0.9 END::DOUBLE",
    "cargo": _GOODS, "cargo_conf": "0.9::DOUBLE",
    "volume": _PIECES_SQL, "volume_conf": "0.9::DOUBLE",
    "driver": f"CASE WHEN o_orderkey % 2 = 0 THEN 'Сидоров А.Б.' ELSE {_NO} END", "driver_conf": "CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE",
    "vehicle": f"CASE WHEN o_orderkey % 5 = 0 THEN {_NO} ELSE {_GRZ} END", "vehicle_conf": "CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE",
    "reception": f"'ООО «Склад ' || {_CLIENT} || '», г. Тула, ИНН 7707083893'", "reception_conf": "0.9::DOUBLE",
}
for _name, _fields in {"ext01_all_fields": list(B.FIELDS), "ext02_number_and_date": ["number", "date"], "ext03_shipper": ["shipper"], "ext04_consignee": ["consignee"], "ext05_cargo": ["cargo"], "ext06_volume": ["volume"], "ext07_driver": ["driver"], "ext08_vehicle": ["vehicle"], "ext09_reception": ["reception"]}.items():
    _field(_name, _fields, _FIELD_SQL)
_conf_sum = " + ".join(f"({_FIELD_SQL[f'{f}_conf']})" for f in B.FIELDS)
_add("ext22_rows", lambda s, d: B.parse(_waybills(s, d), "2024-06-01").select("source", "waybill", "note", "overall"), f"SELECT CAST(o_orderkey AS VARCHAR) AS source, 'Транспортная накладная' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' № ' || {_S} || '/К' END AS waybill, '' AS note, round(({_conf_sum}) / 9, 2) AS overall FROM orders")
_add("ext21_waybill_rows", lambda s, d: B.parse(_table(s, d, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.expr(_WAYBILL).alias("t")))).alias("x")).select("source", F.array_join("x.t", "\n").alias("text")), "2024-06-01", ["number"]).select("source", "number"), f"SELECT CASE WHEN n > 1 THEN CAST(o_custkey AS VARCHAR) || '#' || k ELSE CAST(o_custkey AS VARCHAR) END AS source, {_FIELD_SQL['number']} AS number FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
_ROLES = {
    "head": f"'Транспортная накладная' || chr(10) || 'Экземпляр № 2' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '№ ' || {_S} || '/К' END || ' от ' || {_DATE}",
    "shipper": f"'является экспедитором' || chr(10) || 'ООО «' || {_CLIENT} || '», г. Тверь, ИНН 7707083893, КПП 770701001' || chr(10) || 'Подпись: Петров'",
    "consignee": f"CASE WHEN o_orderkey % 7 > 0 THEN 'АО «' || {_CLIENT} || '», г. Псков, ИНН 7707083893' END",
    "cargo": f"'Наименование: ' || {_GOODS} || ', ' || CAST(o_custkey AS VARCHAR) || ' шт' || chr(10) || 'Кол-во мест: ' || CAST(o_orderkey % 90 AS VARCHAR) || chr(10) || 'Упаковка — поддон'",
    "carrier": "CASE WHEN o_orderkey % 2 = 0 THEN 'Сидоров А.Б.' ELSE 'Самовывоз' END",
    "vehicle": f"CASE WHEN o_orderkey % 5 > 0 THEN 'MAN ' || {_GRZ} END",
    "reception": f"'ООО «Склад ' || {_CLIENT} || '», г. Тула, ИНН 7707083893, КПП 1'",
}
_add("spl05_sections", lambda s, d: B.sections(_waybills(s, d)), " UNION ALL ".join(f"SELECT * FROM (SELECT CAST(o_orderkey AS VARCHAR) AS source, '{r}' AS role, {e} AS body FROM orders) WHERE body IS NOT NULL" for r, e in _ROLES.items()))
_title_at = {"shipper": "4", "consignee": "8", "cargo": "8 + g", "carrier": "12 + g", "vehicle": "14 + g", "reception": "14 + g + 2 * v", "": "16 + g + 2 * v"}
_has = {"consignee": "g = 1", "vehicle": "v = 1"}
_add("spl06_titles", lambda s, d: B.titles(_waybills(s, d)), " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS source, CAST({at} AS INT) AS line, '{r}' AS role FROM (SELECT *, CASE WHEN o_orderkey % 7 > 0 THEN 1 ELSE 0 END AS g, CASE WHEN o_orderkey % 5 > 0 THEN 1 ELSE 0 END AS v FROM orders) WHERE {_has.get(r, 'true')}" for r, at in _title_at.items()))
#: Titles misread in one sign of their first word, and what no title is near.
_TITLES_SQL = "(CASE o_orderkey % 8 WHEN 0 THEN 'Грузополучатель' WHEN 1 THEN 'Грузопелучатель' WHEN 2 THEN 'Грузоотправнтель' WHEN 3 THEN 'Груз: ' WHEN 4 THEN 'Перевозчнк' WHEN 5 THEN 'Отметки' WHEN 6 THEN 'Покупатель' ELSE 'Tpys' END)"
_add("spl07_title_roles", lambda s, d: B.titles(_table(s, d, "orders").selectExpr("o_orderkey AS source", f"'9{{0}} ' || {_TITLES_SQL} || ' ' || o_orderpriority AS text".replace("{0}", ""))).select("source", "role"), "SELECT CAST(o_orderkey AS VARCHAR) AS source, CASE o_orderkey % 8 WHEN 0 THEN 'consignee' WHEN 1 THEN 'consignee' WHEN 2 THEN 'shipper' WHEN 3 THEN 'cargo' WHEN 4 THEN 'carrier' WHEN 5 THEN '' WHEN 6 THEN 'consignee' END AS role FROM orders WHERE o_orderkey % 8 < 7")
_add("spl08_number_roles", lambda s, d: B.titles(_table(s, d, "orders").selectExpr("o_orderkey AS source", "CAST(o_orderkey % 12 AS STRING) || '. Xqzw ' || o_orderpriority AS text")).select("source", "role"), "SELECT CAST(o_orderkey AS VARCHAR) AS source, CASE o_orderkey % 12 WHEN 3 THEN 'cargo' WHEN 6 THEN 'carrier' WHEN 7 THEN 'vehicle' ELSE 'reception' END AS role FROM orders WHERE o_orderkey % 12 IN (3, 6, 7, 8)")
#: Pages of a bundle, one a line item: foreign ones, first ones, and those that go on.
_PAGE_SQL = "CASE l_linenumber % 4 WHEN 0 THEN 'Счет-фактура ' || repeat('товар ', 20) WHEN 1 THEN 'Транспортная накладная ' || CAST(l_linenumber AS STRING) || ' грузоотправитель ' || repeat('строка ', 15) WHEN 2 THEN 'Транспортная накладная ' || repeat('оборот ', 15) ELSE 'мало' END"


def _bundles(s: SparkSession, d: str) -> DataFrame:
    pages = _table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).selectExpr("l_orderkey", "l_linenumber", f"{_PAGE_SQL} AS page")
    return pages.groupBy(F.col("l_orderkey").alias("source")).agg(F.array_join(F.sort_array(F.collect_list(F.struct("l_linenumber", "page")))["page"], "\f").alias("text"))


_add("spl02_page_split", lambda s, d: B.documents(_bundles(s, d).where("text like '%Счет-фактура%' and text like '%грузоотправитель%'")).select("source", "place", F.length("document").alias("n")), f"""WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, {_PAGE_SQL} AS page FROM lineitem), o AS (SELECT l_orderkey FROM p GROUP BY 1 HAVING bool_or(l_linenumber % 4 = 0) AND bool_or(l_linenumber % 4 = 1)),
       g AS (SELECT *, sum(CASE WHEN l_linenumber % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS grp FROM p JOIN o USING (l_orderkey))
       SELECT CAST(l_orderkey AS VARCHAR) AS source, CAST(grp AS INT) AS place, length(trim(string_agg(page, chr(10) ORDER BY l_linenumber))) AS n FROM g WHERE grp > 0 AND l_linenumber % 4 IN (1, 2) GROUP BY l_orderkey, grp""")
_add("spl03_page_kinds", lambda s, d: _table(s, d, "lineitem").select("l_linenumber").distinct().selectExpr("l_linenumber", f"{_PAGE_SQL} AS page").select("l_linenumber", B.page_kind_of(F.col("page")).alias("kind")), "SELECT DISTINCT l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'upd' WHEN 1 THEN 'ttn_start' WHEN 2 THEN 'ttn_cont' ELSE 'blank' END AS kind FROM lineitem")
_add("spl10_from_pages", lambda s, d: B.from_pages(_waybills(s, d).select(F.col("source").alias("doc"), F.lit(1).alias("page"), "text"), "2024-06-01", only=["number"]).select("source", "number"), f"SELECT CAST(o_orderkey AS VARCHAR) AS source, {_FIELD_SQL['number']} AS number FROM orders")
_add("ext21_waybills_in_documents", lambda s, d: B.parse(_table(s, d, "documents").select(F.col("doc_id").alias("source"), R.normalize_cyrillic(F.col("text")).alias("text")), "2024-06-01"))

# --- readings, jobs, sheets, evaluation --------------------------------------------------------
_add("snk02_export_text", lambda s, d: files.export_text(_table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text", F.lit(None).cast("string").alias("error"))), r"""SELECT doc, regexp_replace(t, '\s+$', '') || chr(10) AS text FROM (SELECT conv_id AS doc, string_agg('--- Page ' || CAST(turn AS VARCHAR) || ' ---' || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id)""")
_add("msc16_human_bytes", lambda s, d: _table(s, d, "orders").select("o_orderkey", files.human_bytes(F.floor(F.col("o_totalprice")).cast("long") * F.col("o_orderkey")).alias("size")), "SELECT o_orderkey, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1024 ** 2 THEN printf('%.2f KB', n / 1024) WHEN n < 1024 ** 3 THEN printf('%.2f MB', n / 1024 ** 2) WHEN n < 1024 ** 4 THEN printf('%.2f GB', n / 1024 ** 3) ELSE printf('%.2f TB', n / 1024 ** 4) END AS size FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * o_orderkey AS n FROM orders)")
_over("msc14_output_path", "part", f"(p_name || '/' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '' ELSE '.d/x' END)", files.output_path, r"regexp_replace(v, '^(.*?)(\.[^./]+)?$', '\1_ocr\2')")
_over("img14_rotation", "orders", f"('Rotate: ' || CAST(90 * (o_orderkey % 5) AS STRING) || chr(10) || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'Orientation confidence: ' || CAST(o_custkey % 4 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING) END)", D.rotation, r"CASE WHEN TRY_CAST(regexp_extract(v, 'Orientation confidence:\s*([0-9.]+)', 1) AS DOUBLE) >= 1 THEN CAST(regexp_extract(v, 'Rotate:\s*([0-9]+)', 1) AS INT) % 360 END")
_over("img15_script", "orders", f"('Script: ' || CASE o_orderkey % 3 WHEN 0 THEN 'Cyrillic' WHEN 1 THEN 'Latin' ELSE 'Han' END || chr(10) || 'Script confidence: ' || CAST(o_custkey % 4 AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING))", D.script_language, r"CASE WHEN CAST(regexp_extract(v, 'Script confidence:\s*([0-9.]+)', 1) AS DOUBLE) >= 2 THEN CASE regexp_extract(v, 'Script:\s*(\w+)', 1) WHEN 'Cyrillic' THEN 'rus' WHEN 'Latin' THEN 'eng' END END")
_add("img20_kernel", lambda s, d: _table(s, d, "part").select("p_partkey", D.scaled_kernel(F.col("p_size"), F.lit(450)).alias("k")), "SELECT p_partkey, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS k FROM (SELECT p_partkey, CAST(greatest(1, round_even(p_size * 450 / 300, 0)) AS INT) AS k FROM part)")
_on_words("wrd02_better_script", lambda w: w.select("page", "word_num", D.better_script(F.col("word"), F.col("conf"), F.lit("рус"), (F.col("left") % 101).cast("double"), F.lit("eng"), (F.col("top") + 20).cast("double")).alias("b")).select("page", "word_num", "b.word", "b.conf"), """SELECT page, word_num, CASE WHEN r >= e + 5 THEN 'рус' WHEN e >= r + 5 THEN 'eng' ELSE word END AS word, CASE WHEN r >= e + 5 THEN r WHEN e >= r + 5 THEN e ELSE conf END AS conf FROM (SELECT *, CAST("left" % 101 AS DOUBLE) AS r, CAST("top" + 20 AS DOUBLE) AS e FROM w)""")
_on_words("wrd04_accept_lift", lambda w: w.select("page", "word_num", D.accept_lift(F.col("word"), F.col("conf"), F.lit("new"), (F.col("left") % 101).cast("double")).alias("b")).select("page", "word_num", "b.word", "b.conf"), """SELECT page, word_num, CASE WHEN "left" % 101 >= conf + 10 THEN 'new' ELSE word END AS word, greatest(conf, CASE WHEN "left" % 101 >= conf + 10 THEN "left" % 101 ELSE 0 END)::DOUBLE AS conf FROM w""")
_again = lambda w: w.select("page", "block", (F.col("word_num") + 3).alias("word_num"), F.concat("word", F.lit("+")).alias("word"), F.col("top").cast("double").alias("conf"))
_on_words("wrd06_replace_slots", lambda w: D.replace_slots(w, _again(w)), """, m AS (SELECT page, block, avg("top") >= avg(conf) + 5 AS taken FROM w GROUP BY page, block) SELECT page, block, word_num, CASE WHEN taken THEN word || '+' ELSE word END AS word, CASE WHEN taken THEN "top"::DOUBLE ELSE conf END AS conf FROM w JOIN m USING (page, block)""")
_add("ocr03_first_tier", lambda s, d: _table(s, d, "orders").select("o_orderkey", D.first_tier(F.when(F.col("o_orderstatus") == "F", "primary"), F.when(F.col("o_orderstatus") == "O", "retry"), F.lit("sparse")).alias("t")).select("o_orderkey", "t.tier", "t.text"), "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS tier, CASE o_orderstatus WHEN 'F' THEN 'primary' WHEN 'O' THEN 'retry' ELSE 'sparse' END AS text FROM orders")
_add("ocr07_timeout", lambda s, d: _table(s, d, "part").select("p_partkey", D.retry_timeout(F.col("p_size") * 8).alias("t")), "SELECT p_partkey, CAST(least(greatest(p_size * 24, 600), 900) AS INT) AS t FROM part")
_over("ocr11_fill_missing", "orders", f"(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'отсутствует' ELSE o_orderpriority END)", lambda c: D.fill_missing(c, F.lit(" new "), (B.MISSING, B.GARBAGE)), "CASE WHEN v IN ('', 'отсутствует', 'неразборчиво') THEN 'new' ELSE v END")
_add("agg24_row_level", lambda s, d: _table(s, d, "orders").select("o_orderkey", D.row_level(F.col("o_totalprice") / 300000, F.concat("o_orderstatus", F.lit("LOW_"))).alias("a"), D.row_level(F.col("o_totalprice") / 300000, F.lit("")).alias("b")), "SELECT o_orderkey, 'WARN' AS a, CASE WHEN o_totalprice / 300000 < 0.5 THEN 'WARN' ELSE 'OK' END AS b FROM orders")
_add("agg10_report", lambda s, d: E.report(_table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("source"), F.when(F.col("o_orderstatus") == "P", "ERROR").otherwise("").alias("note"))), "SELECT count(DISTINCT o_custkey) AS n_files, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS n_failed, count(*) AS n_rows FROM orders")
_fix = lambda s, d: _table(s, d, "lineitem").select(F.col("l_returnflag").alias("field"), F.when(F.col("l_linestatus") == "F", "fix").otherwise("fill").alias("kind"), (F.col("l_quantity") / 50).alias("original_confidence"), "l_orderkey", "l_linenumber")
_add("agg12_feedback_stats", lambda s, d: E.feedback_stats(_fix(s, d)), "SELECT l_returnflag AS field, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS n_fix, count(*) FILTER (l_linestatus <> 'F') AS n_fill, 0::BIGINT AS n_clear, round(sum(l_quantity) / 50 / count(*), 4) AS mean_conf FROM lineitem GROUP BY l_returnflag")
_add("win11_confident_errors", lambda s, d: E.confident_errors(_fix(s, d)).select("l_orderkey", "l_linenumber", "field"), "SELECT l_orderkey, l_linenumber, l_returnflag AS field FROM lineitem WHERE l_linestatus = 'F' AND l_quantity / 50 >= 0.8")
#: Words as one letter each, so that SQL's edit distance of letters is that of words.
_LETTERS = "array_to_string(list_transform(string_split({}, ' '), lambda w: chr(CAST(65 + list_position(ws, w) AS INT))), '')"
_add("agg18_wer", lambda s, d: _table(s, d, "part").select("p_partkey", F.round(E.word_errors(F.concat_ws(" ", "p_name", F.lower("p_type")), F.concat_ws(" ", F.lower("p_type"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")))), 4).alias("wer")), f"""WITH v AS (SELECT list(w ORDER BY w) AS ws FROM (SELECT DISTINCT unnest(string_split(p_name || ' ' || lower(p_type), ' ')) AS w FROM part)), t AS (SELECT p_partkey, ws, p_name || ' ' || lower(p_type) AS a, lower(p_type) || CASE WHEN p_partkey % 3 > 0 THEN ' ' || p_name ELSE '' END AS b FROM part, v)
       SELECT p_partkey, round(levenshtein({_LETTERS.format("a")}, {_LETTERS.format("b")}) / len(string_split(a, ' ')), 4) AS wer FROM t""")
_add("win02_section_ends", lambda s, d: L.section_ends(_table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "role")), "SELECT doc, role, pos, lead(pos) OVER (PARTITION BY doc ORDER BY pos) AS stop FROM (SELECT conv_id AS doc, role, min(turn) AS pos FROM conversations GROUP BY conv_id, role)")
_add("str03_progress", lambda s, d: S.progress(_table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.floor("value").cast("long").alias("current"), F.lit(100).cast("long").alias("total"))), "SELECT user_id AS job, least(100.0, 100.0 * arg_max(floor(value), event_id) / 100)::DOUBLE AS pct FROM events GROUP BY user_id")
_add("str04_move_up", lambda s, d: S.move(_table(s, d, "nation").select(F.col("n_regionkey").alias("queue"), F.col("n_name").alias("job"), F.col("n_nationkey").alias("pos")), "FRANCE", -1), "WITH q AS (SELECT n_regionkey AS queue, n_name AS job, n_nationkey AS pos FROM nation), f AS (SELECT queue, pos FROM q WHERE job = 'FRANCE'), p AS (SELECT q.queue, max(q.pos) AS pos FROM q JOIN f ON q.queue = f.queue AND q.pos < f.pos GROUP BY q.queue) SELECT q.queue, q.job, CAST(CASE WHEN q.pos = f.pos AND p.pos IS NOT NULL THEN p.pos WHEN q.pos = p.pos THEN f.pos ELSE q.pos END AS INT) AS pos FROM q LEFT JOIN f ON q.queue = f.queue LEFT JOIN p ON q.queue = p.queue")
_add("win08_next_pending", lambda s, d: S.next_pending(_table(s, d, "orders").select(F.col("o_custkey").alias("queue"), F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))), "SELECT o_custkey AS queue, min(o_orderkey) AS pos FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey")
_add("str14_worth_storing", lambda s, d: S.worth_storing(_table(s, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_returnflag").alias("text"), (F.col("l_quantity") * 2).alias("conf"))), "SELECT l_orderkey AS job FROM lineitem GROUP BY l_orderkey HAVING avg(l_quantity * 2) >= 50")
_add("str15_signature", lambda s, d: _table(s, d, "orders").select("o_orderkey", P.signature(F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderdate"), "v10").alias("sig")), "SELECT o_orderkey, sha1(o_orderpriority || '|' || o_custkey || '|' || CAST(epoch(o_orderdate) AS BIGINT) || '|v10') AS sig FROM orders")

# --- annotations ----------------------------------------------------------------------------
def _annotated(s: SparkSession, d: str) -> DataFrame:
    """An annotation for each order, its customer the shipper; valid tax numbers come of a rule over its key."""
    o = _table(s, d, "orders").join(_table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    party = F.struct(F.lit("shipper").alias("role"), F.col("c_name").alias("name"), F.concat(F.lit("770708"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0")).alias("inn"))
    cargo = F.struct(F.col("o_orderpriority").alias("description"), F.col("o_custkey").alias("places_count"))
    doc = F.struct(F.lit("TN").alias("type"), F.col("o_orderkey").cast("string").alias("number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.array(party).alias("parties"), cargo.alias("cargo_header"))
    return o.select(F.col("o_orderkey").cast("string").alias("stem"), F.to_json(F.struct(F.array(doc).alias("documents"))).alias("text"))


_ANNOTATED = """o AS (SELECT *, '770708' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS inn FROM orders JOIN customer ON o_custkey = c_custkey),
       ok AS (SELECT *, list_sum(list_transform([2, 4, 10, 3, 5, 9, 4, 6, 8], lambda w, i: w * CAST(inn[i] AS INT))) % 11 % 10 = CAST(inn[10] AS INT) AS good FROM o)"""
_add("src17_identifiers", lambda s, d: A.identifiers(_annotated(s, d)), f"WITH {_ANNOTATED} SELECT DISTINCT 'name' AS kind, c_name AS value FROM ok UNION ALL SELECT DISTINCT 'inn', inn FROM ok WHERE good")
_add("udf13_scalars", lambda s, d: A.scalars(_annotated(s, d)).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values")), """WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)
       SELECT k AS key, count(*) AS n, count(DISTINCT v) AS n_values FROM (SELECT unnest(['type', 'number', 'date', 'role', 'name', 'inn', 'description']) AS k,
       unnest(['TN', CAST(o_orderkey AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'shipper', c_name, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'), o_orderpriority]) AS v FROM o) GROUP BY k""")
_add("udf14_organisations", lambda s, d: A.organisations(_annotated(s, d)).select("inn", "name", "source"), f"WITH {_ANNOTATED} SELECT inn, arg_min(c_name, CAST(o_orderkey AS VARCHAR)) AS name, min(CAST(o_orderkey AS VARCHAR)) AS source FROM ok WHERE good GROUP BY inn")
_add("udf15_expectations", lambda s, d: A.expectations(_annotated(s, d)).select("stem", "field", F.explode("wanted").alias("part", "value")), f"""WITH {_ANNOTATED} SELECT CAST(o_orderkey AS VARCHAR) AS stem, x.f AS field, x.p AS part, x.v AS value FROM (SELECT o_orderkey, unnest([
       {{'f': 'number', 'p': 'value', 'v': CAST(o_orderkey AS VARCHAR)}}, {{'f': 'date', 'p': 'value', 'v': strftime(o_orderdate, '%d.%m.%Y')}}, {{'f': 'shipper', 'p': 'role', 'v': 'shipper'}}, {{'f': 'shipper', 'p': 'name', 'v': c_name}},
       {{'f': 'shipper', 'p': 'inn', 'v': inn}}, {{'f': 'cargo', 'p': 'value', 'v': o_orderpriority}}, {{'f': 'volume', 'p': 'places', 'v': CAST(o_custkey AS VARCHAR)}}]) AS x FROM ok)""")


def _scored(s: SparkSession, d: str) -> DataFrame:
    read = {"number": F.col("o_orderkey").cast("string"), "date": F.date_format("o_orderdate", "dd.MM.yyyy"), "volume": F.concat(F.lit("мест "), F.col("o_custkey").cast("string")), "cargo": F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.col("o_orderpriority"))}
    parsed = _table(s, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(" ocred")).alias("stem"), F.lit(0).alias("row"), *[read.get(f, F.lit(B.MISSING)).alias(f) for f in B.FIELDS])
    return A.totals(A.score(parsed, _annotated(s, d)))


_add("udf16_field_scores", _scored, """WITH o AS (SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey),
       w AS (SELECT regexp_matches(o_orderpriority, '[A-Za-z]{4,}') AS telling, o_orderstatus <> 'F' AS same FROM o),
       c AS (SELECT count(*) AS n, count(*) FILTER (telling AND same) AS good, count(*) FILTER (telling AND NOT same) AS bad, count(*) FILTER (NOT telling) AS vague FROM w)
       SELECT f AS field, CASE WHEN f IN ('number', 'date', 'volume') THEN n WHEN f = 'cargo' THEN good ELSE 0 END AS n_ok, CASE f WHEN 'shipper' THEN n WHEN 'cargo' THEN bad ELSE 0 END AS n_fail,
       CASE WHEN f IN ('number', 'date', 'volume', 'shipper') THEN 0 WHEN f = 'cargo' THEN vague ELSE n END AS n_skip,
       CASE WHEN f IN ('number', 'date', 'volume') THEN 100 WHEN f = 'shipper' THEN 0 WHEN f = 'cargo' THEN CAST(floor(good * 100 / (good + bad)) AS BIGINT) END::BIGINT AS percent
       FROM c, (SELECT unnest(['number', 'date', 'shipper', 'consignee', 'cargo', 'volume', 'driver', 'vehicle', 'reception']) AS f)""")
_stem = "(p_name || CASE p_partkey % 6 WHEN 0 THEN ' ocred' WHEN 1 THEN '-выход' WHEN 2 THEN '_ocred' WHEN 3 THEN '_выход' WHEN 4 THEN ' ocred b' ELSE '' END)"
_over("msc10_base_name", "part", _stem, A.base_name, "regexp_replace(v, '( ocred|-ocred|_ocred|-выход|_выход)$', '')")
_over("src13_reading_rank", "part", _stem, A.reading_rank, "CASE WHEN regexp_matches(v, '[ _-]ocred$') THEN 0 WHEN regexp_matches(v, '[_-]выход$') THEN 1 ELSE 2 END")
_over("jn13_plain_name", "part", f"('«' || {_CYRILLIC.format('p_name')} || '-З', ООО (' || p_type || ')')".replace("-З',", "-З»,"), A.plain_name, "regexp_replace(translate(lower(v), 'ёзоеархсукмтвн', 'e30eapxcykmtbh'), '[ ,.«»()-]', '', 'g')")

# --- reports, jobs, cached results -----------------------------------------------------------
_add("agg01_overall", lambda s, d: _table(s, d, "lineitem").select("l_orderkey", "l_linenumber", P.overall([F.col("l_linenumber") * k % 21 / 20 for k in range(1, 10)]).alias("overall")), "SELECT l_orderkey, l_linenumber, round(list_sum(list_transform(range(1, 10), lambda k: l_linenumber * k % 21 / 20)) / 9, 2) AS overall FROM lineitem")
_add("agg03_document_overall", lambda s, d: P.document_overall(_table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_quantity").alias("overall"))), "SELECT l_orderkey AS doc, round_even(avg(l_quantity), 3) AS overall FROM lineitem GROUP BY l_orderkey")
_add("agg13_by_field", lambda s, d: P.by_field(_fix(s, d)), "SELECT l_returnflag AS field, count(*) AS n FROM lineitem GROUP BY l_returnflag")
_add("agg23_problem_fields", lambda s, d: _table(s, d, "orders").select("o_orderkey", F.array_join(P.problem_fields({"a": F.col("o_totalprice") / 300000, "b": F.lit(1.0)}, {"a": F.lit(""), "b": F.when(F.col("o_orderstatus") == "P", B.MISSING).otherwise("x")}), ",").alias("bad")), "SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice / 300000 < 0.5 THEN 'a' END, CASE WHEN o_orderstatus = 'P' THEN 'b' END) AS bad FROM orders")
_add("snk08_report_lines", lambda s, d: _table(s, d, "orders").select("o_orderkey", P.report_line(F.col("o_orderkey").cast("string"), F.lit(0.75), F.when(F.col("o_orderstatus") == "P", "ERROR: x").otherwise(""), F.lit("w"), F.lit("d"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))).alias("line")), "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '[ERR ]' ELSE '[OK  ]' END || '  75% | ' || o_orderkey || chr(10) || CASE o_orderstatus WHEN 'P' THEN '       └─ ERROR: x' WHEN 'F' THEN '       ├─ w от d' || chr(10) || '       └─ Проверить: a, b' ELSE '       ├─ w от d' || chr(10) || '       └─ Все поля распознаны.' END AS line FROM orders")
_add("win04_numbering", lambda s, d: P.numbered(_table(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"), "l_returnflag"), F.col("l_returnflag") == "A").select("source"), "SELECT CASE WHEN n > 1 THEN s || '#' || k ELSE s END AS source FROM (SELECT CAST(l_orderkey AS VARCHAR) AS s, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE l_returnflag = 'A'")
_add("win07_margin", lambda s, d: P.margin(_table(s, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice"), "SELECT o_custkey, max(CASE WHEN k = 1 THEN o_orderkey END) AS o_orderkey, max(CASE WHEN k = 1 THEN o_totalprice END) AS o_totalprice, max(CASE WHEN k = 1 THEN o_totalprice END) - max(CASE WHEN k = 2 THEN o_totalprice END) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) GROUP BY o_custkey")
_add("win10_first_pages", lambda s, d: L.first_pages(_table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page")), 2), "SELECT conv_id AS doc, turn AS page FROM conversations WHERE turn <= 2")
_over("set06_form_dates", "orders", "(CASE o_orderkey % 3 WHEN 0 THEN '21.12.2020' WHEN 1 THEN '11.12.2023' ELSE '12.12.2020' END)", L.own_date, "CASE WHEN v NOT IN ('30.11.2021', '21.12.2020', '26.12.2011', '02.04.2021', '02.04.2024', '11.12.2023') THEN v END")
_add("src22_corpus_pairs", lambda s, d: P.paired(_table(s, d, "orders").select(F.col("o_custkey").alias("stem"), "o_orderkey"), _table(s, d, "customer").select(F.col("c_custkey").alias("stem"), "c_name"))[0], "SELECT o_custkey AS stem, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
_add("jn11_merged_maps", lambda s, d: _table(s, d, "orders").select("o_orderkey", F.array_join(F.map_values(P.merged_maps(F.create_map(F.lit("a"), F.col("o_orderstatus")), F.create_map(F.lit("a"), F.lit("z"), F.lit("b"), F.col("o_orderpriority")))), "|").alias("v")), "SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS v FROM orders")
_add("msc04_languages", lambda s, d: _table(s, d, "orders").select("o_orderkey", P.languages(F.col("o_orderstatus"), F.array(F.lit("O"), F.lit("F"))).alias("langs")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'O+F' WHEN 'F' THEN 'F+O' ELSE o_orderstatus || '+O+F' END AS langs FROM orders")
_wish = lambda: F.when(F.col("event_type") == "click", "pause").when(F.col("event_type") == "view", "resume").when(F.col("event_type") == "error", "cancel").otherwise("none")
_add("msc17_set_status", lambda s, d: P.set_status(_table(s, d, "customer").select(F.col("c_custkey").alias("job"), F.lit("running").alias("status")), _table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), _wish().alias("wish"))), "SELECT c_custkey AS job, CASE e WHEN 'click' THEN 'paused' WHEN 'view' THEN 'pending' WHEN 'error' THEN 'cancelled' ELSE 'running' END AS status FROM customer LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS e FROM events GROUP BY 1) ON user_id = c_custkey")
_add("str12_cache_lookup", lambda s, d: P.cache_lookup(_table(s, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_custkey").cast("string").alias("key")), _table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("result"))), "SELECT o_orderkey AS job, CAST(o_custkey AS VARCHAR) AS key, c_name AS result FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
_add("msc15_unique_names", lambda s, d: P.unique_names(_table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lower("c_mktsegment"), F.lit(".pdf")).alias("path")), _table(s, d, "nation").select(F.concat(F.lit("building ("), F.col("n_nationkey").cast("string"), F.lit(").pdf")).alias("path"))), """WITH u AS (SELECT CASE n_nationkey WHEN 0 THEN NULL ELSE n_nationkey END AS n FROM nation), a AS (SELECT c_custkey AS id, lower(c_mktsegment) AS r, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer)
       SELECT id, r || '.pdf' AS path, CASE WHEN k = 0 THEN r || '.pdf' WHEN r = 'building' THEN r || ' (' || (k + (SELECT max(n) FROM u)) || ').pdf' ELSE r || ' (' || k || ').pdf' END AS name FROM a""")



def queries() -> dict[str, Query]:
    from pagelathe.plans import catalog_more, catalog_pages  # noqa: F401  they add their queries here

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
