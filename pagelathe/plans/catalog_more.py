"""More queries of the library's operators, in the manner of ``catalog``: snapshots, sinks, word chains, engines, queues, layout, images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.functions import repair as R
from pagelathe.functions import text as T
from pagelathe.functions import validators as V
from pagelathe.operators import annotations as A
from pagelathe.operators import decisions as D
from pagelathe.operators import forms as X
from pagelathe.operators import images as I
from pagelathe.operators import layout, positions, snapshots
from pagelathe.operators import lookups as L
from pagelathe.operators import reports as P
from pagelathe.operators import waybills as B
from pagelathe.operators import words as W
from pagelathe.plans import catalog as C
from pagelathe.plans import postprocess
from pagelathe.sources import files, office
from pagelathe.streaming import queue as S

_add, _table, _on_text, _on_words, _over = C._add, C._table, C._on_text, C._on_words, C._over
_FORMULA, _NO = C._FIELD_SQL, C._NO
_SOURCE = "CAST(o_orderkey AS VARCHAR) AS source"
_RU = C._CYRILLIC.format("text")


def _parsed(s: SparkSession, d: str) -> DataFrame:
    return B.parse(C._waybills(s, d), "2024-06-01")


# --- postprocessing ----------------------------------------------------------------------------
_LOOSE = C._loose
_GARBAGE = rf"CASE WHEN X = '' THEN X ELSE array_to_string(list_filter(string_split(regexp_replace(X, '\n$', ''), chr(10)), lambda x: NOT {_LOOSE}), chr(10)) END"
_HYPHEN = r"regexp_replace(X, '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g')"
_SPACES = C._ws.replace("text", "X")
_ARTIFACTS = r"array_to_string(list_filter(string_split(X, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR regexp_matches(x, '[\p{L}\p{N}]')), chr(10))"
_RULES = (R.Rule("the", "THE", is_regex=False), R.Rule("([0-9]+)-([0-9]+)", r"\2-\1"), R.Rule("(", "x"), R.Rule("e", "", enabled=False))
_RULED = r"regexp_replace(replace(X, 'the', 'THE'), '([0-9]+)-([0-9]+)', '\2-\1', 'g')"
_APART = "replace(replace(text, 'é', 'é'), 'ö', 'ö')"
_over("pst02_unicode", "documents", _APART, postprocess.compose, "nfc_normalize(v)")
_PLAIN = postprocess.Settings(look_alikes=False, russian=False, english=False, rules=_RULES)
_steps = lambda start: reduce(lambda x, s: s.replace("X", x), (f"nfc_normalize({start})", _HYPHEN, _SPACES, _ARTIFACTS, _GARBAGE, _RULED))
_add("pst01_process", lambda s, d: postprocess.process(_table(s, d, "documents").selectExpr("doc_id", f"{_APART} AS text"), _PLAIN), f"SELECT doc_id, {_steps('v')} AS text FROM (SELECT doc_id, {_APART} AS v FROM documents)")
_add("pst16_universal", lambda s, d: postprocess.universal(_table(s, d, "documents").select("doc_id", "text"), catalog=_table(s, d, "orders").selectExpr("CAST(7700000000 + o_custkey * 7919 AS STRING) AS value")))
_add("udf02_limited_rules", lambda s, d: _table(s, d, "documents").select("doc_id", postprocess.limited_rules(F.col("text"), _RULES).alias("out")), f"SELECT doc_id, {_RULED.replace('X', 'text')} AS out FROM documents")
_add("val22_broken_rules", lambda s, d: s.createDataFrame(sorted(postprocess.broken_rules(list(_RULES)).items()), "pattern string, reason string").join(_table(s, d, "region").limit(1)).select("pattern", (F.length("reason") > 0).alias("told")), "SELECT '(' AS pattern, true AS told")
_over("pst15_rules_of_any_case", "part", "(p_name || ' ' || p_type)", lambda c: R.apply_rules(c, [R.Rule("promo", "x", case_sensitive=False), R.Rule("[a-c]+", "_")]), "regexp_replace(regexp_replace(v, 'promo', 'x', 'gi'), '[a-c]+', '_', 'g')")
_over("pst17_mark_low_words", "part", "(p_name || ' ' || lower(p_type) || ' ' || p_name)", lambda c: R.mark_low_words(c, F.array(F.split_part("v", F.lit(" "), F.lit(1)), F.lit("promo"))), r"regexp_replace(v, '\b(' || split_part(v, ' ', 1) || '|promo)\b', '[?\1?]', 'g')")
_TAKEN = "CAST(7700000000 + o_custkey * 7919 AS STRING)"
_add("pst13_identifiers", lambda s, d: L.fix_identifiers(_table(s, d, "orders").selectExpr("o_orderkey AS doc_id", f"'ИНН ' || {_TAKEN} || ' и ' || CAST(o_orderkey AS STRING) AS text"), _table(s, d, "customer").selectExpr("CAST(7700000000 + c_custkey * 7919 AS STRING) AS value"), "doc_id"), f"SELECT o_orderkey AS doc_id, 'ИНН ' || {_TAKEN} || ' и ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders")
_tok_sql = C._tok
_over("nrm09_strip_garbage_tokens", "part", f"({C._MIX} || ' ' || p_name || ' іі ' || p_brand)", R.strip_garbage_tokens, rf"array_to_string(list_filter(string_split_regex(trim(v), ' +'), lambda x: NOT ({_tok_sql.replace('X', 'x')})), ' ')")
_on_text("flt04_filter_disabled", lambda c: T.filter_garbage_lines(c, "disabled"), "text")
_over("flt07_ruler", "part", "(CASE p_partkey % 4 WHEN 0 THEN repeat('- ', p_size) WHEN 1 THEN repeat('=', p_size) WHEN 2 THEN p_name ELSE '~' || repeat('*', p_size % 4) END)", T.is_ruler, r"regexp_matches(regexp_replace(v, '\s+', '', 'g'), '^[-=_*~`.•·]{3,}$')")
_noise_text = "(CASE p_partkey % 5 WHEN 0 THEN '[ ] | \\\\ /' WHEN 1 THEN 'а б в г' WHEN 2 THEN '' WHEN 3 THEN p_name || ' 12.12.2020' ELSE p_type END)"
_over("flt11_noisy", "part", _noise_text, R.looks_noisy, "p_partkey % 5 IN (0, 1, 2)")
_SERVICE = "(CASE o_orderkey % 5 WHEN 0 THEN 'является экспедитором' WHEN 1 THEN '(' || o_orderpriority || ')' WHEN 2 THEN 'ООО Склад ' || o_orderpriority WHEN 3 THEN 'реквизиты документа' ELSE '---' END)"
_add("flt10_value_lines", lambda s, d: B.lines_of_value(_table(s, d, "orders").selectExpr("o_orderkey AS source", f"{_SERVICE} AS text")), "SELECT CAST(o_orderkey AS VARCHAR) AS source, 1::INT AS place, 'ООО Склад ' || o_orderpriority AS line FROM orders WHERE o_orderkey % 5 = 2")
_add("flt13_low_rows", lambda s, d: D.low_rows(_table(s, d, "orders").selectExpr("o_orderkey", "o_totalprice / 300000 AS overall")).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_totalprice / 300000 < 0.4")
_over("val12_fix_ogrn", "customer", "(CASE WHEN c_custkey % 2 = 0 THEN '10277001' ELSE '10277001' END || lpad(CAST(c_custkey AS STRING), 5, '0') || CASE WHEN c_custkey % 3 = 0 THEN '7' ELSE '' END)", lambda c: V.fix_ogrn(c).isNull() | V.is_ogrn(V.fix_ogrn(c)), "true")

# --- rows as JSON, sheets, snapshots --------------------------------------------------------------
_all = ", ".join(f"{_FORMULA[f]} AS {f}" for f in X.FIELDS)
_confs = ", ".join(f"{_FORMULA[f'{f}_conf']} AS {f}_conf" for f in X.FIELDS)
_overall = f"round(({C._conf_sum}) / 9, 2)"
_label = f"'Транспортная накладная' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' № ' || {C._S} || '/К' END"
_struct = ", ".join(f"'{f}': {_FORMULA[f]}" for f in X.FIELDS)
_conf_struct = ", ".join(f"'{f}': {_FORMULA[f'{f}_conf']}" for f in X.FIELDS)
_add("udf08_rows_to_json", lambda s, d: snapshots.to_json(_parsed(s, d)), f"SELECT {_SOURCE}, CAST(to_json({{'source': CAST(o_orderkey AS VARCHAR), 'waybill': {_label}, 'note': '', {_struct}, 'confidence': {{{_conf_struct}}}, 'overall_confidence': {_overall}}}) AS VARCHAR) AS json FROM orders")
_add("udf09_rows_from_json", lambda s, d: snapshots.from_json(snapshots.to_json(_parsed(s, d))), f"SELECT {_SOURCE}, {_label} AS waybill, '' AS note, {_overall} AS overall, {_all}, {_confs} FROM orders")
_add("udf10_sheet", lambda s, d: snapshots.sheet(_parsed(s, d)), f"SELECT {_label} AS waybill, {_all}, {_SOURCE}, '' AS note FROM orders")
_add("udf11_snapshot_rows", lambda s, d: snapshots.snapshot(_parsed(s, d)).drop("generated_at"), f"SELECT 1::INT AS schema_version, {_SOURCE}, {_all}, {_confs}, {_overall} AS overall_confidence, {_label} AS waybill, '' AS note FROM orders")
_add("msc02_missing_rows", lambda s, d: snapshots.missing(_table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("source")), "LOW_TEXT").select("source", "waybill", "note", "overall", "number", "number_conf"), f"SELECT {_SOURCE}, 'Транспортная накладная' AS waybill, 'LOW_TEXT' AS note, 0.0::DOUBLE AS overall, {_NO} AS number, 0.0::DOUBLE AS number_conf FROM orders")


def _snapshot(s: SparkSession, d: str) -> DataFrame:
    path = f"{S.shared_folder(s)}/rows.snapshot.json"
    snapshots.save_snapshot(_parsed(s, d), path)
    return snapshots.load_snapshot(s, path).select("schema_version", "source", "number", "number_conf", "overall_confidence", "note")


_SNAPSHOT_SQL = f"SELECT 1::INT AS schema_version, {_SOURCE}, {_FORMULA['number']} AS number, {_FORMULA['number_conf']} AS number_conf, {_overall} AS overall_confidence, '' AS note FROM orders"
_add("snk10_save_and_load_snapshot", _snapshot, _SNAPSHOT_SQL)
_add("src16_no_snapshot", lambda s, d: _table(s, d, "region").select("r_regionkey", F.lit(snapshots.load_snapshot(s, f"{S.shared_folder(s)}/none.json") is None).alias("none")), "SELECT r_regionkey, true AS none FROM region")


def _sheet_beside(s: SparkSession, d: str) -> DataFrame:
    """The path is taken, so the sheet goes beside it, and its snapshot with it."""
    path = f"{S.shared_folder(s)}/sheet"
    write = lambda df, p: df.write.mode("errorifexists").option("header", True).csv(p)
    _table(s, d, "region").write.csv(path)
    taken = snapshots.write_sheet_safe(_parsed(s, d), write, path)
    rows = s.read.option("header", True).csv(taken).select("source", "date")
    held = snapshots.load_snapshot(s, f"{taken}.snapshot.json").select("source", F.col("date").alias("held"))
    return rows.join(held, "source").withColumn("moved", F.lit(taken != path))


_add("snk07_sheet_beside", _sheet_beside, f"SELECT {_SOURCE}, {_FORMULA['date']} AS date, {_FORMULA['date']} AS held, true AS moved FROM orders")


def _log(s: SparkSession, d: str) -> DataFrame:
    path = snapshots.write_log_safe(_table(s, d, "nation").selectExpr("n_nationkey AS pos", "n_name AS line"), f"{S.shared_folder(s)}/run.log")
    return s.read.text(path).select(F.col("value").alias("line"))


_add("snk09_log", _log, "SELECT n_name AS line FROM nation")


def _cells(s: SparkSession, d: str) -> DataFrame:
    path = f"{S.shared_folder(s)}/cells.csv"
    snapshots.write_csv(_table(s, d, "part").selectExpr("p_name AS document", "p_brand AS profile", "p_size AS dpi", "p_retailprice AS cer", "0.5D AS wer", "p_partkey AS mean_conf", "1.5D AS elapsed_sec", "'a,b' AS error"), path)
    return s.read.option("header", True).csv(path).selectExpr("document", "profile", "CAST(dpi AS INT) AS dpi", "CAST(cer AS DOUBLE) AS cer", "CAST(mean_conf AS BIGINT) AS mean_conf", "error")


_add("snk12_csv", _cells, "SELECT p_name AS document, p_brand AS profile, p_size AS dpi, p_retailprice AS cer, p_partkey AS mean_conf, 'a,b' AS error FROM part")


def _autosaved(s: SparkSession, d: str) -> DataFrame:
    folder = S.shared_folder(s)
    schema = _table(s, d, "conversations").schema
    stream = s.readStream.schema(schema).parquet(C._as_found(d, "conversations")).select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text", F.lit(None).cast("string").alias("error"))
    S.autosave(stream, f"{folder}/pages", f"{folder}/state").awaitTermination()
    return files.export_text(s.read.schema("doc long, page long, text string, error string").json(f"{folder}/pages"))


_add("snk13_autosaved_pages", _autosaved, C._SQL["snk02_export_text"])


# --- files of every kind, written and read again ---------------------------------------------------
def _text_files(s: SparkSession, d: str) -> str:
    folder = f"{S.shared_folder(s)}/texts"
    _table(s, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return folder


_add("src12_whole_texts", lambda s, d: files.texts(s, _text_files(s, d)).select(F.trim(F.regexp_replace("text", "\\n", " ")).alias("text")), "SELECT n_name AS text FROM nation")
_add("src19_word_list", lambda s, d: files.word_list(s, _text_files(s, d)), "SELECT n_name AS word FROM nation")


def _correction_log(s: SparkSession, d: str) -> DataFrame:
    path = f"{S.shared_folder(s)}/log"
    row = "CAST(o_orderkey AS STRING) AS source, 'date' AS field, o_orderstatus AS original, o_orderpriority AS corrected, o_totalprice AS original_confidence, 'fix' AS kind, '' AS timestamp, CAST(o_custkey AS INT) AS excel_row, '' AS context".split(", ")
    for part in (0, 1):
        files.append_corrections(_table(s, d, "orders").where(F.col("o_orderkey") % 2 == part).selectExpr(*row), path)
    return files.corrections(s, path).select("source", "field", "original", "corrected", "original_confidence", "excel_row")


_add("src15_correction_log", _correction_log, f"SELECT {_SOURCE}, 'date' AS field, o_orderstatus AS original, o_orderpriority AS corrected, o_totalprice AS original_confidence, CAST(o_custkey AS INT) AS excel_row FROM orders")


def _workbooks(s: SparkSession, d: str) -> DataFrame:
    folder = f"{S.shared_folder(s)}/books"
    office.write_xlsx(_table(s, d, "part").selectExpr("p_brand", "CAST(p_partkey AS STRING) AS key", "p_name AS name"), "p_brand", ["key", "name"], folder).count()
    return office.read_workbooks(s, folder).where("row > 0").select(F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


_add("src14_workbooks", _workbooks, "SELECT CAST(p_partkey AS VARCHAR) AS key, p_name AS name FROM part")


def _documents(s: SparkSession, d: str) -> DataFrame:
    folder = f"{S.shared_folder(s)}/documents"
    pages = _table(s, d, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("page"), F.col("n_name").alias("text"), F.array().cast("array<string>").alias("low_words"))
    office.write_docx(pages, folder).count()
    return office.read_documents(s, folder).select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).alias("doc"), F.regexp_extract("line", r"(NATION_\d+)", 1).alias("line")).where("line <> ''")


_add("snk03_documents", _documents, "SELECT CAST(n_regionkey AS VARCHAR) AS doc, n_name AS line FROM nation")
_add("src06_best_text", lambda s, d: _table(s, d, "part").select("p_partkey", files.best_text(F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")), F.col("p_type"), F.col("p_brand")).alias("text")), r"SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN CASE WHEN p_partkey % 3 > 0 THEN p_name END WHEN b >= c THEN p_type ELSE p_brand END AS text FROM (SELECT *, length(regexp_replace(CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE '' END, '[^a-zA-Z0-9]', '', 'g')) AS a, length(regexp_replace(p_type, '[^a-zA-Z0-9]', '', 'g')) AS b, length(regexp_replace(p_brand, '[^a-zA-Z0-9]', '', 'g')) AS c FROM part)")
_add("snk01_pages_as_one_text", lambda s, d: files.export_text(_table(s, d, "nation").select(F.col("n_regionkey").alias("doc"), F.col("n_nationkey").alias("page"), F.col("n_name").alias("text"), F.when(F.col("n_nationkey") == 3, "lost").alias("error"))), r"SELECT n_regionkey AS doc, regexp_replace(string_agg('--- Page ' || n_nationkey || ' ---' || chr(10) || chr(10) || CASE WHEN n_nationkey = 3 THEN '[ERROR: lost]' ELSE n_name END || chr(10), chr(10) ORDER BY n_nationkey), '\s+$', '') || chr(10) AS text FROM nation GROUP BY n_regionkey")

# --- tables that belong together by place -----------------------------------------------------------
_PAGES = "SELECT DISTINCT l_orderkey AS doc, l_linenumber AS page FROM lineitem"


def _pages(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct()


_sized = lambda s, d: positions.scales(positions.aligned(_table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")), _pages(s, d).selectExpr("doc", "page", "1000 + page AS image_width", "2000 AS image_height"), _pages(s, d).selectExpr("doc", "page", "500D AS page_width", "800D AS page_height")))
_add("jn08_pages_with_images", lambda s, d: positions.with_images(_pages(s, d), _pages(s, d).where("page % 3 > 0").select("doc", "page", F.concat(F.lit("img"), F.col("page").cast("string")).alias("image"))), f"SELECT doc, page, CASE WHEN page % 3 > 0 THEN 'img' || page END AS image FROM ({_PAGES})")
_add("jn09_aligned_pages", lambda s, d: _sized(s, d).select("doc", "page", "n_words"), "SELECT l_orderkey AS doc, l_linenumber AS page, count(*) AS n_words FROM lineitem GROUP BY 1, 2")
_add("wrd11_scales", lambda s, d: positions.page_boxes(_pages(s, d).selectExpr("doc", "page", "10D AS x0", "20D AS y0", "110D AS x1", "60D AS y1"), _sized(s, d)), f"SELECT doc, page, 10 * 500 / (1000 + page) AS x0, 8.0::DOUBLE AS y0, 110 * 500 / (1000 + page) AS x1, 24.0::DOUBLE AS y1 FROM ({_PAGES})")
_add("jn12_input_order", lambda s, d: positions.in_order(_table(s, d, "orders").select("o_custkey", "o_orderkey"), _table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (-F.col("c_custkey")).alias("pos")), "o_custkey"), "SELECT o_custkey, -c_custkey AS pos, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey")
_add("snk14_points", lambda s, d: _table(s, d, "part").select("p_partkey", positions.points(F.col("p_size"), F.lit(300)).alias("pt")), "SELECT p_partkey, p_size * 72.0 / 300 AS pt FROM part")
_add("snk15_redactions_in_points", lambda s, d: positions.page_boxes(W.redactions(C._words(s, d), 60, 1.0).selectExpr("1 AS doc", "page", "x0", "y0", "x1", "y1", "kind"), _table(s, d, "orders").selectExpr("1 AS doc", "o_orderkey AS page", "0.5D AS scale_x", "0.25D AS scale_y")).where("kind = 'word'").drop("doc"), f"WITH w AS ({C._WORDS}) SELECT page, \"left\" * 0.5::DOUBLE AS x0, \"top\" * 0.25::DOUBLE AS y0, (\"left\" + width) * 0.5::DOUBLE AS x1, (\"top\" + height) * 0.25::DOUBLE AS y1, 'word' AS kind FROM w JOIN orders ON page = o_orderkey WHERE conf < 60")

# --- word table ---------------------------------------------------------------------------------------
_on_words("agg19_block_confidence", W.block_confidence, "SELECT page, block, avg(conf) AS mean_conf, count(*) AS n_words FROM w GROUP BY page, block")
_on_words("msc13_rescored_pages", lambda w: W.rescored(w, 60), "SELECT page, count(*) AS n_all, count(*) FILTER (conf >= 60) AS n_kept, avg(conf) AS mean_all, coalesce(avg(conf) FILTER (conf >= 60), 0) AS mean_kept FROM w GROUP BY page")
_on_words("flt18_image_rescuable", lambda w: w.where(W.image_rescuable(F.col("word"), F.col("conf"))).select("page", "word_num", "word"), "SELECT page, word_num, word FROM w WHERE conf BETWEEN 30 AND 70 AND length(word) >= 2")
_on_words("wrd05_upscale_rescue", lambda w: W.upscale_rescue(w, w.where("word_num % 2 = 0").select("page", "word_num", F.lit("new").alias("new"), F.col("left").cast("double").alias("new_conf")).groupBy("page", "word_num", "new").agg(F.max("new_conf").alias("new_conf"))).select("page", "word_num", "word", "conf"), ', a AS (SELECT page, word_num, max("left")::DOUBLE AS new_conf FROM w WHERE word_num % 2 = 0 GROUP BY 1, 2) SELECT w.page, w.word_num, CASE WHEN conf < 80 AND new_conf >= conf + 10 THEN \'new\' ELSE word END AS word, CASE WHEN conf < 80 AND new_conf >= conf + 10 THEN new_conf ELSE conf END AS conf FROM w LEFT JOIN a ON w.page = a.page AND w.word_num = a.word_num')
_entries = lambda s, d: _table(s, d, "lineitem").select(F.lower(F.concat("l_returnflag", "l_linestatus", F.lit("1"))).alias("entry")).distinct().withColumn("pos", F.ascii("entry"))
_ENTRIES = "e AS (SELECT DISTINCT lower(l_returnflag || l_linestatus) || '1' AS entry FROM lineitem)"
_add("msc06_contains", lambda s, d: W.contains(C._words(s, d), _entries(s, d)).select("page", "word_num", "word"), f"WITH w AS ({C._WORDS}), {_ENTRIES} SELECT page, word_num, word FROM w WHERE lower(word) IN (SELECT entry FROM e)")
_RESCUED = f"""w AS ({C._WORDS}), {_ENTRIES}, t AS (SELECT DISTINCT word FROM w WHERE conf BETWEEN 30 AND 75 AND length(word) >= 3 AND regexp_matches(word, '[A-Za-z]')),
    m AS (SELECT word, CASE WHEN lower(word) IN (SELECT entry FROM e) THEN word ELSE (SELECT entry FROM e WHERE levenshtein(word, entry) <= 1 ORDER BY levenshtein(word, entry), length(entry), ascii(entry), entry LIMIT 1) END AS match FROM t),
    r AS (SELECT w.* EXCLUDE (word, conf), CASE WHEN match IS NOT NULL AND conf BETWEEN 30 AND 75 THEN match ELSE w.word END AS word, CASE WHEN match IS NOT NULL AND conf BETWEEN 30 AND 75 THEN greatest(conf, 85) ELSE conf END AS conf FROM w LEFT JOIN m ON w.word = m.word)"""
_add("wrd08_dictionary_rescue", lambda s, d: W.dictionary_rescue(C._words(s, d), _entries(s, d)).select("page", "word_num", "word", "conf"), f"WITH {_RESCUED} SELECT page, word_num, word, conf FROM r")
_add("wrd01_chain", lambda s, d: W.chain(C._words(s, d), dictionary=_entries(s, d))["pages"].select("page", "mean_conf", "n_words", "threshold", "text"), f"""WITH {_RESCUED}, p AS (SELECT page, avg(conf) AS mean_conf, count(*) AS n_words, CAST(CASE WHEN avg(conf) >= 90 THEN 40 WHEN avg(conf) < 70 THEN 70 ELSE 60 END AS DOUBLE) AS threshold FROM r GROUP BY page),
    l AS (SELECT r.page, block, par, line, string_agg(word, ' ' ORDER BY word_num, word) AS t FROM r JOIN p ON r.page = p.page WHERE conf >= threshold GROUP BY r.page, block, par, line)
    SELECT p.*, t.text FROM p LEFT JOIN (SELECT page, string_agg(t, chr(10) ORDER BY block, par, line) AS text FROM l GROUP BY page) t ON t.page = p.page""")
_on_words("flt22_overlay", lambda w: W.overlay(w, 60).select("page", "word_num", "left", "red", "green", "blue"), 'SELECT page, word_num, "left", CAST(floor(239 * (1 - conf / 100) + 34 * (conf / 100)) AS INT) AS red, CAST(floor(68 * (1 - conf / 100) + 197 * (conf / 100)) AS INT) AS green, CAST(floor(68 * (1 - conf / 100) + 94 * (conf / 100)) AS INT) AS blue FROM w WHERE conf >= 60')

# --- engines and jobs -----------------------------------------------------------------------------------
_turns = lambda s, d: _table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(F.col("role") == "user", F.col("text")).otherwise(" ").alias("text"))
_TURNS = "SELECT conv_id AS doc, turn AS page, CASE WHEN role = 'user' THEN text ELSE ' ' END AS text FROM conversations"
_add("ocr04_documents_have_text", lambda s, d: D.documents_have_text(_turns(s, d)), f"SELECT doc, bool_or(trim(coalesce(text, '')) <> '') AS has_text FROM ({_TURNS}) GROUP BY doc")
_add("ocr05_page_workers", lambda s, d: _table(s, d, "part").select("p_partkey", D.page_workers(F.col("p_size"), F.lit(16), F.when(F.col("p_partkey") % 3 > 0, F.col("p_partkey") * 40)).alias("n")), "SELECT p_partkey, CAST(greatest(1, least(greatest(p_size, 1), 16, 10, coalesce(greatest(1, floor(CASE WHEN p_partkey % 3 > 0 THEN p_partkey * 40 END / 500)), 10))) AS INT) AS n FROM part")
_add("ocr06_narrowed_languages", lambda s, d: _table(s, d, "part").select("p_partkey", F.array_join(D.narrowed_languages(F.array(F.lit("rus"), F.lit("eng")), F.when(F.col("p_size") < 20, "rus").when(F.col("p_size") < 30, "deu")), "+").alias("langs")), "SELECT p_partkey, CASE WHEN p_size < 20 THEN 'rus' ELSE 'rus+eng' END AS langs FROM part")
_params = lambda: F.create_map(F.lit("a_b"), F.col("p_name"), F.lit("1x"), F.lit("y"), F.lit("c"), F.when(F.col("p_size") < 20, F.lit("1\n2")).otherwise(F.col("p_brand")))
_add("ocr08_config_lines", lambda s, d: _table(s, d, "part").select("p_partkey", D.config_lines(_params()).alias("lines")), "SELECT p_partkey, 'a_b ' || p_name || chr(10) || CASE WHEN p_size < 20 THEN '' ELSE 'c ' || p_brand || chr(10) END AS lines FROM part")
_add("ocr09_engine_options", lambda s, d: D.engine_options(_table(s, d, "part").select(F.col("p_name").alias("input"), F.col("p_brand").alias("output"), F.array(F.lit("rus"), F.lit("eng")).alias("languages"), F.lit(1).alias("oem"), F.col("p_size").alias("psm"), F.lit(0).alias("optimize"), F.lit(True).alias("skip_text"), F.lit(180).alias("timeout"), F.lit("").alias("whitelist"), F.lit("").alias("blacklist"), _params().alias("params"))).select("input", "output", "language", "psm", "timeout", "skip_text"), "SELECT p_name AS input, p_brand AS output, 'rus+eng' AS language, p_size AS psm, 180.0::DOUBLE AS timeout, true AS skip_text FROM part")
_add("ocr10_bypassed_pages", lambda s, d: D.bypassed(_table(s, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")).select("doc", "page", "mean_conf"), r"SELECT conv_id AS doc, turn AS page, 100.0::DOUBLE AS mean_conf FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING bool_and(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 50 AND len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]{2,}')) >= 3))")
_over("msc23_crop_config", "part", "(CASE WHEN p_partkey % 2 = 0 THEN '--oem 1 --psm ' || CAST(p_size AS STRING) ELSE '--oem 1' END || ' -l ' || p_name)", D.crop_config, "'--oem 1 -l ' || substr(v, strpos(v, ' -l ') + 4) || ' --psm 6'")
_cached = lambda: F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("c_name").alias("text"), F.col("c_acctbal").alias("mean_conf"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("double").alias("skew"), F.lit(None).cast("string").alias("error")), F.struct(F.lit(7).alias("page"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("mean_conf"), F.lit(1.0).alias("seconds"), F.lit(None).cast("double").alias("skew"), F.lit("x").alias("error")))
_add("msc24_cached_pages", lambda s, d: D.cached_pages(_table(s, d, "orders").selectExpr("o_orderkey AS job", "o_custkey AS key"), _table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), _cached().alias("pages"))), "WITH j AS (SELECT o_orderkey AS job, c_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 2 = 0) SELECT job, 1::INT AS page, c_name AS text, c_acctbal AS mean_conf, 0.0::DOUBLE AS seconds, 0.0::DOUBLE AS skew, NULL::VARCHAR AS error FROM j UNION ALL SELECT job, 7, '', 0.0, 1.0, 0.0, 'x' FROM j")
_add("msc25_advice", lambda s, d: _table(s, d, "part").select("p_partkey", D.advice(F.col("p_size") * 2, F.lit(3), F.col("p_partkey") % 4).alias("out")), "SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'error' WHEN p_size * 2 > 0 AND p_size * 2 < 60 THEN 'other profile' ELSE 'ok' END AS out FROM part")
_add("agg22_percent", lambda s, d: _table(s, d, "part").select("p_partkey", D.percent(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 40), F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit(0.5), F.lit(0.25))).otherwise(F.array().cast("array<double>"))).alias("pct")), "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN least(100, round_even(p_size / 40 * 100, 0)) WHEN 1 THEN 38 ELSE 0 END AS INT) AS pct FROM part")

# --- queue ---------------------------------------------------------------------------------------------
_add("str01_add", lambda s, d: S.add(_table(s, d, "events").selectExpr("user_id AS job", "event_id AS seq", "event_type AS event"), _table(s, d, "nation").selectExpr("CAST(1000000 + n_nationkey AS BIGINT) AS job")), "SELECT user_id AS job, event_id AS seq, event_type AS event FROM events UNION ALL SELECT 1000000 + n_nationkey, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY n_nationkey), 'added' FROM nation")
_add("str05_move_down", lambda s, d: S.move(_table(s, d, "nation").select(F.col("n_regionkey").alias("queue"), F.col("n_name").alias("job"), F.col("n_nationkey").alias("pos")), "NATION_3", 1), "WITH q AS (SELECT n_regionkey AS queue, n_name AS job, n_nationkey AS pos FROM nation), f AS (SELECT queue, pos FROM q WHERE job = 'NATION_3'), p AS (SELECT q.queue, min(q.pos) AS pos FROM q JOIN f ON q.queue = f.queue AND q.pos > f.pos GROUP BY q.queue) SELECT q.queue, q.job, CAST(CASE WHEN q.pos = f.pos AND p.pos IS NOT NULL THEN p.pos WHEN q.pos = p.pos THEN f.pos ELSE q.pos END AS INT) AS pos FROM q LEFT JOIN f ON q.queue = f.queue LEFT JOIN p ON q.queue = p.queue")
_add("str07_remove", lambda s, d: S.remove(_table(s, d, "orders").selectExpr("o_custkey AS job", "o_orderkey"), _table(s, d, "customer").where("c_acctbal > 0").selectExpr("c_custkey AS job")), "SELECT o_custkey AS job, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
_add("agg20_unresolved", lambda s, d: S.unresolved(_table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))), "SELECT count(*) FILTER (o_orderstatus <> 'F') AS n FROM orders")
_add("flt20_find_items", lambda s, d: S.find(_table(s, d, "part").selectExpr("p_partkey", "p_type || '/' || p_name || '.PDF' AS path"), "RING"), "SELECT p_partkey, p_type || '/' || p_name || '.PDF' AS path FROM part WHERE contains(lower(p_name || '.PDF'), 'ring')")


def _saved_states(s: SparkSession, d: str) -> DataFrame:
    folder = S.shared_folder(s)
    items = _table(s, d, "nation").selectExpr("n_nationkey AS job", "'running' AS status")
    S.save_states(items, folder)
    S.save_states(items.where("job < 5").withColumn("status", F.lit("completed")), folder)
    return S.recover(s.read.schema("status string, job int").json(folder)).select("job", "status")


_add("str09_saved_states", _saved_states, "SELECT n_nationkey AS job, 'pending' AS status FROM nation WHERE n_nationkey >= 5")


def _told(s: SparkSession, d: str) -> DataFrame:
    """What a listener of a stream is told, written by it."""
    folder = S.shared_folder(s)
    stream = s.readStream.schema(_table(s, d, "events").schema).parquet(C._as_found(d, "events"))
    S.subscribe(stream, [lambda rows, n: rows.select("event_id", "event_type").write.mode("overwrite").parquet(f"{folder}/told/batch={n}")], f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/told").select("event_id", "event_type")


_add("str08_subscribe", _told, "SELECT event_id, event_type FROM events")


def _jobs(s: SparkSession, d: str) -> DataFrame:
    """Two jobs of one session, one of which fails at first; their results by name."""
    jobs, failed = S.Jobs(s), []

    def shaky(spark: SparkSession) -> int:
        if not failed:
            failed.append(1)
            raise RuntimeError("once")
        return _table(spark, d, "customer").count()

    out = [("orders", jobs.submit("orders", lambda x: _table(x, d, "orders").count())), ("customer", jobs.submit("customer", shaky))]
    return s.createDataFrame([(n, f.result()) for n, f in out], "job string, n long").withColumn("active", F.lit(jobs.active()))


_add("str17_jobs", _jobs, "SELECT 'orders' AS job, count(*) AS n, 0::INT AS active FROM orders UNION ALL SELECT 'customer', count(*), 0 FROM customer")
_add("str13_cache_store", lambda s, d: P.cache_store(_table(s, d, "customer").selectExpr("'b' AS bucket", "c_custkey AS key", "10L AS size", "CAST(c_custkey AS TIMESTAMP) AS mtime"), _table(s, d, "nation").selectExpr("'b' AS bucket", "CAST(n_nationkey AS BIGINT) AS key", "10L AS size", "CAST(1000000000 + n_nationkey AS TIMESTAMP) AS mtime"), 500).select("key", "size"), "SELECT key, 10::BIGINT AS size FROM (SELECT key, row_number() OVER (ORDER BY m DESC, key) AS k FROM (SELECT key, max(m) AS m FROM (SELECT c_custkey AS key, c_custkey AS m FROM customer UNION ALL SELECT n_nationkey, 1000000000 + n_nationkey FROM nation) GROUP BY key)) WHERE k <= 50")


# --- steps of the waybills' fields ---------------------------------------------------------------------
def _step(name: str, which: str, text: str, sql: str) -> None:
    _add(name, lambda s, d: B.step(C._orders(s, d).selectExpr("o_orderkey AS source", f"{text} AS text"), which), f"SELECT {_SOURCE}, {sql} AS out FROM orders")


_NAME, _INN = "split_part(o_orderpriority, '-', 2) || CAST(o_custkey AS STRING)", "'7707083893'"
_step("ext10_party_lines", "party_lines", f"'является экспедитором' || chr(10) || 'ООО Склад ' || {_NAME} || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'Подпись' ELSE 'г. Тверь, склад' END || chr(10) || 'конец строки'", f"'ООО Склад ' || {_NAME} || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ', г. Тверь, склад, конец строки' END")
_step("ext11_party_after_word", "party_after_word", f"'Грузоотправитель: ООО ' || {_NAME} || ' грузополучатель АО' || chr(10) || 'дальше'", f"'ООО ' || {_NAME}")
_step("ext12_from_legal_form", "from_legal_form", f"'склад, ' || CASE WHEN o_orderkey % 2 = 0 THEN 'ПАО СБЕРБАНК, ' ELSE '' END || 'ООО ' || {_NAME}", f"'ООО ' || {_NAME}")
_step("ext13_through_tax_number", "through_tax_number", f"{_NAME} || CASE o_orderkey % 3 WHEN 0 THEN ', ИНН ' WHEN 1 THEN ' Инн. ' ELSE ', ' END || {_INN} || ', КПП 770701001'", f"{_NAME} || CASE o_orderkey % 3 WHEN 0 THEN ', ИНН ' WHEN 1 THEN ' Инн. ' ELSE ', ' END || {_INN}")
_step("ext14_before_money", "before_money", f"{_NAME} || CASE o_orderkey % 3 WHEN 0 THEN ', КПП 1' WHEN 1 THEN ', инн ' || {_INN} ELSE '' END", _NAME)
_step("ext15_clean_cargo", "clean_cargo", f"{_NAME} || CASE o_orderkey % 3 WHEN 0 THEN ', 12 шт.' WHEN 1 THEN ' упаковка поддон' ELSE ', кол-во мест 7' END", _NAME)
_step("ext16_cargo_name", "cargo_name", f"CASE o_orderkey % 3 WHEN 0 THEN 'Наименование: ' || {_NAME} WHEN 1 THEN 'Наименование:' || chr(10) || 'Нетто 12345' || chr(10) || 'плита ' || {_NAME} ELSE 'кирпич ' || {_NAME} END || chr(10) || 'Упаковка: поддон'", f"CASE o_orderkey % 3 WHEN 0 THEN {_NAME} WHEN 1 THEN 'плита ' || {_NAME} ELSE 'кирпич ' || {_NAME} END")
_step("ext17_compact_plate", "plate", f"'МАН ' || substr('АВЕКМНОРСТУХ', CAST(1 + o_orderkey % 12 AS INT), 1) || ' ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || ' BC 77'", "substr('АВЕКМНОРСТУХ', CAST(1 + o_orderkey % 12 AS INT), 1) || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || 'ВС77'")
_step("ext18_reception_lines", "reception_lines", f"'адрес погрузки' || chr(10) || 'ООО ' || {_NAME} || chr(10) || 'г. Тула' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'ИНН ' || {_INN} ELSE 'улица' END || chr(10) || 'дом' || chr(10) || 'этаж'", f"'ООО ' || {_NAME} || ', г. Тула, ' || CASE WHEN o_orderkey % 2 = 0 THEN 'ИНН ' || {_INN} ELSE 'улица, дом' END")
_step("ext19_reception_value", "reception_value", f"'ООО ' || {_NAME} || chr(10) || CASE o_orderkey % 2 WHEN 0 THEN 'Ин, ' || {_INN} || ', КПП 1' ELSE 'г. Тула, да' END", f"'ООО ' || {_NAME} || CASE o_orderkey % 2 WHEN 0 THEN ', ИНН ' || {_INN} ELSE ', г. Тула' END")
_step("msc08_first_tax_number", "first_tax_number", f"'7707083894 и ' || CASE WHEN o_orderkey % 2 = 0 THEN {_INN} || ' 500100732259' ELSE '77070838931' END", f"CASE WHEN o_orderkey % 2 = 0 THEN {_INN} END")
_step("jn06_nearest_role", "nearest_role", "CASE o_orderkey % 4 WHEN 0 THEN 'Перевозчнк' WHEN 1 THEN 'Грузополучатeль' WHEN 2 THEN 'Продовец товара' ELSE 'абвгдежз' END", "CASE o_orderkey % 4 WHEN 0 THEN 'carrier' WHEN 1 THEN 'consignee' WHEN 2 THEN 'shipper' END")
_add("flt09_service_lines", lambda s, d: _table(s, d, "orders").selectExpr("o_orderkey AS source", f"{_SERVICE} AS text").join(B.lines_of_value(_table(s, d, "orders").selectExpr("o_orderkey AS source", f"{_SERVICE} AS text")).select(F.col("source").cast("long").alias("source")), "source", "left_anti").select("source"), "SELECT o_orderkey AS source FROM orders WHERE o_orderkey % 5 <> 2")
_add("flt12_noise_rows", lambda s, d: B.parse(C._orders(s, d).selectExpr("o_orderkey AS source", f"{C._WAYBILL} || chr(10) || 'Транспортная накладная' || chr(10) || repeat('подписи сторон ', 20) AS text"), "2024-06-01", []).select("source"), "SELECT CAST(o_orderkey AS VARCHAR) || '#1' AS source FROM orders")
_add("spl01_documents", lambda s, d: B.documents(C._orders(s, d).selectExpr("o_orderkey AS source", f"CASE o_orderkey % 3 WHEN 0 THEN {C._WAYBILL} WHEN 1 THEN {C._WAYBILL} || chr(10) || {C._WAYBILL} ELSE 'Счет-фактура ' || repeat('товар ', 20) || chr(12) || {C._WAYBILL} END AS text".replace("chr(12)", "'\f'"))).select("source", "place", F.length("document").alias("n")), f"SELECT {_SOURCE}, CAST(k AS INT) AS place, length({C._WAYBILL}) AS n FROM (SELECT *, unnest(range(1, CASE WHEN o_orderkey % 3 = 1 THEN 3 ELSE 2 END)) AS k FROM orders)")
_add("set05_title_families", lambda s, d: B.titles(_table(s, d, "orders").selectExpr("o_orderkey AS source", "CASE WHEN o_orderkey % 2 = 0 THEN '3. Груз' ELSE 'Груз: ' || o_orderpriority END || chr(10) || 'Перевозчик' AS text")).select("source", "line", "role"), f"SELECT {_SOURCE}, 1::INT AS line, 'cargo' AS role FROM orders UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 2, 'carrier' FROM orders")
_add("udf05_kinds", lambda s, d: B.from_pages(C._waybills(s, d).select(F.col("source").alias("doc"), F.lit(1).alias("page"), "text"), "2024-06-01", kind="other").select("source").unionByName(_table(s, d, "region").select(F.col("r_name").alias("source"))), "SELECT r_name AS source FROM region")

# --- smaller ones ------------------------------------------------------------------------------------------
_over("val14_fix_ogrn", "customer", "('1027700132' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0') || '5')", V.fix_ogrn, f"CASE WHEN len({{n}}) = 1 AND NOT {{own}} THEN {{n}}[1] END".replace("{n}", "list_distinct(list_filter(list_concat({subs}, {dels}), lambda x: {ok}))").replace("{own}", "false").replace("{subs}", C._subs).replace("{dels}", C._dels).replace("{ok}", "CASE WHEN length(x) = 13 THEN CAST(x[1:12] AS BIGINT) % 11 % 10 = CAST(x[13] AS INT) WHEN length(x) = 15 THEN CAST(x[1:14] AS BIGINT) % 13 % 10 = CAST(x[15] AS INT) ELSE false END"), spread=True)
_over("msc09_check_digit", "orders", "CAST(770000000 + o_orderkey AS STRING)", lambda c: V.check_digit(c, V.INN10), "CAST(list_sum(list_transform([2, 4, 10, 3, 5, 9, 4, 6, 8], lambda w, i: w * CAST(v[i] AS INT))) % 11 % 10 AS INT)")
_on_words("wrd09_whole_text", lambda w: W.rebuild_text(w, 0), "SELECT page, string_agg(t, chr(10) ORDER BY block, par, line) AS text FROM (SELECT page, block, par, line, string_agg(word, ' ' ORDER BY word_num, word) AS t FROM w GROUP BY page, block, par, line) GROUP BY page")
_add("wrd13_edit_distance", lambda s, d: _table(s, d, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("n")), "SELECT p_partkey, CAST(levenshtein(p_name, lower(p_type)) AS INT) AS n FROM part")
_over("udf01_rules", "part", "(p_name || ' a.b ' || p_brand)", lambda c: R.apply_rules(c, [R.Rule("a.b", "dot", is_regex=False), R.Rule(r"(\w+)#(\d+)", r"\2-\1"), R.Rule("ring", "x", enabled=False)]), r"regexp_replace(replace(v, 'a.b', 'dot'), '(\w+)#(\d+)', '\2-\1', 'g')")
_add("pst18_low_spans", lambda s, d: _table(s, d, "part").select("p_partkey", F.posexplode(R.split_low_words(F.concat("p_name", F.lit(" — "), F.lower("p_type")), F.array(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit("promo")))).alias("place", "x")).select("p_partkey", "place", "x.*"), """WITH s AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, substr(p_name, length(split_part(p_name, ' ', 1)) + 1) || ' — ' AS b, lower(p_type) AS c FROM part)
    SELECT p_partkey, 0::INT AS place, a AS span, true AS low FROM s UNION ALL SELECT p_partkey, 1, CASE WHEN c IN ('promo', a) THEN b ELSE b || c END, false FROM s UNION ALL SELECT p_partkey, 2, c, true FROM s WHERE c IN ('promo', a)""")
_add("pst19_clipboard_text", lambda s, d: files.export_text(_turns(s, d).withColumn("error", F.lit(None).cast("string"))), rf"SELECT doc, regexp_replace(string_agg('--- Page ' || page || ' ---' || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY page, text), '\s+$', '') || chr(10) AS text FROM ({_TURNS}) GROUP BY doc")
_add("msc03_progress_percent", lambda s, d: S.progress(_table(s, d, "events").selectExpr("user_id AS job", "event_id AS seq", "CAST(floor(value) AS BIGINT) AS current", "CASE WHEN user_id % 2 = 0 THEN 0L ELSE 200L END AS total")), "SELECT user_id AS job, CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE least(100.0, 100.0 * arg_max(floor(value), event_id) / 200) END::DOUBLE AS pct FROM events GROUP BY user_id")
_add("str16_latest_progress", lambda s, d: S.latest(_table(s, d, "events").select("user_id", "event_id", F.struct(F.col("value").alias("current"), F.col("event_type").alias("stage")).alias("at")), "user_id", ["event_id"], "at").select("user_id", "at.*"), "SELECT user_id, arg_max(value, event_id) AS current, arg_max(event_type, event_id) AS stage FROM events GROUP BY user_id")
_wishes = lambda s, d, wish: P.set_status(_table(s, d, "customer").selectExpr("c_custkey AS job", "CASE WHEN c_custkey % 2 = 0 THEN 'paused' ELSE 'running' END AS status"), _table(s, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS job", "1L AS seq", f"'{wish}' AS wish"))
_add("msc18_resume", lambda s, d: _wishes(s, d, "resume"), "SELECT c_custkey AS job, CASE WHEN n_nationkey IS NOT NULL THEN 'pending' WHEN c_custkey % 2 = 0 THEN 'paused' ELSE 'running' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_custkey")
_add("msc19_cancel", lambda s, d: _wishes(s, d, "cancel"), "SELECT c_custkey AS job, CASE WHEN n_nationkey IS NOT NULL THEN 'cancelled' WHEN c_custkey % 2 = 0 THEN 'paused' ELSE 'running' END AS status FROM customer LEFT JOIN nation ON n_nationkey = c_custkey")
_add("msc07_confidence_colour", lambda s, d: _table(s, d, "part").select("p_partkey", P.confidence_colour(F.col("p_size") * 2).alias("colour")), "SELECT p_partkey, CASE WHEN p_size * 2 < 50 THEN 'red' WHEN p_size * 2 < 70 THEN 'yellow' ELSE 'green' END AS colour FROM part")
_add("msc11_first_waybill", lambda s, d: A.expectations(_table(s, d, "orders").selectExpr("CAST(o_orderkey AS STRING) AS stem", """'{"documents": [{"type": "UPD", "number": "0"}, {"type": "TN", "number": "' || CAST(o_custkey AS STRING) || '"}, {"type": "TN", "number": "9"}]}' AS text""")).where("field = 'number'").select("stem", F.col("wanted")["value"].alias("number")), "SELECT CAST(o_orderkey AS VARCHAR) AS stem, CAST(o_custkey AS VARCHAR) AS number FROM orders")
_add("msc05_rendered_pages", lambda s, d: layout.page_texts(_table(s, d, "nation").select(F.col("n_regionkey").alias("doc"), F.lit(1).alias("page"), F.lit(600.0).alias("page_width"), F.lit(10.0).alias("x0"), (F.col("n_nationkey") * 12.0).alias("y0"), F.lit(90.0).alias("x1"), (F.col("n_nationkey") * 12.0 + 9).alias("y1"), F.col("n_name").alias("text"))).select("doc", "text"), "SELECT n_regionkey AS doc, string_agg(n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")


def _stopped(s: SparkSession, d: str) -> DataFrame:
    """A job that waits behind another is taken off; the one that runs goes on."""
    jobs = S.Jobs(s, 1)
    first = jobs.submit("first", lambda x: _table(x, d, "lineitem").count())
    jobs.submit("second", lambda x: 0)
    told = [("second", jobs.cancel("second")), ("first", first.result() > 0), ("first again", jobs.cancel("first"))]
    return s.createDataFrame(told, "job string, told boolean")


_add("str18_cancelled_job", _stopped, "SELECT * FROM (VALUES ('second', true), ('first', true), ('first again', false)) AS t(job, told)")


def _dictionary(s: SparkSession, d: str) -> DataFrame:
    none = files.dictionary(s, f"{S.shared_folder(s)}/none") is None and files.dictionary(s, None) is None
    return files.dictionary(s, _text_files(s, d)).select("entry", F.lit(none).alias("none"))


_add("src20_dictionary", _dictionary, "SELECT n_name AS entry, true AS none FROM nation")


def _sheets(s: SparkSession, d: str) -> DataFrame:
    folder = f"{S.shared_folder(s)}/sheets"
    rows = snapshots.sheet(_parsed(s, d)).withColumn("book", F.lit("all").cast("string")).withColumn("book", F.col("source").cast("long") % 7)
    office.write_xlsx(rows, "book", ["source", "number", "date"], folder).count()
    return office.read_workbooks(s, folder).where("row > 0").select(F.col("cells")[0].alias("source"), F.col("cells")[1].alias("number"), F.col("cells")[2].alias("date"))


_add("snk06_sheets_of_rows", _sheets, f"SELECT {_SOURCE}, {_FORMULA['number']} AS number, {_FORMULA['date']} AS date FROM orders")


def _sheets_of_pages(s: SparkSession, d: str) -> DataFrame:
    folder = f"{S.shared_folder(s)}/pages"
    office.write_xlsx(_table(s, d, "nation").selectExpr("n_regionkey", "CAST(n_nationkey AS STRING) AS page", "n_name AS text"), "n_regionkey", ["page", "text"], folder).count()
    return office.read_workbooks(s, folder).where("row > 0").select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("doc"), F.col("cells")[1].alias("text"))


_add("snk04_sheets_of_pages", _sheets_of_pages, "SELECT CAST(n_regionkey AS VARCHAR) AS doc, n_name AS text FROM nation")
_add("snk11_appended_corrections", _correction_log, C._SQL["src15_correction_log"])


# --- repairs that look around: over strings whose repair follows from how they are made --------------------------
_RUN = "substr('aceopxyABCEHKMOPTX', CAST(1 + o_orderkey % 16 AS INT), 3)"
_ALIKE = lambda e: f"translate({e}, '{R.LATIN}', '{R.CYRILLIC}')"
_over("nrm02_confusable_runs", "orders", f"('гр' || {_RUN} || ' ' || {_RUN} || ' ' || {_RUN} || 'р ' || {_RUN} || CAST(o_custkey AS STRING))", R.fix_confusables, f"'гр' || {_ALIKE(_RUN)} || ' ' || {_RUN} || ' ' || substr({_RUN}, 1, 2) || {_ALIKE(f'substr({_RUN}, 3, 1)')} || 'р ' || {_RUN} || CAST(o_custkey AS VARCHAR)")
_BROKEN = f"(' ' || {_RUN} || 'д-' || chr(10) || 'ом' || chr(10) || chr(10) || 'к' || {_RUN} || '  ' || CAST(o_custkey AS STRING) || ' ')"
_MENDED = f"substr({_RUN}, 1, 2) || {_ALIKE(f'substr({_RUN}, 3, 1)')} || 'дом'"
_over("nrm06_normalized_cyrillic", "orders", _BROKEN, R.normalize_cyrillic, f"{_MENDED} || chr(10) || 'к' || {_ALIKE(_RUN)} || ' ' || CAST(o_custkey AS VARCHAR)")
_over("nrm07_collapsed", "orders", _BROKEN, R.collapse, f"{_MENDED} || ' к' || {_ALIKE(_RUN)} || ' ' || CAST(o_custkey AS VARCHAR)")
_pick = lambda signs, n: f"substr('{signs}', CAST(1 + o_orderkey % {n} AS INT), 1)"
_D1, _D2 = "CAST(o_orderkey % 10 AS STRING)", "CAST(o_custkey % 10 AS STRING)"
_over("pst06_russian_repairs", "orders", f"('к' || {_pick('034681', 6)} || 'т ' || {_D1} || {_pick('ОЗЧВI', 5)} || {_D2} || ' ма' || {_pick('HBCPTMAEKXO', 11)} || 'а 0 З кb')", R.autocorrect_russian, f"'к' || {_pick('озчбвл', 6)} || 'т ' || {_D1} || {_pick('03481', 5)} || {_D2} || ' ма' || {_pick('НВСРТМАЕКХО', 11)} || 'а 0 З кь'")
_over("pst07_english_repairs", "orders", f"('c' || {_pick('015', 3)} || 'd ' || {_D1} || {_pick('OIS', 3)} || {_D2} || ' ba' || CASE o_orderkey % 3 WHEN 0 THEN 'rn' WHEN 1 THEN 'cl' ELSE 'vv' END || 'e vvide 0 O RN')", R.autocorrect_english, f"'c' || {_pick('ols', 3)} || 'd ' || {_D1} || {_pick('015', 3)} || {_D2} || ' ba' || CASE o_orderkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'd' ELSE 'w' END || 'e wide 0 O RN'")
_over("pst14_entities_in_text", "orders", "('дата ' || CAST(1 + o_orderkey % 28 AS STRING) || '.' || CAST(1 + o_custkey % 12 AS STRING) || '.24, сумма ' || CAST(1 + o_orderkey % 900 AS STRING) || ' 234,5 руб и тел. 8 (495) 725-8O-' || lpad(CAST(o_custkey % 100 AS STRING), 2, '0'))", R.canonical_entities, "'дата ' || lpad(CAST(1 + o_orderkey % 28 AS VARCHAR), 2, '0') || '.' || lpad(CAST(1 + o_custkey % 12 AS VARCHAR), 2, '0') || '.2024, сумма ' || CAST(1 + o_orderkey % 900 AS VARCHAR) || ' 234,50 и тел. +7 (495) 725-80-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0')")
_LONE = f"(CASE p_partkey % 4 WHEN 0 THEN {C._CYRILLIC.format('split_part(p_name, chr(32), 1)')} WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN 'дж' || substr(p_name, 1, 2) ELSE p_type END)"
_over("pst09_unified_words", "part", _LONE, R.unify_scripts, f"CASE WHEN NOT regexp_matches(v, '[{R.CYRILLIC}{R.ONLY_CYRILLIC}]') THEN v ELSE CASE coalesce(nullif({C._kind.replace('X', 'v')}, 'mixed'), {C._major.replace('X', 'v')}) WHEN 'cyr' THEN translate(v, '{R.LATIN}', '{R.CYRILLIC}') WHEN 'lat' THEN translate(v, '{R.CYRILLIC}', '{R.LATIN}') ELSE v END END")
