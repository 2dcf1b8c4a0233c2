"""More queries: PDF files, layout, images as tables of pixels, engines, annotations and contracts, profiles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.operators import annotations as A
from pagelathe.operators import decisions as D
from pagelathe.operators import engines, layout
from pagelathe.operators import images as I
from pagelathe.operators import lookups as L
from pagelathe.operators import reports as P
from pagelathe.operators import waybills as B
from pagelathe.plans import catalog as C
from pagelathe.plans import profiles
from pagelathe.sources import files, pdf
from pagelathe.streaming import queue as S

_add, _table = C._add, C._table

# --- PDF -------------------------------------------------------------------------------------------
_LINES = "translate(p_name, 'aeop', 'аеор') || chr(10) || p_type || chr(10) || chr(10) || p_brand"
#: Pages of a file, one a part, by brand; every seventh page is blank.
_PAGE_TEXT = f"CASE WHEN p_partkey % 7 = 0 THEN '' ELSE {_LINES} END"
_READ_TEXT = f"CASE WHEN p_partkey % 7 = 0 THEN '' ELSE replace({_LINES}, chr(10) || chr(10), chr(10)) END"


def _pdfs(s: SparkSession, d: str) -> DataFrame:
    folder = f"{S.shared_folder(s)}/pdf"
    pdf.write(_table(s, d, "part").selectExpr("split_part(p_brand, '#', 2) AS doc", "p_partkey AS page", f"{_PAGE_TEXT} AS text"), folder).count()
    return pdf.read(s, folder)


_name = lambda: F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc")
_NUMBERED = f"SELECT split_part(p_brand, '#', 2) AS doc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS page, {_READ_TEXT} AS text FROM part"
_TEXTS = f"SELECT doc, string_agg(text, chr(12) ORDER BY page) AS text FROM ({_NUMBERED}) GROUP BY doc"
_add("src05_pages", lambda s, d: _pdfs(s, d).select(_name(), "page", "has_text", "error"), f"SELECT doc, page, text <> '' AS has_text, NULL::VARCHAR AS error FROM ({_NUMBERED})")
_add("src07_plain_readings", lambda s, d: _pdfs(s, d).select(_name(), "page", pdf.plain(F.col("spans")).alias("text")), _NUMBERED)
_add("src08_block_readings", lambda s, d: _pdfs(s, d).select(_name(), "page", pdf.blocks(F.col("spans")).alias("text")), f"SELECT doc, page, replace(text, chr(10), chr(10) || chr(10)) AS text FROM ({_NUMBERED})")
_add("src09_layout_readings", lambda s, d: layout.page_texts(pdf.spans(_pdfs(s, d))).select(F.regexp_extract("doc", r"([^/]+)\.pdf$", 1).alias("doc"), "page", "text"), f"SELECT * FROM ({_NUMBERED}) WHERE text <> ''")
_add("src06_best_of_three", lambda s, d: pdf.best_texts(_pdfs(s, d)).select(_name(), "text"), _TEXTS)
_add("src10_raw_texts", lambda s, d: pdf.raw_texts(_pdfs(s, d)).select(_name(), F.length("text").alias("n")), rf"SELECT doc, length(regexp_replace(regexp_replace(text, '\n+', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS n FROM ({_TEXTS})")
_add("src12_sidecars", lambda s, d: pdf.with_sidecars(pdf.best_texts(_pdfs(s, d)), s.createDataFrame([("1", "beside")], "stem string, text string")).select(_name(), "text"), f"SELECT doc, CASE WHEN doc = '1' THEN 'beside' ELSE text END AS text FROM ({_TEXTS})")
_add("lay01_spans", lambda s, d: pdf.spans(_pdfs(s, d)).select(F.regexp_extract("doc", r"([^/]+)\.pdf$", 1).alias("doc"), "page", F.round("x0").alias("x0"), F.round("y0").alias("y0"), "text"), f"SELECT doc, page, 40.0::DOUBLE AS x0, (40 + 14 * y)::DOUBLE AS y0, line AS text FROM (SELECT split_part(p_brand, '#', 2) AS doc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS page, p_partkey, p_name, p_type, p_brand FROM part), LATERAL (VALUES (0, translate(p_name, 'aeop', 'аеор')), (1, p_type), (3, p_brand)) AS t(y, line) WHERE p_partkey % 7 > 0")


def _found(s: SparkSession, d: str) -> DataFrame:
    """One real file and one that only has its ending."""
    folder = f"{S.shared_folder(s)}/pdf"
    pdf.write(_table(s, d, "part").selectExpr("split_part(p_brand, '#', 2) AS doc", "p_partkey AS page", f"{_PAGE_TEXT} AS text"), folder).count()
    return files.discover(s, [folder])


_add("src01_discover", lambda s, d: _found(s, d).select(_name(), "is_pdf"), "SELECT DISTINCT split_part(p_brand, '#', 2) AS doc, true AS is_pdf FROM part")


def _copied(s: SparkSession, d: str) -> DataFrame:
    target = f"{S.shared_folder(s)}/copies"
    read = _pdfs(s, d).select("path").distinct()
    pdf.copy(read.select("path", F.concat(F.lit(target + "/"), F.regexp_extract("path", "[^/]+$", 0)).alias("target"))).count()
    return pdf.best_texts(pdf.read(s, target)).select(_name(), "text")


_add("snk05_copied_files", _copied, _TEXTS)

# --- layout ------------------------------------------------------------------------------------------
_SPOTS = "SELECT DISTINCT l_orderkey AS doc, l_linenumber AS n FROM lineitem"
_span = lambda x, y, n: [F.lit(600.0).alias("page_width"), x.alias("x0"), y.alias("y0"), (x + 8.0).alias("x1"), (y + 9.0).alias("y1"), F.concat(F.lit("w"), n.cast("string")).alias("text")]


def _flat(s: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    spots = _table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber").distinct()
    return spots.select("doc", F.lit(1).alias("page"), *_span(n * 20.0, (n % 3) * 10.0 + (n % 2), n))


_add("lay05_flat_pages", lambda s, d: layout.page_texts(_flat(s, d)).select("doc", "text"), f"SELECT doc, string_agg(t, chr(10) ORDER BY g) AS text FROM (SELECT doc, n % 3 AS g, string_agg('w' || n, ' ' ORDER BY n) AS t FROM ({_SPOTS}) GROUP BY doc, n % 3) GROUP BY doc")


def _columns(s: SparkSession, d: str) -> DataFrame:
    """Three lines of two columns for each order."""
    rows = _table(s, d, "orders").select(F.col("o_orderkey").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    k = F.col("k")
    return rows.select("doc", F.lit(1).alias("page"), *_span(F.when(k % 2 == 0, 20.0).otherwise(400.0), F.floor(k / 2) * 20.0 + (k % 2) * 2, k + F.col("doc")))


_add("lay04_two_columns", lambda s, d: layout.page_texts(_columns(s, d)).select("doc", "text"), "SELECT o_orderkey AS doc, 'w' || o_orderkey || chr(10) || 'w' || (o_orderkey + 2) || chr(10) || 'w' || (o_orderkey + 4) || chr(10) || chr(10) || 'w' || (o_orderkey + 1) || chr(10) || 'w' || (o_orderkey + 3) || chr(10) || 'w' || (o_orderkey + 5) AS text FROM orders")
_add("lay02_lines", lambda s, d: layout.line_numbers(_flat(s, d)).select("doc", "line", "text"), f"SELECT doc, CAST(dense_rank() OVER (PARTITION BY doc ORDER BY n % 3) AS INT) AS line, 'w' || n AS text FROM ({_SPOTS})")
_add("lay03_is_two_column", lambda s, d: layout.column_counts(_columns(s, d).unionByName(_flat(s, d).withColumn("doc", -F.col("doc") - 1))).select("doc", "two"), f"SELECT o_orderkey AS doc, true AS two FROM orders UNION ALL SELECT DISTINCT -doc - 1, false FROM ({_SPOTS})")

# --- images of 8 by 6 pixels made of parts, their pixels as rows in SQL --------------------------------
_PX = {"any": "(p_partkey * 7 + y * 31 + x * 17) % 256", "two": "CASE WHEN (x + y) % 2 = 0 THEN p_partkey % 100 ELSE 150 + p_partkey % 100 END", "line": "CASE WHEN y = 2 THEN 0 WHEN y = 4 AND x < 3 THEN 10 ELSE 255 END", "flat": "p_partkey % 200 + 20"}


def _images(s: SparkSession, d: str, kind: str, channels: int = 1) -> DataFrame:
    x, y = f"(CAST(floor(i / {channels}) AS INT) % 8)", f"CAST(floor(i / {8 * channels}) AS INT)"
    body = " ".join({"x": x, "y": y}.get(w, w) for w in _PX[kind].replace("(", "( ").replace(")", " )").split())
    body = f"({body} + i % {channels} * 50) % 256" if channels > 1 else body
    data = f"unhex(array_join(transform(sequence(0, {48 * channels - 1}), i -> lpad(hex({body}), 2, '0')), ''))"
    # a small row becomes an image that is worked on in Python: one file's few blocks are spread first
    parts = _table(s, d, "part").select("p_partkey").repartition(s.sparkContext.defaultParallelism)
    return parts.selectExpr(f"named_struct('origin', CAST(p_partkey AS STRING), 'height', 6, 'width', 8, 'nChannels', {channels}, 'data', {data}) AS image")


def _done(kind: str, steps: list, stop: str | None = None, channels: int = 1):  # noqa: ANN202
    return lambda s, d: I.process(_images(s, d, kind, channels), steps, stop).select("path", "height", "width", F.hex("data").alias("data"))


def _px(kind: str) -> str:
    return f"px AS (SELECT p_partkey AS id, y, x, {_PX[kind]} AS v FROM part, (SELECT unnest(range(0, 6)) AS y), (SELECT unnest(range(0, 8)) AS x))"


def _shown(value: str, source: str = "px", h: int = 6, w: int = 8, y: str = "y", x: str = "x") -> str:
    return f"SELECT CAST(id AS VARCHAR) AS path, {h}::INT AS height, {w}::INT AS width, string_agg(printf('%02X', CAST({value} AS INT)), '' ORDER BY {y}, {x}) AS data FROM {source} GROUP BY id"


def _image(name: str, kind: str, steps: list, value: str, source: str = "px", more: str = "", **shape) -> None:
    _add(name, _done(kind, steps), f"WITH {_px(kind)}{more} {_shown(value, source, **shape)}")


#: Neighbours of a pixel, beyond the edge by repeating it or by turning back.
_NEAR = ", near AS (SELECT a.id, a.y, a.x, a.v, b.v AS nv FROM px a, (SELECT unnest(range(-1, 2)) AS dy), (SELECT unnest(range(-1, 2)) AS dx), px b WHERE b.id = a.id AND b.y = {Y} AND b.x = {X})"
_EDGE = _NEAR.format(Y="least(greatest(a.y + dy, 0), 5)", X="least(greatest(a.x + dx, 0), 7)")
_BACK = _NEAR.format(Y="CASE WHEN a.y + dy > 5 THEN 4 ELSE abs(a.y + dy) END", X="CASE WHEN a.x + dx > 7 THEN 6 ELSE abs(a.x + dx) END")
_by = lambda e: f", q AS (SELECT id, y, x, any_value(v) AS v, {e} FROM near GROUP BY id, y, x)"
_image("img06_contrast", "any", [("contrast", {"alpha": 1.5, "beta": -20})], "least(greatest(round_even(v * 1.5 - 20, 0), 0), 255)")
_image("img12_quarter_turn", "any", [("turn", {"degrees": 90})], "v", h=8, w=6, y="x", x="-y")
_image("img11_half_turn", "any", [("rotate", {"degrees": 180})], "v", y="-y", x="-x")
_image("img23_crop", "any", [("crop", {"left": 3, "top": 2, "width": 2, "height": 2, "pad": 1})], "v", source="(SELECT * FROM px WHERE y BETWEEN 1 AND 4 AND x BETWEEN 2 AND 5)", h=4, w=4)
_image("img02_binarised", "two", [("otsu", {})], "CASE WHEN (x + y) % 2 = 0 THEN 0 ELSE 255 END")
_image("img03_sauvola", "any", [("sauvola", {"size": 3, "k": 0.2})], "CASE WHEN v > m * (1 + 0.2 * (sqrt(greatest(m2 - m * m, 0)) / 128 - 1)) THEN 255 ELSE 0 END", "q", _BACK + _by("avg(nv) AS m, avg(nv * nv) AS m2"))
_image("img02_adaptive_mean", "any", [("adaptive", {"size": 3, "c": 10})], "CASE WHEN 9 * v > s - 90 THEN 255 ELSE 0 END", "q", _BACK + _by("sum(nv) AS s"))
_image("img04_median", "any", [("median", {"size": 3})], "m", "q", _EDGE + _by("median(nv) AS m"))
_image("img05_opened", "any", [("open", {"size": 3})], "m", "(SELECT a.id, a.y, a.x, max(b.e) AS m FROM q a JOIN q b ON a.id = b.id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.id, a.y, a.x)", _EDGE + _by("min(nv) AS e"))
_image("img17_removed_lines", "line", [("lines", {"least": 5})], "CASE WHEN y = 2 THEN 255 ELSE v END")
_image("img19_no_flattening", "any", [("dewarp", {})], "v")
_image("img07_even_background", "flat", [("background", {"sigma": 2})], "255")
_image("img01_steps_in_order", "any", [("contrast", {"alpha": 0.5, "beta": 10}), ("turn", {"degrees": 180}), ("contrast", {"alpha": 2, "beta": 0})], "least(2 * round_even(v * 0.5 + 10, 0), 255)", y="-y", x="-x")
_add("img21_preview", _done("any", [("contrast", {"alpha": 1, "beta": 5}), ("turn", {"degrees": 90})], "contrast"), f"WITH {_px('any')} {_shown('least(v + 5, 255)')}")
_add("img22_grey", _done("any", [], None, 3), f"WITH {_px('any')} {_shown('round_even(0.114 * v + 0.587 * ((v + 50) % 256) + 0.299 * ((v + 100) % 256), 0)')}")
_add("img09_skew", lambda s, d: I.skews(_images(s, d, "line")), "SELECT CAST(p_partkey AS VARCHAR) AS path, 0.0::DOUBLE AS skew FROM part")
_image("img08_straight_page", "line", [("deskew", {})], "v")
for _n, _steps in {"img06_clahe": [("clahe", {"clip": 2.0, "tile": 2})], "img04_nonlocal_means": [("nlm", {"h": 10, "patch": 3, "search": 5})], "img04_gaussian": [("gaussian", {"sigma": 1.0})]}.items():
    _add(_n, _done("any", _steps))

# --- engines ---------------------------------------------------------------------------------------------
_scans = lambda s, d: _table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").cast("int").alias("page"), F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").cast("binary").alias("data"))
_READ = "SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS INT) AS page, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus || '-' || o_orderpriority END AS text, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN 1 ELSE 0 END::INT AS tier, CASE WHEN o_orderstatus = 'F' THEN 'ValueError: unreadable' END AS error"
_add("ocr01_recognise", lambda s, d: engines.recognise(_scans(s, d), engines.get("echo"), [{}, engines.TIERS[0]]).select("path", "page", "text", "tier", "error"), f"{_READ} FROM orders")
_add("ocr02_documents", lambda s, d: engines.recognise_documents(_scans(s, d), engines.get("echo"), {}).select("path", "page", "text", "tier", "error", "failed"), f"{_READ}, bool_and(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS failed FROM orders")

# --- annotations and contracts ------------------------------------------------------------------------------
_page = lambda: F.to_json(F.struct(F.array(F.struct(F.lit("TTN").alias("document_type"), F.struct(F.col("o_orderkey").cast("string").alias("order_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ttn_date"), F.struct(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("places_count")).alias("cargo"), F.struct(F.lit("A1").alias("plate")).alias("vehicle")).alias("structured_fields"))).alias("pages")))
_add("udf17_page_annotations", lambda s, d: A.expectations(_table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("stem"), _page().alias("text"))).select("stem", "field", F.explode("wanted").alias("part", "value")), """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS stem, * FROM orders)
    SELECT stem, 'number' AS field, 'value' AS part, stem AS value FROM o UNION ALL SELECT stem, 'date', 'value', strftime(o_orderdate, '%d.%m.%Y') FROM o UNION ALL SELECT stem, 'cargo', 'value', o_orderpriority FROM o
    UNION ALL SELECT stem, 'volume', 'places', CAST(o_custkey AS VARCHAR) FROM o UNION ALL SELECT stem, 'vehicle', 'plate', 'A1' FROM o UNION ALL SELECT stem, r, 'role', r FROM o, (VALUES ('shipper'), ('consignee')) AS t(r)""")
_add("src18_default_catalog", lambda s, d: A.first_not_empty(_table(s, d, "nation").where("n_nationkey < 0").select("n_name"), _table(s, d, "region").select(F.col("r_name").alias("n_name"))), "SELECT r_name AS n_name FROM region")
_add("jn05_annotation_of_a_reading", lambda s, d: _table(s, d, "part").select("p_partkey", A.base_name(F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " ocred").otherwise(""))).alias("stem")).join(_table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("stem"), "c_name"), "stem", "left"), "SELECT CAST(p_partkey AS VARCHAR) AS stem, p_partkey, c_name FROM part LEFT JOIN customer ON c_custkey = p_partkey")
_rows = lambda s, d: B.parse(C._waybills(s, d), "2024-06-01")
#: Dealt by source; none is null, which a join need not ask again, so that both its sides read one shuffle and texts are parsed once.
_dealt = lambda s, d: _rows(s, d).where("source is not null").repartition("source")
_CONTRACTS = " UNION ALL ".join(f"SELECT CAST(o_orderkey AS VARCHAR) AS source, '{f}' AS field, {C._FIELD_SQL[f]} AS equals FROM orders" for f in A.CONTRACT)
_add("udf18_contracts", lambda s, d: A.contracts(_rows(s, d)).select("source", "field", "equals"), _CONTRACTS)
_add("msc26_merged_contracts", lambda s, d: A.merged_contracts(A.contracts((r := _dealt(s, d)).where("cast(source AS bigint) % 2 = 0").withColumn("number", F.lit("own"))), A.contracts(r)).select("source", "field", "equals"), f"SELECT source, field, CASE WHEN field = 'number' AND CAST(source AS BIGINT) % 2 = 0 THEN 'own' ELSE equals END AS equals FROM ({_CONTRACTS})")
_add("udf18_broken_contracts", lambda s, d: A.broken_contracts(r := _dealt(s, d), A.contracts(r.withColumn("cargo", F.when(F.col("cargo") == "кирпич", "камень").otherwise(F.col("cargo"))))), "SELECT CAST(o_orderkey AS VARCHAR) AS source, 'cargo' AS field, 'кирпич' AS got FROM orders WHERE o_orderstatus = 'O'")
_add("msc12_parties", lambda s, d: A.organisations(C._annotated(s, d)).select("inn", "source"), f"WITH {C._ANNOTATED} SELECT inn, min(CAST(o_orderkey AS VARCHAR)) AS source FROM ok WHERE good GROUP BY inn")
_add("win01_first_of_each_role", lambda s, d: L.first_by(_table(s, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("key"), "turn"), "key", ["turn"]), "SELECT conv_id || '/' || role AS key, min(turn) AS turn FROM conversations WHERE role IS NOT NULL GROUP BY 1")
_add("set03_distinct_names", lambda s, d: A.identifiers(C._annotated(s, d)).where("kind = 'name'").select("value"), "SELECT DISTINCT c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey")
_add("win_common_corrections", lambda s, d: P.common_corrections(_table(s, d, "orders").selectExpr("'a' AS field", "o_orderstatus AS original", "o_orderpriority AS corrected"), 5), "SELECT 'a' AS field, o_orderstatus AS original, o_orderpriority AS corrected, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, original, corrected LIMIT 5")
_add("ext23_parse_with_errors", lambda s, d: B.parse(_table(s, d, "orders").selectExpr("o_orderkey AS source", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE ' ' END AS text"), "2024-06-01").select("source", "note", "number"), f"SELECT CAST(o_orderkey AS VARCHAR) AS source, 'LOW_TEXT' AS note, {C._NO} AS number FROM orders")
_add("msc01_batch_in_order", lambda s, d: B.parse(C._waybills(s, d), "2024-06-01", ["number"]).hint("merge").join(_table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("source"), F.col("o_orderkey").alias("pos")), "source").orderBy("pos").select("source", "number"), f"SELECT CAST(o_orderkey AS VARCHAR) AS source, {C._FIELD_SQL['number']} AS number FROM orders")

# --- profiles ------------------------------------------------------------------------------------------------
_OLD = json.dumps({"name": "a", "ocr": {"tesseract_timeout": 120, "engine": "other"}})


def _migrated(s: SparkSession, d: str) -> DataFrame:
    new = profiles.load(_OLD)
    row = (new["schema_version"], new["ocr"]["tesseract_timeout"], new["ocr"]["engine"], new["extract"]["kind"])
    return s.createDataFrame([row], "version int, timeout int, engine string, kind string").crossJoin(_table(s, d, "region").select("r_regionkey"))


_add("udf06_migrated_profile", _migrated, "SELECT r_regionkey, 11::INT AS version, 300::INT AS timeout, 'other' AS engine, 'tn_upd' AS kind FROM region")


def _stored(s: SparkSession, d: str) -> DataFrame:
    """Profiles of two folders, one name in both; and the archive of all."""
    base = S.shared_folder(s)
    for folder, names in (("builtin", ["b", "a"]), ("own", ["b", "0"])):
        profiles.store(f"{base}/{folder}", [{"name": n, "place": folder} for n in names])
    listed = profiles.listed(f"{base}/builtin", f"{base}/own")
    profiles.archive(f"{base}/all.zip", {"ui": {"theme": "dark"}}, listed)
    settings, back = profiles.unarchived(f"{base}/all.zip")
    rows = [(i, p["name"], p["place"], settings["ui"]["theme"]) for i, p in enumerate(back)]
    return s.createDataFrame(rows, "pos int, name string, place string, theme string")


_add("src23_listed_profiles", _stored, "SELECT * FROM (VALUES (0::INT, 'a', 'builtin', 'dark'), (1, 'b', 'own', 'dark'), (2, '0', 'own', 'dark')) AS t(pos, name, place, theme)")
_add("udf07_typed_settings", lambda s, d: profiles.typed(_table(s, d, "part").selectExpr("p_partkey", "to_json(named_struct('psm', p_size, 'mode', p_type, 'x', 1)) AS json"), "json", {"psm": ("int", 3, None), "mode": ("string", "ECONOMY", ["ECONOMY", "PROMO"]), "dpi": ("int", 300, None)}), "SELECT p_partkey, p_size AS psm, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE 'ECONOMY' END AS mode, 300::INT AS dpi FROM part")


# --- more of files and images ---------------------------------------------------------------------------------
def _mixed_files(s: SparkSession, d: str) -> DataFrame:
    """Files of one page each; one that is empty, one that only has the ending, and a text."""
    folder = f"{S.shared_folder(s)}/mixed"
    pdf.write(_table(s, d, "region").selectExpr("r_name AS doc", "1 AS page", "r_name AS text"), folder).count()
    for name, content in (("fake.PDF", b"plain"), ("empty.pdf", b""), ("a.txt", b"%PDF-")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content)
    return files.discover(s, [folder])


_file_name = lambda: F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
_REAL = "SELECT replace(r_name, ' ', '_') || '.pdf' AS name, true AS is_pdf FROM region"
_add("src02_pdf_files", lambda s, d: _mixed_files(s, d).where("is_pdf").select(_file_name()), f"SELECT name FROM ({_REAL})")
_add("src03_valid_paths", lambda s, d: _mixed_files(s, d).select(_file_name(), (F.col("length") > 0).alias("filled")), f"SELECT name, true AS filled FROM ({_REAL}) UNION ALL SELECT 'fake.PDF', true")
_add("src04_headers", lambda s, d: _mixed_files(s, d).select(_file_name(), "is_pdf"), f"{_REAL} UNION ALL SELECT 'fake.PDF', false")


def _scanned(s: SparkSession, d: str) -> DataFrame:
    folder = f"{S.shared_folder(s)}/scans"
    pages = I.process(_images(s, d, "any"), []).select((F.col("path").cast("long") % 5).alias("doc"), F.col("path").cast("long").alias("page"), "height", "width", "data")
    pdf.assemble(pages, folder).count()
    return pdf.rasters(s, folder)


_add("src11_rasters", lambda s, d: _scanned(s, d).select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc"), "page", "height", "width", F.hex("data").alias("data")), f"WITH {_px('any')} SELECT CAST(CAST(path AS BIGINT) % 5 AS VARCHAR) AS doc, CAST(row_number() OVER (PARTITION BY CAST(path AS BIGINT) % 5 ORDER BY CAST(path AS BIGINT)) AS INT) AS page, height, width, data FROM ({_shown('v')})")


def _archived(s: SparkSession, d: str) -> DataFrame:
    path = f"{S.shared_folder(s)}"
    profiles.store(path, [])
    profiles.archive(f"{path}/all.zip", {"recent": 10}, [{"name": r["r_name"]} for r in _table(s, d, "region").collect()])
    settings, own = profiles.unarchived(f"{path}/all.zip")
    return s.createDataFrame([(p["name"], p["schema_version"], settings["recent"]) for p in own], "name string, version int, recent int")


_add("snk16_archive", _archived, "SELECT r_name AS name, 11::INT AS version, 10::INT AS recent FROM region")
_image("img18_line_mask", "line", [("line_mask", {"horizontal": True, "least": 5})], "CASE WHEN y = 2 THEN 255 ELSE 0 END")
_PX["cross"] = "CASE WHEN y = 2 OR x = 3 THEN 0 ELSE 255 END"
_image("set04_lines_of_both_ways", "cross", [("lines", {"least": 5})], "255")
_add("img10_detected_angle", lambda s, d: I.skews(_images(s, d, "cross"), 5), "SELECT CAST(p_partkey AS VARCHAR) AS path, 0.0::DOUBLE AS skew FROM part")
_OSD = "CASE p_partkey % 3 WHEN 0 THEN 'Rotate: 180' || chr(10) || 'Orientation confidence: 4.5' WHEN 1 THEN 'Rotate: 180' || chr(10) || 'Orientation confidence: 0.5' ELSE '' END"
_add("img13_upright", lambda s, d: I.upright(_images(s, d, "any"), _table(s, d, "part").selectExpr("CAST(p_partkey AS STRING) AS path", f"{_OSD} AS osd")).select("path", "height", "width", F.hex("data").alias("data")), f"WITH {_px('any')} {_shown('v', y='CASE WHEN id % 3 = 0 THEN -y ELSE y END', x='CASE WHEN id % 3 = 0 THEN -x ELSE x END')}")
_add("img16_dominant_script", lambda s, d: _table(s, d, "part").select("p_partkey", F.array_join(D.narrowed_languages(F.array(F.lit("rus"), F.lit("eng")), D.script_language(F.concat(F.lit("Script: "), F.when(F.col("p_partkey") % 2 == 0, "Latin").otherwise("Cyrillic"), F.lit("\nScript confidence: "), (F.col("p_size") % 4).cast("string")))), "+").alias("langs")), "SELECT p_partkey, CASE WHEN p_size % 4 < 2 THEN 'rus+eng' WHEN p_partkey % 2 = 0 THEN 'eng' ELSE 'rus' END AS langs FROM part")
_over_part = lambda f: lambda s, d: _table(s, d, "part").select("p_partkey", f(F.col("p_size")).alias("k"))
_add("val23_odd_kernels", _over_part(lambda c: D.scaled_kernel(c, F.lit(300))), "SELECT p_partkey, CAST(CASE WHEN p_size % 2 = 0 THEN p_size + 1 ELSE p_size END AS INT) AS k FROM part")
_add("udf03_engines", lambda s, d: s.createDataFrame([(k, engines.get(k).name, engines.get(k).available()[0]) for k in ("fixed", "echo")], "kind string, name string, ready boolean"), "SELECT * FROM (VALUES ('fixed', 'fixed', true), ('echo', 'echo', true)) AS t(kind, name, ready)")
_add("udf04_engine_reads", lambda s, d: engines.recognise(_scans(s, d), engines.get("echo"), [{"input": "raw"}]).select("path", "page", "text", "confidence"), "SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS INT) AS page, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus || '-' || o_orderpriority END AS text, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 90.0 END::DOUBLE AS confidence FROM orders")
for _i, _n in enumerate(("msc20_first_retry", "msc21_second_retry", "msc22_last_retry")):
    _add(_n, lambda s, d, i=_i: engines.recognise(_scans(s, d), engines.get("echo"), [{}] * (i + 1) + [engines.TIERS[i]]).select("path", "page", "text", "tier"), f"SELECT CAST(o_custkey AS VARCHAR) AS path, CAST(o_orderkey AS INT) AS page, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus || '-' || o_orderpriority END AS text, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN {_i + 1} ELSE 0 END::INT AS tier FROM orders")
