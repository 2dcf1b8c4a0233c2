"""The ten operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import chat, decontaminate, langid, packing, pii, quality, simhash, substring_dedup, token_counts, url_filter

#: A demonstration key; a deployment passes its own.
PII_KEY = "pagelathe-demonstration-key"

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(rows, model, ("doc_id", "held_out"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    ops = [op1_substring_dedup, op2_simhash_near_dedup, op3_token_counts, op4_url_filters, op5_chat_formatting, op6_quality_rules, op7_decontamination, op8_packing, op9_pii, op10_language_id]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_TERMS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_SHINGLES = "list_distinct(list_transform(range(1, greatest(len(ws) - {k} + 2, 1)), lambda i: array_to_string(ws[i:i + {k} - 1], ' ')))"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return {
        "op1_substring_dedup": f"""
            WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
            win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k
                    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
            own AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
            hit AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN own USING (k) WHERE doc_id > m)),
            gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
            SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
                   sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
            FROM w LEFT JOIN gone USING (doc_id)""",
        "op4_url_filters": f"""
            WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host,
                              coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            r(h, q, v) AS (VALUES {rules}),
            m AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC, length(h) DESC) AS k
                  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
            SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND k = 1""",
        "op5_chat_formatting": r"""
            WITH c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, chr(1)), t := coalesce(text, chr(1))) ORDER BY turn, role, text) AS ts, count(*) AS n,
                              string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
                       FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
            e AS (SELECT min(conv_id) AS conv_id, count(*) AS n_equal, ts, n FROM c GROUP BY ts, n)
            SELECT e.conv_id, CAST(e.n AS INTEGER) AS n_turns, n_equal, rendered FROM e JOIN c USING (conv_id)
            WHERE NOT EXISTS (SELECT 1 FROM c l WHERE l.n > e.n AND l.ts[1] = e.ts[1] AND l.ts[1:e.n] = e.ts)""",
        "op7_decontamination": f"""
            WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents WHERE text IS NOT NULL),
            b AS (SELECT item_id, {_TERMS} AS ws FROM benchmark WHERE text IS NOT NULL),
            k AS (SELECT 5 AS k UNION SELECT len(ws) FROM b WHERE len(ws) BETWEEN 1 AND 4),
            ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest({_SHINGLES.format(k="k")}) AS s FROM d, k)),
            bs AS (SELECT item_id, unnest({_SHINGLES.format(k="least(len(ws), 5)")}) AS s FROM b WHERE len(ws) > 0),
            n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
            f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
            SELECT doc_id, item_id, n_item, n_found, n_found / n_item AS containment FROM f JOIN n USING (item_id) WHERE n_found >= ceil(0.8 * n_item - 1e-9)""",
    }
