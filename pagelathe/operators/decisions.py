"""Choices between readings of a word or page, and merges of what several engines found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import text as T


def better_script(word: Column, conf: Column, rus: Column, rus_conf: Column, eng: Column, eng_conf: Column, lead: float = 5) -> Column:
    """The Russian or English reading that leads the other by ``lead``; one alone must lead the word itself so."""
    r, e = F.coalesce(rus_conf, F.lit(-1.0)), F.coalesce(eng_conf, F.lit(-1.0))
    both, primary = (r >= 0) & (e >= 0), F.struct(word.alias("word"), conf.alias("conf"))
    russian, english = F.struct(rus.alias("word"), r.alias("conf")), F.struct(eng.alias("word"), e.alias("conf"))
    return F.when(both & (r >= e + lead), russian).when(both & (e >= r + lead), english).when(~both & (r >= conf + lead), russian).when(~both & (e >= conf + lead), english).otherwise(primary)


def accept_lift(word: Column, conf: Column, new: Column, new_conf: Column, lift: float = 10) -> Column:
    """A new reading that is not blank and at least ``lift`` points better, else the old one."""
    ok = (F.trim(F.coalesce(new, F.lit(""))) != "") & (new_conf >= conf + lift)
    return F.when(ok, F.struct(new.alias("word"), new_conf.alias("conf"))).otherwise(F.struct(word.alias("word"), conf.alias("conf")))


def replace_slots(words: DataFrame, again: DataFrame, lift: float = 5) -> DataFrame:
    """Blocks read again (page, block, word_num, word, conf) replace theirs if their mean is ``lift`` better.

    New words fill the block's slots in order; slots left over are blank with conf -1, words left over go.
    """
    means = lambda d, n: d.where("conf >= 0").groupBy("page", "block").agg(F.avg("conf").alias(n))
    taken = means(words, "old").join(means(again, "new"), ["page", "block"]).where(F.col("new") >= F.col("old") + lift).select("page", "block", F.lit(True).alias("taken"))
    slot = F.row_number().over(Window.partitionBy("page", "block").orderBy("word_num"))
    fresh = again.withColumn("slot", slot).select("page", "block", "slot", F.col("word").alias("w"), F.col("conf").alias("c"))
    w = words.withColumn("slot", slot).join(taken, ["page", "block"], "left").join(fresh, ["page", "block", "slot"], "left")
    new = lambda c, blank: F.when(F.col("taken"), F.coalesce(F.col("w" if c == "word" else "c"), F.lit(blank))).otherwise(F.col(c)).alias(c)
    return w.select("page", "block", "word_num", new("word", ""), new("conf", -1.0))


def first_tier(*tiers: Column) -> Column:
    """The first reading that is not null, and its tier's number."""
    cases = [F.when(t.isNotNull(), F.struct(F.lit(i).alias("tier"), t.alias("text"))) for i, t in enumerate(tiers)]
    return F.coalesce(*cases)


def retry_timeout(seconds: Column) -> Column:
    return F.least(F.greatest(seconds * 3, F.lit(600)), F.lit(900))


def fill_missing(value: Column, new: Column, missing: tuple[str, ...]) -> Column:
    """A model's answer only where a field is empty or unreadable."""
    empty = F.coalesce(value, F.lit("")).isin("", *missing)
    return F.when(empty & (F.trim(F.coalesce(new, F.lit(""))) != ""), F.trim(new)).otherwise(value)


def rotation(osd: Column, least: float = 1.0) -> Column:
    """The quarter turn that an orientation report asks for; null under ``least`` confidence."""
    turn = F.regexp_extract(osd, r"Rotate:\s*([0-9]+)", 1).try_cast("int")
    sure = F.regexp_extract(osd, r"Orientation confidence:\s*([0-9.]+)", 1).try_cast("double")
    return F.when(sure >= least, (F.bround(turn / 90) * 90 % 360).cast("int"))


def script_language(osd: Column, least: float = 2.0) -> Column:
    script, sure = F.regexp_extract(osd, r"Script:\s*(\w+)", 1), F.regexp_extract(osd, r"Script confidence:\s*([0-9.]+)", 1).try_cast("double")
    return F.when(sure >= least, F.when(script == "Cyrillic", "rus").when(script == "Latin", "eng"))


def scaled_kernel(size: Column, dpi: Column, least: int = 1) -> Column:
    """An odd kernel size for ``dpi``, of one set for 300; it never shrinks."""
    k = F.greatest(F.bround(size * F.greatest(F.coalesce(dpi, F.lit(300)), F.lit(300)) / 300).cast("int"), F.lit(least))
    return F.when(k % 2 == 0, k + 1).otherwise(k)


def advice(mean_conf: Column, n_pages: Column, n_empty: Column) -> Column:
    return F.when(n_pages == n_empty, "error").when((mean_conf > 0) & (mean_conf < 60), "other profile").otherwise("ok")


def row_level(overall: Column, note: Column) -> Column:
    return F.when(note.startswith("ERROR"), "ERR").when((overall < 0.5) | note.contains("LOW"), "WARN").otherwise("OK")


def percent(scalar: Column, parts: Column) -> Column:
    """A confidence as 0 to 100: the scalar, else the mean of the parts."""
    mean = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.coalesce(scalar, F.when(F.size(parts) > 0, mean), F.lit(0.0)) * 100).cast("int")))


def low_rows(rows: DataFrame, below: float = 0.4) -> DataFrame:
    """Parsed rows that a model should look at again."""
    return rows.where(F.col("overall") < below)


def documents_have_text(pages: DataFrame) -> DataFrame:
    """(doc, has_text): whether any page of (doc, page, text) is not blank."""
    return pages.groupBy("doc").agg(F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"))


def page_workers(pages: Column, cpus: Column, memory_mb: Column, most: int = 10, each_mb: int = 500) -> Column:
    """Pages read at once: as many as there are pages, cores and memory for, one at least. Unknown memory sets no bound."""
    by_memory = F.greatest(F.lit(1), F.floor(memory_mb / each_mb).cast("int"))
    return F.greatest(F.lit(1), F.least(F.greatest(pages, F.lit(1)), cpus, F.lit(most), F.coalesce(by_memory, F.lit(most))))


def narrowed_languages(languages: Column, detected: Column) -> Column:
    """The detected language alone if it is one of several, else the languages as they are."""
    return F.when(detected.isNotNull() & (F.size(languages) > 1) & F.array_contains(languages, detected), F.array(detected)).otherwise(languages)


def config_lines(params: Column) -> Column:
    """A recogniser's parameters as lines ``key value``; keys that are no names and values of several lines are left out, null if none is left."""
    fit = F.map_filter(params, lambda k, v: k.rlike(r"^[A-Za-z_][A-Za-z0-9_]*$") & ~v.rlike(r"[\n\r\x{00}]"))
    lines = F.transform(F.map_entries(fit), lambda e: F.concat(e["key"], F.lit(" "), e["value"]))
    return F.when(F.size(fit) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n")))


def engine_options(config: DataFrame) -> DataFrame:
    """A recogniser's options from settings (input, output, languages, oem, psm, optimize, skip_text, timeout, whitelist, blacklist, params)."""
    return config.select("input", "output", F.array_join("languages", "+").alias("language"), *[F.col(c).cast("int").alias(c) for c in ("oem", "psm", "optimize")], "skip_text", F.col("timeout").cast("double").alias("timeout"), "whitelist", "blacklist", config_lines(F.col("params")).alias("config"))


def crop_config(config: Column, mode: int = 6) -> Column:
    """A recogniser's options with the segmentation mode of one block."""
    plain = F.trim(F.regexp_replace(config, r"\s*--psm\s+\d+", ""))
    return F.trim(F.concat(plain, F.lit(f" --psm {mode}")))


def bypassed(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) of documents whose every page has a substantial text layer: kept as they are, at confidence 100."""
    whole = pages.groupBy("doc").agg(F.bool_and(T.is_substantial_page(F.coalesce("text", F.lit("")))).alias("whole")).where("whole").select("doc")
    return pages.join(whole, "doc", "left_semi").select("doc", "page", "text", F.lit(100.0).alias("mean_conf"))


def cached_pages(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages of jobs (job, key) as entries (key, pages array) hold them, what they lack by default; jobs without an entry have none."""
    held = jobs.join(entries, "key").select("job", F.posexplode("pages").alias("place", "p"))
    zero = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(c)
    return held.select("job", F.coalesce("p.page", F.col("place") + 1).alias("page"), F.coalesce("p.text", F.lit("")).alias("text"), zero("mean_conf"), zero("seconds"), zero("skew"), F.col("p.error").alias("error"))
