"""What is told of parsed rows, jobs and cached results: summaries, reports, names, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.operators import decisions as D
from pagelathe.operators import lookups as L

#: What a field reads when nothing, or nothing legible, was found.
NOT_FOUND = ("отсутствует", "неразборчиво")


def overall(parts: list[Column]) -> Column:
    """The mean of field confidences, two places."""
    return F.round(sum(parts[1:], parts[0]) / len(parts), 2)


def document_overall(rows: DataFrame) -> DataFrame:
    """(doc, overall): the mean of rows' ``overall``, three places, ties to even."""
    return rows.groupBy("doc").agg(F.bround(F.avg("overall"), 3).alias("overall"))


def problem_fields(confidences: dict[str, Column], values: dict[str, Column], below: float = 0.5) -> Column:
    """Names of fields that are unsure, or read nothing."""
    pairs = F.array(*[F.when((confidences[f] < below) | values[f].isin(*NOT_FOUND), F.lit(f)) for f in confidences])
    return F.array_compact(pairs)


def report_line(source: Column, overall_: Column, note: Column, waybill: Column, date: Column, problems: Column) -> Column:
    """A row's lines in the run's report: level and percent, then its error, or the waybill and what to look at."""
    head = F.concat(F.lit("["), F.rpad(D.row_level(overall_, note), 4, " "), F.lit("] "), F.lpad(F.bround(overall_ * 100).cast("int").cast("string"), 3, " "), F.lit("% | "), source)
    last = F.when(F.size(problems) > 0, F.concat(F.lit("Проверить: "), F.array_join(problems, ", "))).otherwise("Все поля распознаны.")
    body = F.concat(F.lit("       ├─ "), waybill, F.lit(" от "), date, F.lit("\n       └─ "), last)
    return F.concat(head, F.lit("\n"), F.when(note.startswith("ERROR:"), F.concat(F.lit("       └─ "), note)).otherwise(body))


def numbered(rows: DataFrame, keep: Column) -> DataFrame:
    """Rows (source, pos, …) that ``keep`` holds for, named ``source#k`` where a source has several; k counts before rows go."""
    w = Window.partitionBy("source")
    k, n = F.row_number().over(w.orderBy("pos")), F.count(F.lit(1)).over(w)
    named = F.when(n > 1, F.concat("source", F.lit("#"), k.cast("string"))).otherwise(F.col("source"))
    return rows.withColumn("__name", named).where(keep).withColumn("source", F.col("__name")).drop("__name")


def margin(scores: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """(key, value, score, lead): each key's best and its lead over the second, null without one; ties by value.

    The rank's limit reaches below the shuffle, so a hot key is two rows a task.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), value)
    top = scores.select(key, value, score).withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    best = F.max(F.when(F.col("__k") == 1, F.struct(score, value))).alias("m")
    g = top.groupBy(key).agg(best, F.max(F.when(F.col("__k") == 2, F.col(score))).alias("second"))
    return g.select(key, f"m.{value}", f"m.{score}", (F.col(f"m.{score}") - F.col("second")).alias("lead"))


def paired(files: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files with the truth of their stem, and those without one."""
    return files.join(truths, "stem"), files.join(truths.select("stem"), "stem", "left_anti")


def by_field(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field")


def common_corrections(corrections: DataFrame, most: int = 10) -> DataFrame:
    """The ``most`` frequent (field, original, corrected)."""
    return corrections.groupBy("field", "original", "corrected").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field", "original", "corrected").limit(most)


def merged_maps(held: Column, fresh: Column) -> Column:
    """``held``, and what ``fresh`` has beyond its keys."""
    return F.map_concat(held, F.map_filter(fresh, lambda k, _: ~F.map_contains_key(held, k)))


def languages(first: Column, others: Column) -> Column:
    """A recogniser's languages: the first one, then the others once each, joined by ``+``."""
    return F.array_join(F.array_distinct(F.concat(F.array(first), others)), "+")


def set_status(items: DataFrame, wishes: DataFrame) -> DataFrame:
    """Items (job, status, …) after the last wish (job, seq, wish) of each: paused, pending again, or cancelled."""
    last = wishes.groupBy("job").agg(F.max(F.struct("seq", "wish")).alias("m")).select("job", F.col("m.wish").alias("__wish"))
    to = F.when(F.col("__wish") == "pause", "paused").when(F.col("__wish") == "resume", "pending").when(F.col("__wish") == "cancel", "cancelled").otherwise(F.col("status"))
    return items.join(last, "job", "left").withColumn("status", to).select(*items.columns)


def cache_lookup(jobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Jobs (job, key) with the cached ``result`` of their key, null if there is none or the key is empty."""
    return jobs.join(entries.select("key", "result").where("key <> '' and result is not null").dropDuplicates(["key"]), "key", "left").select("job", "key", "result")


def cache_store(entries: DataFrame, new: DataFrame, max_bytes: int) -> DataFrame:
    """Entries (bucket, key, size, mtime) with ``new`` in place of those of its keys, the oldest beyond ``max_bytes`` gone."""
    both = entries.join(new.select("bucket", "key"), ["bucket", "key"], "left_anti").unionByName(new)
    gone = L.evict(both, max_bytes).select("bucket", "key")
    return both.join(gone, ["bucket", "key"], "left_anti")


def unique_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(id, path, name) of (id, path): ``path`` where it is free, else with the first free `` (k)`` before its ending.

    One path's requests are numbered by id; numbers that ``taken`` (path) holds are passed by. Requests
    for a name that is numbered already count as a path of their own.
    """
    form = r"(?s)^(.*?)(?: \(([1-9][0-9]{0,8})\))?(\.[^./]+)?$"
    ending = F.regexp_extract("path", r"(?s)(\.[^./]+)?$", 0)
    root = F.substr(F.col("path"), F.lit(1), F.length("path") - F.length(ending))
    asked = wanted.select("id", "path", root.alias("root"), ending.alias("ending")).withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy("id")) - 1)
    held = taken.select("path").distinct()
    as_number = held.select(F.concat(F.regexp_extract("path", form, 1), F.regexp_extract("path", form, 3)).alias("path"), F.regexp_extract("path", form, 2).try_cast("int").alias("n"))
    numbers = as_number.where("n is not null").unionByName(held.select("path", F.lit(0).alias("n")))
    # the r-th used number n is passed by those that would get n - r or more
    w = Window.partitionBy("path").orderBy("n")
    skips = numbers.distinct().select("path", (F.col("n") - F.row_number().over(w) + 1).alias("from_k"))
    past = asked.join(skips, "path").where(F.col("from_k") <= F.col("k")).groupBy("id").agg(F.count(F.lit(1)).alias("past"))
    n = F.col("k") + F.coalesce("past", F.lit(0))
    return asked.join(past, "id", "left").select("id", "path", F.when(n == 0, F.col("path")).otherwise(F.concat("root", F.lit(" ("), n.cast("string"), F.lit(")"), "ending")).alias("name"))


def average_confidence(pages: DataFrame) -> DataFrame:
    """(job, mean_conf): the mean of a job's page confidences over 0, or 0."""
    return pages.groupBy("job").agg(F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("mean_conf"))


def cache_key(content: Column, profile: Column, version: str) -> Column:
    """Names a result by what it came of: 16 digits of the content's digest, 16 of the profile's, the version."""
    return F.concat_ws("--", F.left(F.sha2(content, 256), F.lit(16)), F.left(F.sha2(profile, 256), F.lit(16)), F.lit(version))


def signature(path: Column, size: Column, changed: Column, version: str) -> Column:
    """Names a file by its path, size and time of change in whole seconds."""
    return F.sha1(F.concat_ws("|", path, size.cast("string"), F.unix_seconds(changed.cast("timestamp")).cast("string"), F.lit(version)))


def confidence_colour(percent: Column) -> Column:
    """The colour of a cell: red under 50, yellow under 70, else green."""
    return F.when(percent < 50, "red").when(percent < 70, "yellow").otherwise("green")
