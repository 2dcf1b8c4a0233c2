"""Joins and lookups: catalogs, dictionaries, corrections, registries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from pagelathe.functions import validators as V
from pagelathe.operators.forms import FORM_DATES

#: A side is broadcast if it is known to have no more bytes of text than this, 16 bytes a row and column included.
BROADCAST_BYTES = 16 << 20


def _side(df: DataFrame) -> DataFrame:
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in df.columns), F.lit(0))
    small = (df.agg(F.sum(size).alias("n")).first()["n"] or 0) <= BROADCAST_BYTES
    # what is exploded is larger than its file: Spark would take the file's size and broadcast it all the same
    return F.broadcast(df) if small else df.hint("merge")


def catalog_fix(tokens: DataFrame, catalog: DataFrame, kind: Callable[[Column], Column] = lambda _: F.lit("")) -> DataFrame:
    """token, fixed: the token if the catalog has it, else its only neighbour there by one digit's substitution or one deletion.

    A substitution's two sides agree once the sign is blanked out, so both give their strings with each
    sign blanked in turn, and tokens those with one sign less: some 20 keys a token, not 100 neighbours.
    Tokens meet values of their own ``kind`` (a string) alone.
    """
    t = tokens.select("token").distinct()

    def blanked(c: Column, which: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.length(c)), lambda i: which | F.substr(c, i, F.lit(1)).rlike("[0-9]"))
        masks = F.transform(at, lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.lit("\x00"), F.substr(c, i + 1, F.length(c))))
        return F.when(F.length(c) > 0, masks).otherwise(F.array().cast("array<string>"))

    v, k = F.col("value"), F.col("token")
    values = catalog.select("value").where("value is not null").distinct()
    keyed = values.select("value", F.explode(F.concat(F.array(v), blanked(v, F.lit(False)))).alias("key")).withColumn("key", F.concat(kind(v), "key"))
    near = t.where("token is not null").select("token", F.explode(F.concat(F.array(k), V.deletions(k), blanked(k, F.lit(True)))).alias("key")).withColumn("key", F.concat(kind(k), "key"))
    # one pair may meet on several keys: least and greatest tell whether there is one value, however often it is met
    hits = near.join(_side(keyed), "key").groupBy("token").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.bool_or(v == k).alias("own"))
    fixed = F.when(F.col("own"), k).when(F.col("low") == F.col("high"), F.col("low"))
    return t.join(hits, "token", "left").select("token", fixed.alias("fixed"))


def closest_word(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """word, match, dist: the nearest entry of (entry, pos) within one edit, two from six signs on.

    Both sides give their strings with up to two signs deleted; sharing one is necessary for the
    distance, so an equi-join finds all candidates and ``levenshtein`` decides.
    """
    w = words.select("word").distinct().withColumn("most", F.when(F.length("word") < 6, 1).otherwise(2))

    def deleted(c: Column) -> Column:
        one = F.concat(F.array(c), V.deletions(c))
        return F.array_distinct(F.flatten(F.transform(one, lambda x: F.concat(F.array(x), V.deletions(x)))))

    a = w.select("word", "most", F.explode(deleted(F.col("word"))).alias("part"))
    b = dictionary.select("entry", "pos", F.explode(deleted(F.col("entry"))).alias("part"))
    met = a.join(b, "part").select("word", "most", "entry", "pos").distinct().withColumn("dist", F.levenshtein("word", "entry")).where("dist <= most")
    best = met.groupBy("word").agg(F.min(F.struct("dist", F.length("entry").alias("n"), "pos", "entry")).alias("m"))
    return best.select("word", F.col("m.entry").alias("match"), F.col("m.dist").alias("dist"))


def insert_if_absent(registry: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return registry.unionByName(new.join(registry, key, "left_anti").dropDuplicates([key]))


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; minima pre-aggregate, so a hot key is no window of its own."""
    rest = [c for c in df.columns if c != key]
    pick = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(key).agg(F.min(pick).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in rest])


def diff_rows(snapshot: DataFrame, corrected: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, original, corrected, kind for each field that differs once stripped."""
    c = corrected.select(key, *[F.col(f).alias(f"c_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(f, F.lit(""))).alias("original"), F.trim(F.coalesce(f"c_{f}", F.lit(""))).alias("corrected")) for f in fields])
    d = snapshot.join(c, key).select(key, F.explode(pairs).alias("p")).select(key, "p.*").where("original <> corrected")
    return d.withColumn("kind", kind_of(F.col("original"), F.col("corrected")))


def kind_of(original: Column, corrected: Column) -> Column:
    """What a correction does: fill an empty value, clear one, or fix it; null counts as empty."""
    return F.when(F.coalesce(original, F.lit("")) == "", "fill").when(F.coalesce(corrected, F.lit("")) == "", "clear").otherwise("fix")


def registry(rows: DataFrame, organisations: DataFrame) -> DataFrame:
    """``rows`` (inn, ...) with what ``organisations`` (inn, ...) has of valid tax numbers; nulls for others."""
    known = organisations.where(V.is_inn(F.col("inn"))).dropDuplicates(["inn"])
    return rows.join(_side(known), "inn", "left").select(*rows.columns, *[c for c in organisations.columns if c != "inn"])


def fill_from_engine(pages: DataFrame, engine: DataFrame) -> DataFrame:
    """Pages (doc, page, text, conf) whose empty text or missing confidence comes from the engine's page of that number."""
    e = engine.select("doc", "page", F.col("text").alias("__text"), F.col("conf").alias("__conf"))
    joined = pages.join(e, ["doc", "page"], "left")
    return joined.select("doc", "page", F.coalesce(F.nullif(F.col("text"), F.lit("")), "__text").alias("text"), F.coalesce("conf", "__conf").alias("conf"))


def ordered_distinct(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Each key once, at its first place."""
    return df.groupBy(key).agg(F.min(pos).alias(pos))


def only_known(candidates: Column, known: Column) -> Column:
    """The one candidate that is known; null if none or several are."""
    both = F.array_intersect(candidates, known)
    return F.when(F.size(both) == 1, F.get(both, F.lit(0)))


def recent(uses: DataFrame, owner: str, value: str, order: str, most: int = 10) -> DataFrame:
    """(owner, recent): each owner's distinct values, the last used first, at most ``most``."""
    last = uses.groupBy(owner, value).agg(F.max(order).alias("__last"))
    top = last.withColumn("__k", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("__last")))).where(F.col("__k") <= most)
    return top.groupBy(owner).agg(F.sort_array(F.collect_list(F.struct("__k", value)))[value].alias("recent"))


def first_pages(pages: DataFrame, most: int | None) -> DataFrame:
    """Pages up to number ``most``; all without one."""
    return pages if most is None else pages.where(F.col("page") <= most)


def own_date(day: Column) -> Column:
    """A date, but null for those printed on the form itself."""
    return F.when(~day.isin(*sorted(FORM_DATES)), day)


def evict(entries: DataFrame, max_bytes: int) -> DataFrame:
    """Entries (key, size, mtime) beyond the newest that fit ``max_bytes``, per cache ``bucket``; entries without a time are the oldest.

    Sizes are added up by day first. Days that fit, and days beyond, need no order within; only the day in which
    the bytes run out is ordered entry by entry.
    """
    # times as seconds or as timestamps
    seconds = isinstance(entries.schema["mtime"].dataType, NumericType)
    day = F.coalesce(F.floor(F.col("mtime") / 86_400), F.lit(-(1 << 62))) if seconds else F.coalesce(F.to_date("mtime"), F.lit("0001-01-01").cast("date"))
    dated = entries.withColumn("__day", day)
    days = dated.groupBy("bucket", "__day").agg(F.sum("size").alias("__own"))
    newest = Window.partitionBy("bucket").orderBy(F.desc("__day")).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("__upto", F.sum("__own").over(newest)).where(F.col("__upto") > max_bytes)
    placed = dated.join(days, ["bucket", "__day"]).withColumn("__before", F.col("__upto") - F.col("__own"))
    within = Window.partitionBy("bucket").orderBy(F.desc_nulls_last("mtime"), "key").rowsBetween(Window.unboundedPreceding, 0)
    last = placed.where(F.col("__before") <= max_bytes).withColumn("__at", F.col("__before") + F.sum("size").over(within)).where(F.col("__at") > max_bytes)
    return placed.where(F.col("__before") > max_bytes).select(*entries.columns).unionByName(last.select(*entries.columns))


def islands(pages: DataFrame) -> DataFrame:
    """(doc, page, kind) to groups: each ``start`` page opens one, ``cont`` pages follow it, others leave."""
    w = Window.partitionBy("doc").orderBy("page")
    g = pages.withColumn("grp", F.sum(F.when(F.col("kind") == "start", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.where("grp > 0 and kind in ('start', 'cont')").select("doc", "page", "grp")


def section_ends(marks: DataFrame) -> DataFrame:
    """(doc, role, pos, stop) of marks (doc, pos, role): the first of each role, up to the next one; null at the end."""
    first = marks.groupBy("doc", "role").agg(F.min("pos").alias("pos"))
    return first.withColumn("stop", F.lead("pos").over(Window.partitionBy("doc").orderBy("pos"))).select("doc", "role", "pos", "stop")


def fix_identifiers(docs: DataFrame, catalog: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with numbers of 10 to 15 digits in ``column`` replaced by their one neighbour in ``catalog`` (value).

    Numbers that the catalog has, and valid ones that it has not, stay. Numbers of 10 to 12 digits look
    among catalog values of 10 or 12, longer ones among those of 13 or 15. Tokens are fixed once each and
    come back by ``key``, which is a document's own. Documents are dealt by it once, and all that reads them reads that:
    what was done to their text before is not done again.
    """
    docs = docs.repartition(key)
    pattern = r"(?U)\b\p{Nd}{10,15}\b"
    # outer, as a filter on the list's size would go below the dealing and make another of it
    pairs = docs.select(key, F.explode_outer(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))).alias("token"))
    open_tokens = pairs.where(F.col("token").isNotNull() & ~V.is_inn(F.col("token")) & ~V.is_ogrn(F.col("token")))
    values = catalog.where(F.length("value").isin(10, 12, 13, 15)).select("value")
    kind = lambda c: F.when(F.length(c) <= 12, "small ").otherwise("large ")
    fixed = catalog_fix(open_tokens.select("token"), values, kind).where("fixed is not null and fixed <> token")
    found = open_tokens.join(fixed, "token").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "fixed"))).alias("__fixes"))
    text, back = F.col(column), F.transform(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0)), lambda t: F.coalesce(F.try_element_at(F.col("__fixes"), t), t))
    woven = F.array_join(F.zip_with(F.split(text, pattern, -1), back, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return docs.join(found, key, "left").withColumn(column, F.when(F.col("__fixes").isNull(), text).otherwise(woven)).drop("__fixes").select(*docs.columns)
