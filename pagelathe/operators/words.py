"""Operators over the word table of recognised pages: page, block, par, line, word_num, word, conf, left, top, width, height.

Rows with conf under 0 are structural. Pages are small and many, so groups are by page and below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelathe.functions import text as T
from pagelathe.operators import decisions as D
from pagelathe.operators import lookups as L


def real(words: DataFrame) -> DataFrame:
    return words.where("conf >= 0 and word is not null and trim(word) <> ''")


def page_confidence(words: DataFrame) -> DataFrame:
    return real(words).groupBy("page").agg(F.avg("conf").alias("mean_conf"), F.count(F.lit(1)).alias("n_words"))


def adaptive_threshold(mean_conf: Column, base: float) -> Column:
    """Cleaner pages get a lower threshold, poor ones a higher."""
    return F.when(mean_conf >= 90, F.least(F.lit(base), F.lit(40.0))).when(mean_conf < 70, F.greatest(F.lit(base), F.lit(70.0))).otherwise(F.lit(base))


def block_aggregates(words: DataFrame) -> DataFrame:
    boxes = [F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")]
    return real(words).groupBy("page", "block").agg(F.avg("conf").alias("mean_conf"), F.count(F.lit(1)).alias("n_words"), *boxes)


def rescue_candidates(words: DataFrame, below: float = 60, least: int = 3) -> DataFrame:
    return block_aggregates(words).where((F.col("mean_conf") < below) & (F.col("n_words") >= least))


def noisy_blocks(words: DataFrame, min_confidence: float = 60, least: int = 3, ratio: float = 0.5) -> DataFrame:
    """Blocks of at least ``least`` words with at least ``ratio`` of them under the threshold, and their boxes."""
    boxes = [F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")]
    g = real(words).groupBy("page", "block").agg(F.count(F.lit(1)).alias("n_words"), F.count_if(F.col("conf") < min_confidence).alias("n_low"), *boxes)
    return g.where((F.col("n_words") >= least) & (F.col("n_low") >= F.col("n_words") * ratio))


def handwritten(words: DataFrame, below: float = 40, least: int = 3) -> DataFrame:
    g = real(words).groupBy("page", "block", "par").agg(F.avg("conf").alias("mean_conf"), F.count(F.lit(1)).alias("n_words"))
    return g.where((F.col("mean_conf") < below) & (F.col("n_words") >= least)).select("page", "block", "par")


def rebuild_text(words: DataFrame, min_confidence: float) -> DataFrame:
    """Words at or over the threshold as lines, lines as the page's text."""
    line = real(words).where(F.col("conf") >= min_confidence).groupBy("page", "block", "par", "line").agg(F.sort_array(F.collect_list(F.struct("word_num", "word"))).alias("ws"))
    line = line.select("page", F.struct("block", "par", "line", F.array_join(F.col("ws.word"), " ").alias("text")).alias("l"))
    return line.groupBy("page").agg(F.sort_array(F.collect_list("l")).alias("ls")).select("page", F.array_join(F.col("ls.text"), "\n").alias("text"))


def low_words(words: DataFrame, threshold: float) -> DataFrame:
    low = real(words).where(F.col("conf") < threshold)
    return low.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("block", "par", "line", "word_num", "word"))).alias("ws")).select("page", F.array_join(F.col("ws.word"), "|").alias("low"))


def padded_box(words: DataFrame, pad: int, page_width: int, page_height: int) -> DataFrame:
    x0, y0 = F.greatest(F.lit(0), F.col("left") - pad), F.greatest(F.lit(0), F.col("top") - pad)
    x1, y1 = F.least(F.lit(page_width), F.col("left") + F.col("width") + pad), F.least(F.lit(page_height), F.col("top") + F.col("height") + pad)
    return words.select("page", "word_num", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def redactions(words: DataFrame, min_confidence: float, scale: float) -> DataFrame:
    """Boxes of words under the threshold, and of noisy blocks, in the page's own units."""
    low = real(words).where(F.col("conf") < min_confidence).select("page", F.lit("word").alias("kind"), (F.col("left") * scale).alias("x0"), (F.col("top") * scale).alias("y0"), ((F.col("left") + F.col("width")) * scale).alias("x1"), ((F.col("top") + F.col("height")) * scale).alias("y1"))
    noisy = noisy_blocks(words, min_confidence).select("page", F.lit("block").alias("kind"), *[(F.col(c) * scale).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return low.unionByName(noisy)


def histogram(words: DataFrame, buckets: int = 10) -> DataFrame:
    """Equal buckets over 0..100; 100 is in the last."""
    return real(words).groupBy(F.least(F.floor(F.col("conf") * buckets / 100).cast("int"), F.lit(buckets - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def top_words(words: DataFrame, threshold: float, n: int) -> DataFrame:
    """The ``n`` words most often kept."""
    g = real(words).where(F.col("conf") >= threshold).groupBy("word").agg(F.avg("conf").alias("mean_conf"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "word").limit(n)


def best_word(words: DataFrame) -> DataFrame:
    """The most confident word of each page, the first on ties."""
    w = Window.partitionBy("page").orderBy(F.desc("conf"), "word_num")
    return real(words).withColumn("k", F.row_number().over(w)).where("k = 1").select("page", "word", "conf")


def soft_rescue(words: DataFrame, threshold: float) -> DataFrame:
    """Words somewhat under the threshold that are of one script, or hold a digit, and three signs long."""
    low = max(threshold - 15, 45)
    ok = (F.length("word") >= 3) & (F.col("word").rlike(r"\p{Nd}") | F.col("word").rlike("^[А-Яа-яЁё]+$") | F.col("word").rlike("^[A-Za-z]+$"))
    return real(words).where((F.col("conf") >= low) & (F.col("conf") < threshold) & ok)


def report(words: DataFrame, threshold: float) -> DataFrame:
    """Kept and dropped words of each page, and of all under a null page."""
    kept = F.count_if(F.col("conf") >= threshold)
    return real(words).rollup("page").agg(F.count(F.lit(1)).alias("n_words"), kept.alias("n_kept"), F.avg("conf").alias("mean_conf"))


def swapped_confidence(conf: Column, swapped: Column, floor: float = 80.0) -> Column:
    """A word whose script was swapped is at least ``floor`` sure."""
    return F.when(swapped, F.greatest(conf, F.lit(floor))).otherwise(conf)


def block_confidence(words: DataFrame) -> DataFrame:
    """(page, block, mean_conf, n_words) over real words."""
    return real(words).groupBy("page", "block").agg(F.avg("conf").alias("mean_conf"), F.count(F.lit(1)).alias("n_words"))


def rescored(words: DataFrame, threshold: float) -> DataFrame:
    """Per page all and kept words, and the mean confidence of each; 0 where none is kept."""
    kept = F.col("conf") >= threshold
    means = [F.avg("conf").alias("mean_all"), F.coalesce(F.avg(F.when(kept, F.col("conf"))), F.lit(0.0)).alias("mean_kept")]
    return real(words).groupBy("page").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(kept).alias("n_kept"), *means)


def image_rescuable(word: Column, conf: Column, low: float = 30, high: float = 70) -> Column:
    """Worth reading again from its image: of middling confidence, two signs long, with a letter or digit."""
    return conf.between(low, high) & (F.length(word) >= 2) & word.rlike(r"[\p{L}\p{N}]")


def upscale_rescue(words: DataFrame, again: DataFrame, below: float = 80, lift: float = 10) -> DataFrame:
    """Words under ``below`` that a reading of the enlarged image (page, word_num, new, new_conf) betters by ``lift``."""
    w = words.join(again.select("page", "word_num", "new", "new_conf"), ["page", "word_num"], "left")
    better = D.accept_lift(F.col("word"), F.col("conf"), F.col("new"), F.col("new_conf"), lift)
    return _with(w, words.columns, F.when(F.col("conf") < below, better).otherwise(F.struct("word", "conf")))


def _with(joined: DataFrame, columns: list[str], chosen: Column) -> DataFrame:
    """``columns`` of ``joined`` with word and conf from the struct ``chosen``."""
    out = joined.withColumn("__c", chosen)
    return out.select(*[F.col(f"__c.{c}").alias(c) if c in ("word", "conf") else F.col(c) for c in columns])


def contains(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Rows of ``words`` whose word an entry of (entry) equals, letters of either case."""
    return words.join(dictionary.select(F.lower("entry").alias("__e")).distinct(), F.lower("word") == F.col("__e"), "left_semi")


def dictionary_rescue(words: DataFrame, dictionary: DataFrame, floor: float = 85) -> DataFrame:
    """Rescuable words by (entry, pos): members stay, others become their nearest entry; both are ``floor`` sure at least."""
    band = T.is_rescuable(F.col("word"), F.col("conf"))
    tokens = words.where(band).select("word").distinct()
    members = contains(tokens, dictionary).select("word", F.col("word").alias("match"))
    fixed = L.closest_word(tokens.join(members, "word", "left_anti"), dictionary).select("word", "match")
    found = members.unionByName(fixed)
    chosen = F.when(band & F.col("match").isNotNull(), F.struct(F.col("match").alias("word"), F.greatest("conf", F.lit(float(floor))).alias("conf"))).otherwise(F.struct("word", "conf"))
    return _with(words.join(found, "word", "left"), words.columns, chosen)


def overlay(words: DataFrame, threshold: float) -> DataFrame:
    """Boxes of words at or over ``threshold`` with their colour, from red at 0 to green at 100."""
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / 100))
    colour = [F.floor(a * (1 - f) + b * f).cast("int").alias(n) for n, a, b in (("red", 239, 34), ("green", 68, 197), ("blue", 68, 94))]
    return words.where(F.col("conf") >= threshold).select("page", "word_num", "left", "top", "width", "height", *colour)


def chain(words: DataFrame, scripts: DataFrame | None = None, sharpened: DataFrame | None = None, enlarged: DataFrame | None = None, blocks: DataFrame | None = None, dictionary: DataFrame | None = None, base: float = 60, adaptive: bool = True) -> dict[str, DataFrame]:
    """The word table of recognised pages through all its repairs, each if its second reading is given.

    ``scripts`` (page, word_num, rus, rus_conf, eng, eng_conf), ``sharpened`` and ``enlarged`` (page, word_num, new,
    new_conf), ``blocks`` (page, block, word_num, word, conf), ``dictionary`` (entry, pos). Gives ``words``, and per page
    ``pages`` (page, mean_conf, n_words, threshold, text, low), and ``handwritten`` blocks. A page without kept words has null text.
    """
    w = words
    if scripts is not None:
        s = w.join(scripts, ["page", "word_num"], "left").withColumn("__b", D.better_script(F.col("word"), F.col("conf"), F.col("rus"), F.col("rus_conf"), F.col("eng"), F.col("eng_conf")))
        swapped = ~F.col("__b.word").eqNullSafe(F.col("word"))
        w = _with(s, words.columns, F.struct(F.col("__b.word").alias("word"), F.when(swapped, swapped_confidence(F.col("__b.conf"), swapped)).otherwise(F.col("conf")).alias("conf")))
    if sharpened is not None:
        s = w.join(sharpened.select("page", "word_num", "new", "new_conf"), ["page", "word_num"], "left")
        w = _with(s, words.columns, F.when(image_rescuable(F.col("word"), F.col("conf")), D.accept_lift(F.col("word"), F.col("conf"), F.col("new"), F.col("new_conf"))).otherwise(F.struct("word", "conf")))
    if enlarged is not None:
        w = upscale_rescue(w, enlarged)
    if blocks is not None:
        poor = rescue_candidates(w).select("page", "block")
        slots = D.replace_slots(w.join(poor, ["page", "block"], "left_semi"), blocks.join(poor, ["page", "block"], "left_semi"))
        s = w.join(slots.select("page", "block", "word_num", F.col("word").alias("__w"), F.col("conf").alias("__v")), ["page", "block", "word_num"], "left")
        w = _with(s, words.columns, F.struct(F.coalesce("__w", "word").alias("word"), F.coalesce("__v", "conf").alias("conf")))
    if dictionary is not None:
        w = dictionary_rescue(w, dictionary)
    means = page_confidence(w).withColumn("threshold", adaptive_threshold(F.col("mean_conf"), base) if adaptive else F.lit(float(base)))
    judged = w.join(means.select("page", "threshold"), "page")
    text = rebuild_text(judged.where(F.col("conf") >= F.col("threshold")).select(*words.columns), 0)
    low = low_words(judged.where(F.col("conf") < F.col("threshold")).select(*words.columns), 101)
    pages = means.join(text, "page", "left").join(low, "page", "left")
    return {"words": w, "pages": pages.select("page", "mean_conf", "n_words", "threshold", "text", "low"), "handwritten": handwritten(w)}
