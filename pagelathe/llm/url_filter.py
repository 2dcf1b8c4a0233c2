"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefixes.

Distinct (host, path) pairs are expanded to the host suffixes and path prefixes of the
lengths (in labels, and in signs) that some rule has; an expression meets rules through the first 32 bits of its SHA-256,
full digests confirm, and precedence picks among the rules that fit. Verdicts return to
the rows by (host, path): those of pairs that many rows have meet a broadcast, so no url is one task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelathe.llm.graph import HOT

#: Rules of so many bytes are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x1f"), path), 256)


def _short(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages`` (page_id, url).

    ``rules``: host, path, verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains if the path starts with the rule's. The longest host and path together wins, then
    the longer host, then block over allow. Without a fitting rule: rule null, ``default``.
    A null url, or one without ``://``, has empty host and path and meets no rule but one of an empty host.
    Rules with null host or path are ignored; repeated rules count once. Repeated pages and null ids are kept.
    """
    rules = rules.select("host", "path", "verdict").where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    rules = rules.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("n_host"), F.length("path").alias("n_path"), (F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1).alias("n_labels"), _digest(F.col("host"), F.col("path")).alias("digest"))
    rules = rules.withColumn("short", _short(F.col("digest")))
    # as many distinct lengths as rules' hosts and paths have: a few hundred numbers at most, as urls are bounded
    facts = rules.agg(F.collect_set("n_path").alias("paths"), F.collect_set("n_labels").alias("labels"), F.sum(F.octet_length("rule") + 100).alias("size")).first()
    lengths, labels = sorted(facts["paths"]), sorted(facts["labels"])
    side = F.broadcast(rules) if (facts["size"] or 0) <= BROADCAST_BYTES else rules

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the same url from many map tasks meets in a few tasks before it meets in one
    pairs = rows.groupBy("host", "path", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("host", "path").agg(F.sum("n").alias("n"))
    # a host of fewer labels than the rules have is passed by
    has = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    suffixes = F.array_compact(F.array(*[F.when(has >= n, F.substring_index("host", ".", -n)) for n in labels] or [F.lit(None).cast("string")]))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths] or [F.lit(-1)]), lambda n: (n >= 0) & (n <= F.length("path")))
    grown = pairs.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("sizes"))
    grown = grown.select("host", "path", "suffix", F.explode("sizes").alias("size"))
    digest = _digest(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("size")))
    grown = grown.select("host", "path", digest.alias("full")).withColumn("short", _short(F.col("full")))
    met = grown.join(side, "short").where("full = digest")
    rank = F.struct((F.col("n_host") + F.col("n_path")).alias("n"), "n_host", "verdict", "rule")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    # pairs of over one in HOT rows, with a rule or without: fewer than HOT, so they are broadcast
    hot = F.broadcast(pairs.where(F.col("n") * HOT > rows.count()).select("host", "path").join(best, ["host", "path"], "left"))
    rest = rows.join(hot.select("host", "path"), ["host", "path"], "left_anti").join(best, ["host", "path"], "left")
    out = rows.join(hot, ["host", "path"]).select(*rest.columns).unionByName(rest)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


__all__ = ["filter_urls", "host_of", "path_of"]
