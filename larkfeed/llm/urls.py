"""URL filters (operator 3), with DataFrame functions alone.

A url is expanded into host-suffix and path-prefix expressions, the way safe-browsing lists do: every
suffix of its host at a label's start with every prefix of its path. Only suffixes of as many labels
and prefixes of as many characters as some rule has are made, which loses none. Expressions meet the
rules on the first 4 bytes of their SHA-256 by an equi-join; the full digest confirms a meeting, and
the longest rule wins (then the longer host, then block before allow). A url that no rule fits is allowed.

Matches are found for each different (host, path) and joined back, so repeated urls cost nothing more
and a very frequent one is a skewed join that Spark splits.

Cases: null, empty or scheme-less urls have an empty host and path, and no rule; an empty host fits no
rule; repeated rows are judged each; no rules allow all; an empty table gives no rows; further
columns of pages are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the contract's query as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"
PREFIX = 8  # hexadecimal digits


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without `://`."""
    rest = F.when(url.contains("://"), F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages (page_id, url) with host, path, rule and verdict; rules (verdict, host, path)."""
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.where("host is not null and host <> '' and path is not null").select("verdict", F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.withColumn("digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("digest", 1, PREFIX))
    # the different label counts and path lengths of the rules: a few small numbers, however many the rules
    shapes = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\.", -1))), F.collect_set(F.length("rule_path"))).first()
    labels = F.split("host", r"\.", -1)
    suffixes = F.filter(F.array(*[F.when(F.size(labels) >= n, F.substring_index("host", ".", -n)) for n in sorted(shapes[0])] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(shapes[1])] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    distinct = urls.where("host <> ''").select("host", "path").distinct()
    terms = distinct.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    terms = terms.withColumn("full", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full", 1, PREFIX))
    met = terms.join(rules, "short").where("full = digest")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block")).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op3(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(pages, rules)
