"""URL filters: host-suffix and path-prefix expressions matched by hash prefixes.

A rule has a host, a path and a verdict. It fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's. Each different (host, path) is expanded into the pairs of a host
suffix and a path prefix that some rule has the shape of (labels of the host, characters of the path);
the first characters of their digests meet those of the rules in an equi-join, and only pairs whose whole
digests agree stay. Of several fitting rules the longest text (host and path) wins, then the longer
host, then ``block``. A URL without a rule gets the default verdict.

The number of expressions of a URL is bounded by the shapes that occur among the rules, not by the number
of rules. Repeated URLs shrink to one before they are expanded. Spark broadcasts the rules only below its own size
limit; above it both sides are shuffled by hash prefix, and a common expression is a skewed key whose rows
the adaptive join splits, as both sides are plain shuffles.

Edge cases: a null URL, or one without ``://``, has an empty host and path, which only a rule with an
empty host and path fits. Null hosts, paths and verdicts of rules read as empty, empty and ``block``. Equal rules
count once; of two rules that differ in the verdict only, ``block`` wins. Long URLs are read whole.
Repeated rows stay repeated, without rules all get the default, empty tables give empty results, and
columns other than key and URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import table
from cairn.sources.scratch import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal characters of a digest that the join compares.
SHORT = 8
DEFAULT = "allow"
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def compiled(rules: DataFrame) -> DataFrame:
    """(host, path, verdict, digest, short) of each different rule of (host, path, verdict)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = rules.select(
        F.translate(text("host"), UPPER, LOWER).alias("host"),
        text("path").alias("path"),
        F.coalesce(F.col("verdict"), F.lit("block")).alias("verdict"),
    )
    whole = digest(F.col("host"), F.col("path"))
    return plain.distinct().withColumns({"digest": whole, "short": F.substring(whole, 1, SHORT)})


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """(labels of the host, characters of the path) of the rules: bounded by their longest host and path."""
    found = rules.select(labels(F.col("host")).alias("l"), F.char_length("path").alias("n")).distinct()
    return sorted((r["l"], r["n"]) for r in found.collect())


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Array of (digest, short) of the host suffixes and path prefixes of the given shapes."""
    have = F.array(*[F.struct(F.lit(l).alias("l"), F.lit(n).alias("n")) for l, n in shapes])
    fit = F.filter(have, lambda s: (s["l"] <= labels(host)) & (s["n"] <= F.char_length(path)))
    whole = F.transform(
        fit,
        lambda s: digest(F.call_function("substring_index", host, F.lit("."), -s["l"]), F.substr(path, F.lit(1), s["n"])),
    )
    return F.transform(whole, lambda d: F.struct(d.alias("whole"), F.substring(d, 1, SHORT).alias("front")))


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the winning rule of each different (host, path) that has one."""
    rules = cut_lineage(compiled(rules))
    known = shapes(rules)
    if not known:
        empty = urls.select("host", "path", F.lit("").alias("rule"), F.lit("").alias("verdict"))
        return empty.filter(F.lit(False))
    opened = urls.select("host", "path").distinct()
    opened = opened.select("host", "path", F.inline(expressions(F.col("host"), F.col("path"), known)))
    right = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict", "digest", "short"
    )
    met = opened.join(right, F.col("front") == F.col("short")).filter(F.col("whole") == F.col("digest"))
    rule = F.concat("rule_host", "rule_path")
    order = F.struct(F.char_length(rule), F.char_length("rule_host"), F.col("verdict") == "block", "verdict")
    best = F.max_by(F.struct(rule.alias("rule"), "verdict"), order)
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``pages``."""
    rows = pages.select(F.col(key).alias(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    # Written, so that a very common URL is a skewed side of a plain join; never broadcast, as it grows with the URLs.
    found = cut_lineage(matches(rows, rules)).hint("merge")
    return rows.join(found, ["host", "path"], "left").select(
        key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


OP13_SQL = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
                    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
s AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t
  FROM pages),
u AS (
  SELECT page_id, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path,
         translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM s),
d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM d JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict
FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""
