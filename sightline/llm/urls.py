"""URL rules by hashed host-suffix and path-prefix expressions, with DataFrame functions only (operator 3).

A url's host and path are expanded into the expressions that a rule could equal: host suffixes of as many labels as some
rule has, each with path prefixes of a length that some rule has. Both lists come from the rules, so nothing is cut off.
Expressions join the rules on the first 8 hex digits of SHA-256 and are confirmed by the full digest; of a row's rules the
longest wins. The rules' side has no broadcast hint: Spark broadcasts it while its size is under its own threshold, and
else shuffles both. A row's expressions lie together, so the final aggregation shrinks to a row each before it shuffles,
by a row number that no two rows share: no host is a hot key.

A null url, or one without "://", has an empty host and an empty path and fits no rule. Rows are kept as often as they
come. An empty rule table leaves all to the default verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spare_name

#: The contract's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table without any Python data."""
    kind = "array<struct<verdict:string,rule_host:string,rule_path:string>>"
    every = F.array(*[F.struct(*map(F.lit, r)) for r in rules]).cast(kind) if rules else F.array().cast(kind)
    return spark.range(1).select(F.inline(every))


def url_verdicts(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict; columns of those names are replaced. rules: verdict, rule_host, rule_path."""
    shape = rules.agg(
        F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\.", -1)))).alias("labels"),
        F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"),
    ).first()
    labels, lengths = list(shape["labels"] or []), list(shape["lengths"] or [])
    base = pages.drop("host", "path", "rule", "verdict")
    row, cand, best = (spare_name(base.columns, x) for x in ("row", "candidate", "best"))
    base = base.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    if not labels:
        return base.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    parts = F.split("host", r"\.", -1)
    hosts = F.transform(F.array(*map(F.lit, labels)), lambda n: F.when(n <= F.size(parts), F.array_join(F.slice(parts, -n, n), ".")))
    paths = F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n)))
    pairs = F.flatten(F.transform(F.array_compact(hosts), lambda h: F.transform(F.array_compact(paths), lambda p: F.concat(h, p))))
    keyed = rules.select(F.concat("rule_host", "rule_path").alias("rule"), "verdict").distinct()
    keyed = keyed.withColumn("digest", F.sha2("rule", 256)).select(F.substring("digest", 1, 8).alias("short"), "digest", F.struct(F.length("rule").alias("n"), "rule", "verdict").alias("fits"))
    numbered = base.withColumn(row, F.monotonically_increasing_id())
    asked = numbered.select(row, *base.columns, F.explode_outer(pairs).alias(cand)).withColumn(cand, F.sha2(F.col(cand), 256))
    joined = asked.join(keyed, (F.substring(F.col(cand), 1, 8) == F.col("short")) & (F.col(cand) == F.col("digest")), "left")
    grouped = joined.groupBy(row).agg(*[F.first(c).alias(c) for c in base.columns], F.max("fits").alias(best))
    return grouped.withColumn("rule", F.col(best)["rule"]).withColumn("verdict", F.coalesce(F.col(best)["verdict"], F.lit(default))).drop(row, best)
