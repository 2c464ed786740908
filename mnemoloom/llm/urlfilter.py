"""URL rules by host-suffix and path-prefix expressions, matched through short hash prefixes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are broadcast; longer lists are joined by a shuffle on the hash prefix and one of SALTS salts.
BROADCAST_RULES, SALTS = 10_000, 64


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table; repeated (host, path) keep the one that sorts first."""
    unique = {(h.translate(str.maketrans(UPPER, LOWER)), p): v for h, p, v in sorted(rules, key=lambda r: (r[0], r[1], r[2]), reverse=True)}
    return spark.createDataFrame([(h, p, v) for (h, p), v in sorted(unique.items())], "rule_host string, rule_path string, rule_verdict string")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", prefix_hex: int = 8) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts with its
    path; the longest host wins, then the longest path. Each url is expanded into host suffixes (as
    many labels as the longest rule host has, no more) x path prefixes (of the lengths that rules
    have); expressions meet rules by the first ``prefix_hex`` hex digits of their SHA-256, and a pair
    counts only if the full digests agree.

    Defined cases: null or malformed urls have empty host and path and get ``default``; repeated rows
    and null ids are each judged; extra columns are ignored; no rules or an empty table work.

    Scale: with a rule list that can be broadcast, a row's expressions stay in its partition up to the grouped maximum, which so is complete
    before the shuffle; only one row per url moves and no key of hosts is formed. A longer list meets the expressions by a shuffle, in which an
    expression that very many urls have (a top-level domain) is dealt to SALTS keys by its row, and each rule goes to all of them.
    """
    spark = pages.sparkSession
    table = rules_table(spark, rules)
    labels = max([h.count(".") + 1 for h, _, _ in rules], default=0)
    lengths = sorted({len(p) for _, p, _ in rules})
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path")).withColumn("row", F.monotonically_increasing_id())
    suffixes = F.array(*(F.substring_index("host", ".", -k) for k in range(1, max(labels, 1) + 1)))
    prefixes = F.array(*(F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths or [0]))
    pairs = F.flatten(F.transform(F.array_distinct(suffixes), lambda h: F.transform(F.array_compact(prefixes), lambda p: F.concat(h, F.lit("\n"), p))))
    expanded = urls.select("row", "page_id", "host", "path", F.explode_outer(F.when(F.length("host") > 0, pairs)).alias("expression")).withColumn("digest", F.sha2(F.encode("expression", "UTF-8"), 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    keyed = table.withColumn("rule_digest", F.sha2(F.encode(F.concat("rule_host", F.lit("\n"), "rule_path"), "UTF-8"), 256)).withColumn("short", F.substring("rule_digest", 1, prefix_hex))
    if len(rules) <= BROADCAST_RULES:
        met = expanded.join(F.broadcast(keyed), "short", "left")
    else:
        salted = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        met = expanded.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).join(salted, ["short", "salt"], "left")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule_host").alias("h"), F.length("rule_path").alias("p"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(fits).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
