"""URL filters by hashed expressions: host suffixes times path prefixes, looked up by short hash prefix."""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.graph import split_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8  # hex digits of the hash prefix
DEFAULT = "allow"

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_of(url: Column) -> Column:
    """What stands after the first ://, up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules as a table (rule_host, rule_path, rule_verdict); a large rule set can be any DataFrame of these columns."""
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages' columns with host, path, rule and verdict.

    Each different (host, path) is expanded into expressions: the host's last k labels with the path's first n characters, for each (k, n) that some rule has. Expressions meet rules by equality of a short prefix of their SHA-256, the full digests confirm it, and the longest rule wins (then that with the longer host, then by text). A rule holds for its host and subdomains and paths that start with its path. Null and empty urls, and those without ://, have an empty host and path and match no rule but one of empty path and host. Repeated rows are judged alike; an empty table gives no rows, and without rules all have the default. Texts of any length are judged whole. Pages' columns host, path, rule and verdict are replaced.

    The different (k, n) are all that comes to the driver of rules, as one literal: hosts have at most 127 labels, so there are at most 127 times as many as path lengths. Pages are joined with the verdicts of their (host, path) such that a hot pair, like that of all null urls, can be split.
    """
    shape = rules.select(F.size(F.split("rule_host", r"\.")).alias("k"), F.length("rule_path").alias("n")).distinct().collect()
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    places = parsed.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    shapes = F.from_json(F.lit(json.dumps([[r["k"], r["n"]] for r in shape])), "array<array<int>>")
    fit = F.filter(shapes, lambda s: (F.size(labels) >= F.get(s, F.lit(0))) & (F.length("path") >= F.get(s, F.lit(1))))
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    wanted = F.transform(fit, lambda s: F.sha2(F.concat(tail(F.get(s, F.lit(0))), F.substring("path", F.lit(1), F.get(s, F.lit(1)))).cast("binary"), 256))
    asked = places.select("host", "path", F.explode(wanted).alias("digest"))
    known = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2(F.col("rule").cast("binary"), 256))
    hits = asked.withColumn("short", F.substring("digest", 1, SHORT)).join(known.withColumn("short", F.substring("rule_digest", 1, SHORT)), "short").where(F.col("digest") == F.col("rule_digest"))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("a"), F.length("rule_host").alias("b"), "rule", "rule_verdict")).alias("_best"))
    out = split_join(parsed, best, ["host", "path"], "left")
    return out.select(*(c for c in parsed.columns), F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))
