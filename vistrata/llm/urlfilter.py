"""Block and allow rules for URLs, matched by an equi-join on hash prefixes.

A rule is a host and a path prefix. Each URL is expanded into the expressions
that could be a rule fitting it: every suffix of its host at a dot with every
prefix of its path as long as some rule's path. Expressions meet the rules on
the first bytes of their digest; the whole digest is compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vistrata.llm.tables import ascii_lower, quoted

# The fixed rules of the registered query: host, path, verdict.
BASE_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
PREFIX_DIGITS = 8
# Rules are broadcast up to this number of rows, else joined by shuffle with salted expressions.
BROADCAST_RULES = 100_000
SALTS = 16


def rule_table(spark: SparkSession, rules=BASE_RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for NULL or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _host_suffixes(host: Column) -> Column:
    parts = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def judge(pages: DataFrame, rules: DataFrame, id_column: str = "page_id",
          url_column: str = "url", default: str = "allow", broadcast_rules: int | None = None
          ) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains when the path starts with the rule's
    path. The longest fitting rule (code points of host and path) decides, among
    equally long ones the smallest by text, block before allow. Without a rule
    ``rule`` is NULL and the verdict is ``default``. NULL urls and urls without
    ``://`` have no host and no rule. Repeated rows are judged each; empty tables
    give empty results; other columns are not looked at.
    """
    host, path = split_url(quoted(url_column))
    base = (
        pages.select(quoted(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
        .groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("n"))
    )
    text = F.concat("host", "path")
    known = rules.select(text.alias("rule"), "verdict", F.length("path").alias("size")).distinct()
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())
    digest = F.sha2(F.col("rule"), 256)
    known = known.select(
        "rule", F.col("verdict").alias("rule_verdict"), digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("prefix"))

    lengths = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"),
                       lambda n: n <= F.length("path"))
    expanded = (
        base.withColumn("suffix", F.explode(_host_suffixes(F.col("host"))))
        .withColumn("expression", F.explode_outer(F.transform(
            lengths, lambda n: F.concat("suffix", F.substring(F.col("path"), F.lit(1), n)))))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    limit = BROADCAST_RULES if broadcast_rules is None else broadcast_rules
    if known.count() <= limit:
        met = expanded.join(F.broadcast(known), "prefix", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")
        copies = known.withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expanded.withColumn("salt", salt).join(copies, ["prefix", "salt"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & (F.col("host") != "")
    found = F.when(fits, F.struct(
        (-F.length("rule")).alias("short"), F.col("rule").alias("rule"),
        (F.col("rule_verdict") != "block").alias("late"),
        F.col("rule_verdict").alias("verdict")))
    best = met.groupBy("page_id", "host", "path").agg(
        F.min(found).alias("best"), F.first("n").alias("n"))
    return best.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    ).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
