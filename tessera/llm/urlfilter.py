"""URL filters by hash prefixes.

Method: each distinct URL is expanded into expressions of a host suffix and a path prefix; the short prefixes of their
digests are equi-joined with those of the rules, then the full digests are compared and the longest rule wins.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the default verdict;
repeated rows get repeated results; of rules that are equally long the smaller string wins; no rules at all is allowed; a
URL of any length is expanded whole, into as many suffixes as its host has labels; an empty table gives an empty table;
columns other than the id and the URL are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize

#: Hex digits of the short hash prefix: four bytes.
PREFIX = 8
#: Rules are broadcast up to so many rows, else joined by a shuffle.
BROADCAST_ROWS = 50_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``(host, path, verdict)`` rows as a table with the digest of each expression."""
    df = spark.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    return with_digest(df.withColumn("rule", F.concat("rule_host", "rule_path")), "rule_host", "rule_path").dropDuplicates(["rule"])


def with_digest(df: DataFrame, host: str, path: str) -> DataFrame:
    # a line end can't be in a host, so it parts the two
    full = F.sha2(F.concat_ws("\n", host, path), 256)
    return df.withColumn("full", full).withColumn("short", F.substring("full", 1, PREFIX))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for each row."""
    pages = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rules = rules.select(F.col("full").alias("rule_full"), F.col("short").alias("rule_short"), "rule", F.col("verdict").alias("rule_verdict"), F.length("rule_path").alias("n"))
    # a rule's path may end anywhere; only the lengths that rules have need to be tried, and there are few
    lengths = sorted(r["n"] for r in rules.select("n").distinct().collect())
    n_rules = rules.limit(BROADCAST_ROWS + 1).count()
    parts = F.split("host", r"\.", -1)
    urls = pages.where("host <> ''").select("host", "path").distinct()
    expanded = urls.select(
        "host",
        "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"),
        F.array(*[F.lit(n) for n in lengths]).cast("array<int>").alias("lengths"),
    ).select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    expanded = with_digest(expanded.withColumn("prefix", F.expr("substring(path, 1, n)")), "suffix", "prefix").drop("n")
    found = expanded.join(F.broadcast(rules) if n_rules <= BROADCAST_ROWS else rules, F.col("short") == F.col("rule_short")).where("full = rule_full")
    best = found.groupBy("host", "path").agg(F.min(F.struct((-F.length("rule")).alias("order"), "rule", "rule_verdict")).alias("best"))
    # read again, so that the join deals both sides out by itself and Spark can split a hot URL
    best = materialize(best.select("host", "path", "best.rule", "best.rule_verdict"))
    # matched URLs grow with the pages: they are never broadcast
    return pages.join(best.hint("merge"), ["host", "path"], "left").select(id_col, "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
