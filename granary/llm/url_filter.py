"""URL filtering by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: host, path, verdict. A rule fits its host and the subdomains of it, where the path starts with the rule's path.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Rules up to this count are broadcast (about 100 bytes each, so 20 MB); more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: Hexadecimal digits of a digest that the equi-join uses; 8 of them are 32 bits.
PREFIX = 8


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A to Z in lower case; empty for null or a url without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or a url without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: id, host, path, rule (like net/, else null), verdict.

    Each url is expanded into the suffixes of its host that have as many labels as some rule's host, times the prefixes
    of its path that have the length of some rule's path; the expressions meet the rules by the first 32 bits of their
    SHA-256, then the full digest and the text itself are compared. Of the rules that fit, the one with the longest
    text wins, then the longer host, then block. The work is linear in a url's length, however many labels it has.

    Urls are expanded, joined and reduced to one row each where they are read; that row goes through one shuffle, in
    which rows that repeat an id and a url are counted in each task first. Null urls and urls without :// have empty
    host and path, fit no rule and get the default. Ids may be null or repeat. An empty table gives an empty result,
    without rules all get the default. Other columns are not read, so their names do not matter.
    """
    known = rules.dropna().dropDuplicates().select("rule_host", "rule_path", "rule_verdict", _digest(F.col("rule_host"), F.col("rule_path")).alias("_sha"))
    rule = F.concat("rule_host", "rule_path")
    known = known.select(F.substring("_sha", 1, PREFIX).alias("_short"), F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h_n"), F.col("rule_verdict").alias("v"), rule.alias("rule"), F.col("rule_host").alias("h"), F.col("rule_path").alias("p"), F.col("_sha").alias("sha")).alias("_r"))
    labels = F.size(F.split(F.col("_r.h"), r"\.", -1))
    n_rules, lengths, counts = known.agg(F.count("*"), F.sort_array(F.collect_set(F.length("_r.p"))), F.sort_array(F.collect_set(labels))).first()
    by_short = known.groupBy("_short").agg(F.collect_list("_r").alias("_rules"))  # one row for a short hash: the join makes no rows
    if n_rules <= BROADCAST_RULES:
        by_short = F.broadcast(by_short)
    urls = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("*", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    suffixes = F.array_distinct(F.array(*[F.substring_index("_host", ".", -n) for n in counts]).cast("array<string>"))
    prefixes = F.transform(F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    expressions = F.when(F.col("_host") != "", F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("h"), p.alias("p"))))))
    rows = urls.select("_id", "_url", F.posexplode_outer(expressions).alias("_at", "_e")).withColumn("_sha", _digest(F.col("_e.h"), F.col("_e.p")))
    rows = rows.withColumn("_short", F.substring("_sha", 1, PREFIX)).join(by_short, "_short", "left")
    fits = F.filter("_rules", lambda r: (r["sha"] == F.col("_sha")) & (r["h"] == F.col("_e.h")) & (r["p"] == F.col("_e.p")))
    best = rows.groupBy("_id", "_url").agg(F.max(F.array_max(F.transform(fits, lambda r: F.struct(r["n"], r["h_n"], r["v"], r["rule"])))).alias("_best"), F.count_if(F.coalesce(F.col("_at"), F.lit(0)) == 0).alias("_m"))
    out = best.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m"))))
    return out.select(F.col("_id").alias(id_col), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.v"), F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS k FROM rest),
fit AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS n
  FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM cut LEFT JOIN fit ON cut.k = fit.k AND fit.n = 1
"""
