"""URL filters: each URL is expanded into host suffixes and path prefixes, which are looked up in a list of rules by short hash prefixes.

A rule is a host, a path and a verdict. It fits its host and all subdomains of it, if the URL's path starts with the rule's path. A rule
is filed under its expression: its host, and its path up to the last slash. A URL has an expression for each suffix of its host (at
whole labels) and each prefix of its path that ends with a slash, and the empty path, so that the expression of every rule that can fit
is among them; suffixes with more labels, and prefixes with more slashes, than any rule has are not made. Expressions meet rules by the
first 32 bits of their SHA-256 digests, whole digests are compared then, and what is left of the rule's path. The longest rule wins
(by the code points of host and path; then the longer host, then block before allow, then the greater text). A URL that no rule fits
is allowed.

Only functions of DataFrames are used. Pages are reduced to key, host and path, and only these are shuffled (equal rows are combined
before that, and come out again at the end); expressions that no rule can have are dropped by a bounded table of bits before they meet the rules;
whether the rules are broadcast is left to Spark, by their size.

Defined cases: a null URL, or one without ``://``, has an empty host and path, which no rule fits unless its host is empty too; an empty
path fits only rules with an empty path; hosts keep ports, user names and empty labels as they are, and only A-Z are lower-cased; very
long URLs are used whole; null keys are keys; rows that repeat come out as often as they came in; rules with a null in host or path are
ignored, a repeated rule counts once; an empty table, or no rules, give no rows, or no rule for any; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

#: The rules of the query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest by which expressions and rules meet.
PREFIX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _anchor(path: Column, slashes: Column) -> Column:
    """The prefix of a path that ends with so many slashes; none: empty."""
    return F.when(slashes > 0, F.concat(F.call_function("substring_index", path, F.lit("/"), slashes), F.lit("/"))).otherwise(F.lit(""))


def filed(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their number of labels and slashes, the digest of their expression and its prefix; each once."""
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    some = rules.filter("host is not null and path is not null").select(host.alias("rule_host"), path.alias("rule_path"), "verdict").distinct()
    shaped = some.withColumns({"labels": _labels(F.col("rule_host")), "slashes": _slashes(F.col("rule_path"))})
    digest = F.sha2(F.concat("rule_host", _anchor(F.col("rule_path"), F.col("slashes"))), 256)
    return shaped.withColumn("rule_digest", digest).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))


def expressions(sites: DataFrame, labels: int, slashes: int) -> DataFrame:
    """One row for each expression of (host, path) with up to so many labels and slashes: its digest, and the prefix of that."""
    parts = F.split("host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(slashes))), lambda k: _anchor(F.col("path"), k))
    every = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    return sites.withColumn("digest", F.explode(every)).withColumn("digest", F.sha2("digest", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule (its text, or null) and verdict of every row."""
    host, path = host_and_path(F.col(f"`{url}`"))
    sites = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), path.alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("n"))
    listed = filed(rules)
    most = listed.agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes")).first()  # two numbers
    every = expressions(sites, most["labels"] or 1, most["slashes"] or 0)
    met = c.likely(every, "prefix", listed, "prefix").join(listed, "prefix")
    fits = met.filter((F.col("digest") == F.col("rule_digest")) & F.startswith("path", F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(text), F.length("rule_host"), (F.col("verdict") == "block").alias("block"), text.alias("text"), "verdict")
    best = fits.groupBy("page_id", "host", "path").agg(F.max(rank).alias("best"))
    left, right = sites.alias("s"), best.alias("b")
    same = F.col("s.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("s.host") == F.col("b.host")) & (F.col("s.path") == F.col("b.path"))
    found = left.join(right, same, "left").select("s.page_id", "s.host", "s.path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), "n")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "_copy")


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules as a frame, without Python rows."""
    listed = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*listed)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(c.table(spark, sf_dir, "pages"), rules_of(spark, RULES))


def sql() -> str:
    """The same for DuckDB: every rule on every page."""
    listed = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
    with rest as (select page_id, row_number() over () as n, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    site as (select page_id, n, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
    rules(h, p, v) as (values {listed}),
    best as (
        select n, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as verdict from site, rules
        where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n
    )
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from site left join best using (n)
    """
