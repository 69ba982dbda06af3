"""URL filters (native): rules indexed by their rarest literal token.

A URL's tokens fetch the rules indexed under them, and only those run their regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

TOKEN_BREAK = r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+"
#: A map of the index goes into the plan up to this many rules; beyond it the index is a table that is joined.
MAP_RULES = 256
#: Up to so many rules (some 200 bytes each) their table is broadcast.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    """``regex`` runs on host + path; ``tokens`` are literals that stand as whole tokens in every URL it matches."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int
    listed: bool = True


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """A rule for a host with all its subdomains and the paths that start with ``path``; longer rules rank higher."""
    words = [w for w in re.split(r"[^A-Za-z0-9\u0080-\U0010ffff]+", host) if w]
    whole = path if not path or re.search(r"[^A-Za-z0-9\u0080-\U0010ffff]$", path) else re.sub(r"[A-Za-z0-9\u0080-\U0010ffff]+$", "", path)
    words += [w for w in re.split(r"[^A-Za-z0-9\u0080-\U0010ffff]+", whole) if w]
    return UrlRule(host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}" + ("" if path else r"(?:/|$)"), tuple(dict.fromkeys(words)), verdict, 1_000_000 + len(host + path))


def word_rule(*words: str) -> UrlRule:
    """A pattern rule: block hosts that hold these words in this order, joined by - or nothing else but a dot or -."""
    joined = r"[.-]".join(map(re.escape, words))
    return UrlRule("-".join(words), rf"^(?:[^/]*[.-])?{joined}(?:[.-][^/]*)?(?:/|$)", words, "block", 0, listed=False)


def rules_of(lines: Iterable[str]) -> list[UrlRule]:
    """Rules from lines of a list: ``block host/path``, ``allow host/path``, or ``words a b`` to block hosts by words.

    Blank lines and what follows a # are left out; of equal hosts and paths the last line counts.
    """
    found: dict[str, UrlRule] = {}
    for line in lines:
        kind, *rest = line.split("#")[0].split() or [""]
        if kind in ("block", "allow") and len(rest) == 1:
            host, slash, path = rest[0].partition("/")
            found[rest[0]] = host_rule(host.lower(), slash + path, kind)
        elif kind == "words" and rest:
            rule = word_rule(*rest)
            found[rule.name] = rule
        elif kind:
            raise ValueError(f"no such rule: {line.strip()}")
    return list(found.values())


def load_rules(spark: SparkSession, path: str) -> list[UrlRule]:
    """``rules_of`` a text file that Spark can read; a rule list is configuration and fits the driver."""
    return rules_of(r.value for r in spark.read.text(path).collect())


#: The contract's listed rules.
LISTED = (host_rule("net", "/", "block"), host_rule("example.net", "/en/", "allow"), host_rule("example.com", "/de/", "block"), host_rule("org", "/fr/", "allow"))
#: Names of hosts that the method itself blocks where no listed rule fits.
PATTERNS = (word_rule("spam", "farm"), word_rule("cheap", "pills"), word_rule("casino", "win"), word_rule("free", "bets"), word_rule("ads", "track"))


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, path), TOKEN_BREAK), lambda t: t != ""))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' own tokens stands, over all URLs: one row a token comes back."""
    if not tokens:
        return {}
    if len(tokens) <= 4 * MAP_RULES:
        found = urls.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, tokens)))).alias("t"))
    else:
        wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "t string")
        found = urls.select(F.explode("_tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c")).join(wanted, "t", "left_semi")
        return {r.t: r.c for r in found.collect()}
    return {r.t: r.c for r in found.groupBy("t").agg(F.count(F.lit(1)).alias("c")).collect()}


def rarest_token_index(urls: DataFrame, rules: list[UrlRule]) -> dict[str, list[UrlRule]]:
    """Each rule under the one of its tokens that the fewest URLs hold; rules without a token under ''."""
    counts = token_counts(urls, sorted({t for r in rules for t in r.tokens}))
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def filter_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", map_rules: int = MAP_RULES) -> DataFrame:
    """Judge every URL: host, path, the fitting rule of the highest rank and its verdict, else ``default``.

    Up to ``map_rules`` rules the index is a map in the plan: no shuffle at all. A larger rule list is a table that
    tokens are joined with (broadcast up to BROADCAST_RULES, rules being configuration); what fits is reduced to
    the best rule of a host and path where it lies, and joined back. URLs of any length are judged whole. Null URLs and URLs without :// have empty host and path and fit no rule.
    Repeated rows are each judged; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_tokens", url_tokens(F.col("host"), F.col("path")))
    index = rarest_token_index(rows, rules)
    kind = "struct<rank:int,name:string,verdict:string,listed:boolean,regex:string>"
    if len(rules) <= map_rules:
        row = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.listed).alias("listed"), F.lit(r.regex).alias("regex"))
        table = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*map(row, rs)))]) if index else F.create_map().cast(f"map<string,array<{kind}>>")
        fetched = F.flatten(F.transform(F.concat(F.col("_tokens"), F.array(F.lit(""))), lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast(f"array<{kind}>"))))
        fits = F.filter(fetched, lambda c: F.rlike(F.concat("host", "path"), c.regex))
        best = rows.withColumn("_best", F.array_max(fits))
    else:
        rules_df = spark.createDataFrame([(t, (r.rank, r.name, r.verdict, r.listed, r.regex)) for t, rs in index.items() for r in rs], f"_token string, _rule {kind}")
        # only tokens that a rule is indexed under go on, and of a host and path only its best rule
        asked = rows.select("host", "path", F.explode(F.concat(F.col("_tokens"), F.array(F.lit("")))).alias("_token"))
        fetched = asked.join(F.broadcast(rules_df) if len(rules) <= BROADCAST_RULES else rules_df, "_token").where(F.rlike(F.concat("host", "path"), F.col("_rule.regex")))
        found = fetched.groupBy(F.struct("host", "path").alias("_where")).agg(F.max("_rule").alias("_best"))
        best = rows.join(found, F.struct("host", "path") == F.col("_where"), "left")
    return best.select(
        "page_id", "host", "path",
        F.when(F.col("_best.listed"), F.col("_best.name")).alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"),
        F.when(~F.col("_best.listed"), F.col("_best.name")).alias("pattern"),
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), [*LISTED, *PATTERNS])


_WORDS = " ".join(f"WHEN regexp_matches(hp, '{p.regex}') THEN '{p.name}'" for p in PATTERNS)
OP3_SQL = rf"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, host || path AS hp, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts),
named AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {_WORDS} END END AS pattern FROM ruled)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM named
"""
